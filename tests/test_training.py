"""Training, prediction, backtests, searches and comparisons of many series."""

import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import boosting, comparison, crossval, jobs, prediction, search, validation
from chronoloom.sources import sinks

T0 = datetime(2024, 1, 1)
KEYS = ["country_code", "forecast_type"]


def history_of(spark, hours=24 * 40, series=(("BE", "load", 0), ("DE", "load", 50), ("FR", "solar", 9))):
    rows = [(c, t, T0 + timedelta(hours=h), float(h % 24 + d + (h // 24 % 7 > 4) * 4)) for c, t, d in series for h in range(hours)]
    return spark.createDataFrame(rows, "country_code string, forecast_type string, ts timestamp, y double").repartition(4)


def test_known_leaves_the_future_out(spark):
    h = history_of(spark)
    got = prediction.known(h, "2024-01-25 09:00:00", 3).agg(F.min("ts"), F.max("ts")).first()
    assert list(got) == [datetime(2024, 1, 22), datetime(2024, 1, 25, 23)]
    runs = spark.createDataFrame([("BE", T0, T0 - timedelta(hours=k), v) for k, v in ((1, 1.0), (5, 2.0), (9, 3.0))], "c string, ts timestamp, run timestamp, t double")
    assert [r.t for r in prediction.weather_known(runs, "2023-12-31 20:00:00", ["c"], ["t"], "run").collect()] == [2.0]


def test_assembled_rows(spark):
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=h), float(h), h / 10, 1, 280.0, 6.85) for h in range(30)] + [("b", T0, 4.0, 0.5, 2, 270.0, -3.15)], "k string, ts timestamp, y double, lag double, month int, temperature_2m_k double, temperature_c double")
    frame = frame.withColumns({"hour": F.hour("ts"), "heating_degree": F.lit(1.0)})
    target = [("a", datetime(2024, 2, 3, 5)), ("a", datetime(2024, 2, 3, 7)), ("b", datetime(2024, 2, 3, 0)), ("b", datetime(2024, 2, 3, 1)), ("c", datetime(2024, 2, 3, 0))]
    targets = spark.createDataFrame(target, "k string, ts timestamp")
    weather = spark.createDataFrame([("a", datetime(2024, 2, 3, 5), 283.15), ("b", datetime(2024, 2, 3, 0), 283.15), ("a", datetime(2024, 2, 3, 7), None)], "k string, ts timestamp, temperature_2m_k double")
    columns = ["lag", "month", "hour", "temperature_2m_k", "temperature_c", "heating_degree"]
    got = {(r.k, r.ts.hour): r for r in prediction.assemble(frame, targets, ["k"], columns, weather, load=F.col("k") == "a").collect()}
    a = got["a", 5]
    assert (a.lag, a.month, a.hour, a.temperature_2m_k, a.temperature_c, a.heating_degree, a.fallback) == (2.9, 2, 5, 283.15, 10.0, 8.0, None)
    assert got["a", 7][2:] == (0.7, 2, 7, 280.0, 6.85, 1.0, None)  # a null forecast leaves what was there
    assert (got["b", 0].temperature_c, got["b", 0].heating_degree) == (10.0, 1.0)  # not a load
    assert got["b", 1][2:] == (None,) * 6 + (4.0,) and got["c", 0].fallback == 0.0


def test_train_all_and_daily_forecasts(spark):
    h = history_of(spark)
    work = jobs.work_list(spark, ["BE", "DE", "FR", "IT"], ["load", "solar"], [1, 2])
    assert work.count() == 16 and jobs.work_list(spark, ["BE"], ["load", "price"]).orderBy("horizon").collect()[1].horizon == 2
    report, models, names = jobs.train_all(h, work, "2024-02-05 06:00:00", params={"rounds": 30}, least_rows=500, validation_rows=100)
    got = {(r.country_code, r.forecast_type): r for r in report.collect()}
    assert len(got) == 8 and sum(r.status == "completed" for r in got.values()) == 3
    assert got["IT", "load"].reason == "no data" and got["BE", "load"].mae < 2 and "hour" in names and models.count() == 3
    few = jobs.train_all(h, work, "2024-01-03 06:00:00", least_rows=500)[0]
    assert {r.reason for r in few.collect()} == {"no data", "insufficient data"}
    out = jobs.forecasts(h, work, {"boosted": lambda a, b: jobs.boosted(a, b, params={"rounds": 60})}, "2024-02-05 06:00:00").collect()
    assert {(r.country_code, r.forecast_type) for r in out} == {(c, t) for c in ("BE", "DE", "FR", "IT") for t in ("load", "solar")}
    of = lambda c, t: [r for r in out if (r.country_code, r.forecast_type) == (c, t)]
    assert all(r.forecast_value == 0.0 for r in of("IT", "load")) and len(of("IT", "load")) == 48
    assert all(abs(r.forecast_value - (r.target_timestamp_utc.hour + 50)) < 3 for r in of("DE", "load")) and len(of("DE", "load")) == 48


def test_no_runner_given(spark):
    out = jobs.forecasts(history_of(spark, 24 * 20, (("BE", "load", 0),)), jobs.work_list(spark, ["BE"], ["load"]), {}, "2024-01-20 06:00:00")
    assert {r.model_name for r in out.select("model_name").distinct().collect()} == set(jobs.RUNNERS)


def test_chosen():
    assert jobs.chosen("ALL", jobs.TYPES) == list(jobs.TYPES)
    assert jobs.chosen(" be, de,,be", (), True) == ["BE", "DE"]


def test_runners_fail_alone(spark, tmp_path):
    """One that raises, one whose Spark job hangs, and one that gives forecasts: only the last one's are stored."""
    h, work = history_of(spark, 24 * 10), jobs.work_list(spark, ["BE", "DE"], ["load"], [1])
    table = sinks.tables(spark, str(tmp_path))["forecasts"]
    # the slow job's own rows must not be optimised away
    hang = F.udf(lambda v: time.sleep(1000) or v, "double")

    def hanging(history, hours):
        return hours.withColumn("p", hang(F.col("horizon").cast("double")))

    def raising(history, hours):
        raise KeyError("no such model")

    began = time.monotonic()
    log = jobs.run_all(h, work, lambda rows: sinks.save_forecasts(table, rows), "2024-01-09 06:00:00", {"hanging": hanging, "raising": raising, "persistence": jobs.persistence}, limit=15)
    assert time.monotonic() - began < 60
    assert {n: s for n, s, _ in log} == {"hanging": "timeout", "raising": "failed", "persistence": "completed"}
    assert "no such model" in next(m for n, _, m in log if n == "raising")
    assert {(r.model_name, r.n) for r in table.read().groupBy("model_name").agg(F.count("*").alias("n")).collect()} == {("persistence", 48)}
    for _ in range(100):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_retraining(spark):
    """Epochs against a plain loop over days, and each model trained on its prefix only."""
    r = random.Random(1)
    rows = []
    for k in "ab":
        for d in range(60):
            for h in range(24 if r.random() > 0.2 else 12):
                rows.append((k, T0 + timedelta(days=d, hours=h), 10.0 + h, None if r.random() < 0.3 else float(d)))
    df = spark.createDataFrame(rows, "k string, ts timestamp, y double, err double")
    got = {(x.k, x.day): (x.n_test, x.n_train, x.epoch, x.until) for x in validation.retraining_days(df, ["k"], "2024-01-15", 7, 20, 400, 200, "err").collect()}
    want = {}
    for k in "ab":
        since, epoch, until = None, -1, None
        for d in range(14, 60):
            day = date(2024, 1, 1) + timedelta(days=d)
            mine = [x for x in rows if x[0] == k and x[1].date() == day]
            past = [x for x in rows if x[0] == k and x[1].date() < day]
            if len(mine) < 20:
                continue
            if since is None and (len(past) < 400 or sum(x[3] is not None for x in past) < 200):
                continue
            if since is None or since + 1 >= 7:
                since, epoch, until = 0, epoch + 1, day
            else:
                since += 1
            want[k, day] = (len(mine), len(past), epoch, until)
    assert got == want and max(v[2] for v in got.values()) >= 3
    days = validation.retraining_days(df, ["k"], "2024-01-15", 7, 20, 400, 200, "err")
    scored = validation.retrained(df.withColumn("x", F.lit(1.0)), days, ["k"], ["x"], "err", {"rounds": 0})
    for x in scored.groupBy("k", "epoch").agg(F.min("p").alias("p"), F.max("p").alias("q"), F.min("day").alias("until")).collect():
        errors = [v for k, t, _, v in rows if k == x.k and t.date() < x.until and v is not None]
        assert x.p == x.q == pytest.approx(np.mean(errors))
    table = validation.correction_backtest(df.withColumns({"x": F.lit(1.0), "tso": F.lit(5.0)}), days, ["k"], ["x"], params={"rounds": 1})
    assert table.where("day is null").count() == 4 and table.where("day is not null").count() == 2 * len(want)


def test_folds_of_all_series(spark):
    df = spark.createDataFrame([(k, T0 + timedelta(hours=h), float(h % 24), float((3 if k == "a" else 5) * (h % 24))) for k in "ab" for h in range(24 * 20)], "k string, ts timestamp, x double, y double")
    folds = crossval.walk_forward_folds(df, ["k"], folds=2, test_days=3, gap_days=1, least_days=8)
    got = validation.trained_all(df, folds, ["k"], ["x"]).withColumn("base", F.col("y") + 10)
    each = validation.by_fold(got, ["k"], "base").collect()
    assert sorted((r.k, r.fold) for r in each) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)] and all(r.mae < 1 and r.skill > 0.9 for r in each)


def test_parzen_draws_beat_even_ones():
    """A valley in four dimensions, over seeds: the same number of trials, the same first ones."""

    def valley(p):
        yield (np.log10(p["rate"]) + 1.5) ** 2 + ((p["depth"] - 6) / 4) ** 2 + (p["rows"] - 0.7) ** 2 + (p["kind"] != "b") * 0.5

    space = {"rate": ("log", 1e-4, 1.0), "depth": ("int", 1, 20), "rows": ("float", 0.0, 1.0), "kind": ("choice", ["a", "b", "c", "d"])}
    ours = [min(t[1] for t in search.run(valley, space, 60, s)) for s in range(30)]
    even = []
    for s in range(30):
        sampler = search.Parzen(space, s)
        even.append(min(sum(valley(sampler.draw([]))) for _ in range(60)))
    assert np.median(ours) < 0.5 * np.median(even) and sum(a < b for a, b in zip(ours, even, strict=True)) >= 20


def test_pruning_keeps_the_best():
    calls = []

    def steps(p):
        for k in range(10):
            calls.append(k)
            yield p["x"] + 0.01 * k

    log = search.run(steps, {"x": ("float", 0.0, 1.0)}, 40)
    assert any(t[2] for t in log) and len(calls) < 400
    best = min((t for t in log if not t[2]), key=lambda t: t[1])
    assert all(t[0]["x"] > best[0]["x"] for t in log if t[2])


def test_search_of_all_series(spark):
    r = np.random.default_rng(0)
    rows = [(k, f, "train" if h < 150 else "test", T0 + timedelta(hours=h), float(x), float(x * (2 if k == "a" else -1))) for k in "ab" for f in (1, 2) for h, x in enumerate(r.random(200))]
    df = spark.createDataFrame(rows, "k string, fold int, role string, ts timestamp, x double, y double")
    got = search.search_all(df, ["k"], ["x"], trials=12, rounds=20).collect()
    assert len(got) == 24 and sorted(x.k for x in got if x.best) == ["a", "b"]
    for k in "ab":
        whole = [x for x in got if x.k == k and not x.pruned]
        assert next(x for x in got if x.k == k and x.best).loss == min(x.loss for x in whole)
    assert search.search_all(df.where("role = 'train'"), ["k"], ["x"], trials=2).count() == 0


def test_interval_covers_and_decides(spark):
    r = random.Random(5)
    rows = [(k, d, shift + 0.3 * day + r.gauss(0, 0.1)) for k, shift in (("same", 0.0), ("worse", 1.0), ("better", -1.0)) for d in range(60) for day in [r.gauss(0, 1)] for _ in range(24)]
    df = spark.createDataFrame(rows, "k string, day int, d double")
    for x in comparison.interval(df, ["k"], "day").collect():
        day_means = [np.mean([v for k, d, v in rows if k == x.k and d == day]) for day in range(60)]
        assert x.n == 1440 and x.blocks == 60 and x.low < x.mean < x.high
        # about four standard errors wide, of days and not of rows
        assert (x.high - x.low) == pytest.approx(3.92 * np.std(day_means, ddof=1) / np.sqrt(60), rel=0.3)
    draws = spark.range(20000).select(comparison.weight(F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert draws[0] == pytest.approx(1, abs=0.03) and draws[1] == pytest.approx(1, abs=0.05)


def test_feature_sets(spark):
    r = np.random.default_rng(3)
    rows = [(k, T0 + timedelta(hours=h), float(r.random()), float(r.random())) for k in "abc" for h in range(24 * 30)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double, z double").withColumn("y", F.col("x") * F.when(F.col("k") == "c", 0.0).otherwise(5.0) + F.col("z"))
    folds = crossval.time_series_split(df, ["k"], 3)
    got = {x.k: x for x in comparison.feature_sets(folds, ["k"], ["z"], ["z", "x"], params={"rounds": 40}).collect()}
    assert got["a"].better == got["b"].better == "b" and got["a"].mae_b < got["a"].mae_a / 2 and got["a"].n == 540 and got["a"].blocks == 23
    assert got["c"].better != "b" or got["c"].change_pct > -5
    assert boosting.BINS == 64


def test_commands(spark, tmp_path):
    """Baselines, training with promotion, and forecasts by the model in production, as commands on tables of two countries."""
    from chronoloom import __main__ as commands

    root = str(tmp_path)
    rows = [(c, T0 + timedelta(hours=h), float(100 + h % 24 * 5 + d + h // 24 % 3), "actual") for c, d in (("BE", 0), ("DE", 50)) for h in range(24 * 40)]
    spark.createDataFrame(rows, "country_code string, timestamp_utc timestamp, load_mw double, data_quality string").write.parquet(f"{root}/energy_load.parquet")
    common = ["--root", root, "--as-of", "2024-02-05 06:00:00", "--types", "load", "--countries", "be,de,it"]
    assert commands.main(["baselines", *common]) == 0
    assert commands.main(["train", *common, "--rounds", "60", "--least-rows", "300", "--validation-rows", "100", "--promote", "--min-skill", "-1"]) == 0
    assert commands.main(["forecast", *common, "--horizons", "1,2"]) == 0
    tables = sinks.tables(spark, f"{root}/out")
    assert tables["model_evaluations"].read().groupBy("is_baseline").count().orderBy("is_baseline").collect() == [(False, 2), (True, 6)]
    got = tables["forecasts"].read().where("model_name = 'production'").collect()
    assert len(got) == 2 * 2 * 24 and all(abs(r.forecast_value - (100 + r.target_timestamp_utc.hour * 5 + (50 if r.country_code == "DE" else 0))) < 10 for r in got)
    assert {(r.run_type, r.status) for r in tables["forecast_runs"].read().collect()} == {("persistence", "completed"), ("production", "completed")}
    assert spark.read.option("header", True).csv(f"{root}/out/reports/train-20240205_060000").count() == 3
