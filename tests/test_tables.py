"""Versioned tables, exports and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import crossval, features, jobs, models, validation
from chronoloom.sources import series, sinks
from chronoloom.streaming import hourly

T0 = datetime(2024, 1, 1)


def forecasts(spark, values, kind="load"):
    return spark.createDataFrame([("DE", kind, T0 + timedelta(hours=k), T0, 24, v, "m") for k, v in enumerate(values)], "country_code string, forecast_type string, target_timestamp_utc timestamp, generated_at timestamp, horizon_hours int, forecast_value double, model_name string")


def test_save_forecasts(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "forecasts"), sinks.FORECASTS)
    assert t.read().count() == 0
    sinks.save_forecasts(t, forecasts(spark, [1.0, 2.0]))
    sinks.save_forecasts(t, forecasts(spark, [1.0, 3.0]))
    sinks.save_forecasts(t, forecasts(spark, [0.0, 0.0], "price"))  # zero throughout: kept out
    assert [r.forecast_value for r in t.read().orderBy("target_timestamp_utc").collect()] == [1.0, 3.0]
    assert [r.forecast_value for r in t.read(1).orderBy("target_timestamp_utc").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError, match="model_name"):
        sinks.save_forecasts(t, forecasts(spark, [1.0]).drop("model_name"))


def test_upserts_touch_only_their_partitions(spark, tmp_path):
    t = sinks.tables(spark, str(tmp_path))["forecasts"]
    assert t.version() == 1 and t.read().count() == 0
    sinks.save_forecasts(t, forecasts(spark, [1.0, 2.0]).unionByName(forecasts(spark, [5.0], "solar")))
    first = {f["path"] for f in t._folders(2)}
    sinks.save_forecasts(t, forecasts(spark, [4.0], "solar"))
    assert len(first) == 2 and len(first & {f["path"] for f in t._folders(3)}) == 1
    assert sorted(r.forecast_value for r in t.read().collect()) == [1.0, 2.0, 4.0]
    assert sorted(r.forecast_value for r in t.read(2).collect()) == [1.0, 2.0, 5.0]
    t.keep(1)
    assert t.versions() == [3] and t.read().count() == 3
    with pytest.raises(ValueError, match="forecast_type"):
        t.upsert(forecasts(spark, [1.0]), ["country_code"])


def test_a_crash_before_the_version_is_named_leaves_the_one_before(spark, tmp_path, monkeypatch):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), sinks.FORECASTS)
    sinks.save_forecasts(t, forecasts(spark, [1.0]))
    with monkeypatch.context() as m:
        m.setattr(sinks.VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sinks.save_forecasts(t, forecasts(spark, [2.0]))
    assert t.version() == 1 and [r.forecast_value for r in t.read().collect()] == [1.0]
    sinks.save_forecasts(t, forecasts(spark, [3.0]))
    assert [r.forecast_value for r in t.read().collect()] == [3.0]
    with pytest.raises(RuntimeError, match="there already"):
        t._commit(2, [])


def test_evaluations(spark, tmp_path):
    t = sinks.tables(spark, str(tmp_path))["model_evaluations"]
    row = spark.createDataFrame([("DE", "load", "v1", "2024-01-01", 2.0)], "country_code string, forecast_type string, model_version string, evaluation_date string, mae double")
    sinks.save_evaluation(t, row)
    sinks.save_evaluation(t, row.withColumn("mae", F.lit(1.0)))
    assert [r.mae for r in t.read().collect()] == [1.0]
    with pytest.raises(ValueError, match="mae"):
        sinks.save_evaluation(t, row.drop("mae"))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 5.0), ("b", 2000.0), ("c", None)], "k string, mape double")
    sinks.to_json(df, str(tmp_path / "j"), "mape")
    assert {r.k: r.mape_reliable for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a": True, "b": False, "c": True}
    sinks.to_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    assert sinks.markdown(df.where("k = 'a'")).endswith("| a | 5.0000 |")
    with pytest.raises(ValueError):
        sinks.markdown(df, most=2)


def test_domain_scans(spark, tmp_path):
    root = str(tmp_path)
    rows = [("DE", T0 + timedelta(minutes=15 * k), float(k), "actual" if k % 2 else "forecast") for k in range(8)]
    spark.createDataFrame(rows, "country_code string, timestamp_utc timestamp, load_mw double, data_quality string").write.parquet(f"{root}/energy_load.parquet")
    got = series.energy(spark, root, "load", "DE", "2024-01-01", "2024-01-01 01:00:00")
    assert sorted(r.y for r in got.collect()) == [1.0, 3.0]
    ren = [("DE", T0, 1.0, 2.0, None, "estimated"), ("DE", T0 + timedelta(hours=1), 1.0, 2.0, 3.0, "estimated")]
    cols = "country_code string, timestamp_utc timestamp, solar_mw double, hydro_run_mw double, hydro_reservoir_mw double, data_quality string"
    spark.createDataFrame(ren, cols).write.parquet(f"{root}/energy_renewable.parquet")
    assert [r.y for r in series.energy(spark, root, "hydro_total").orderBy("ts").collect()] == [None, 5.0]
    with pytest.raises(ValueError, match="no series type"):
        series.energy(spark, root, "coal")


def test_zone_mean_divides_by_the_weights_there(spark):
    zones = spark.createDataFrame([(1, 0.3), (2, 0.1)], "zone int, weight double")
    points = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, None), ("b", 2, 20.0)], "t string, zone int, v double")
    got = {r.t: (r.v, r.n_points) for r in series.zone_mean(points, zones, ["t"], ["zone"], "v").collect()}
    assert got == {"a": (pytest.approx(12.5), 2), "b": (20.0, 1)}


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    df = spark.createDataFrame([(k, "a", T0 + timedelta(minutes=20 * k), float(k)) for k in range(30)], "id long, k string, ts timestamp, y double")
    df.write.parquet(src)
    hours = hourly.hourly_mean(hourly.events(spark, src, df.schema), ["k"])
    table = sinks.VersionedTable(spark, out, hours.schema)
    for _ in range(2):
        hourly.upserted(hours, table, ["k", "ts"], str(tmp_path / "ck")).awaitTermination()
    got = {r.ts: r.y for r in table.read().collect()}
    want = {r.ts: r.y for r in df.groupBy("k", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("y").alias("y")).collect()}
    assert got and all(want[t] == y for t, y in got.items())


def test_model(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(hours=k), float(k % 24), float(3 * (k % 24))) for k in range(300)], "ts timestamp, x double, y double")
    model, score = models.train(df, ["x"], 48, params={"maxIter": 5, "maxDepth": 4})
    assert score.first().mae < 5
    model.save(str(tmp_path / "m"))
    again = models.Forecaster(["x"]).load(str(tmp_path / "m"))
    assert again.predict(df.limit(5)).collect() == model.predict(df.limit(5)).collect()
    with pytest.raises(ValueError):
        models.Forecaster(["x"], algorithm="other")


def test_models_are_trained_fold_by_fold(spark):
    rows = [(k, T0 + timedelta(hours=h), float(h % 24), float((3 if k == "a" else 5) * (h % 24))) for k in "ab" for h in range(24 * 20)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double, y double")
    folds = crossval.walk_forward_folds(df, ["k"], folds=2, test_days=3, gap_days=1, least_days=8)
    got = validation.trained(df, folds, ["k"], lambda: models.Forecaster(["x"], params={"maxIter": 5, "maxDepth": 5})).withColumn("base", F.col("y") + 10).cache()
    each = validation.by_fold(got, ["k"], "base").collect()
    assert sorted((r.k, r.fold) for r in each) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)] and all(r.mae < 5 and r.skill > 0.5 for r in each)
    assert {r.k: r.folds for r in validation.summary(got, ["k"], "base").collect()} == {"a": 2, "b": 2}
    none = validation.trained(df, folds.where("false"), ["k"], lambda: None)
    assert none.count() == 0 and "p" in none.columns


def test_searches(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=h), float(h % 24), float(3 * (h % 24))) for h in range(200)], "ts timestamp, x double, y double")
    best, loss = models.random_search(df, ["x"], {"maxDepth": [1, 5], "maxIter": [2]}, trials=2, folds=2, seed=1)
    assert best["maxDepth"] in (1, 5) and loss >= 0
    assert {n for n, _ in models.compare_algorithms(df, ["x"], 2, {"maxIter": 2, "maxDepth": 2})} == set(models.PRESETS)


def test_model_columns_come_in_a_fixed_order():
    assert features.model_columns(["y_roll_24h_mean", "hour", "x", "y_lag_1d", "is_holiday"]) == ["hour", "is_holiday", "y_lag_1d", "y_roll_24h_mean", "x"]


def test_daily_job_with_models(spark):
    rows = [(c, "load", T0 + timedelta(hours=h), float(h % 24 + (5 if c == "DE" else 0))) for c in ("BE", "DE") for h in range(24 * 25)]
    history = spark.createDataFrame(rows, "country_code string, forecast_type string, ts timestamp, y double")
    work = spark.createDataFrame([(c, "load", d) for c in ("BE", "DE") for d in (1, 2)], "country_code string, forecast_type string, horizon int")
    run = lambda h, w: jobs.boosted(h, w, params={"maxIter": 5, "maxDepth": 5})
    got = jobs.forecasts(history, work, {"boosted": run, "persistence": jobs.persistence}, "2024-01-22 06:00:00").collect()
    assert len(got) == 2 * 2 * 24 * 2
    assert all(abs(r.forecast_value - (r.target_timestamp_utc.hour + (5 if r.country_code == "DE" else 0))) < 3 for r in got)
    assert {r.horizon_hours for r in got} == set(range(18, 66))
