"""Golden values, worked out by hand from the definitions."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import metrics, scalars
from chronoloom.operators import control, crossval, evaluation, features, joins, shape, windows

T0 = datetime(2024, 1, 1)
Y, P, B = [100.0, 200.0, 300.0, 400.0, 500.0], [110.0, 190.0, 310.0, 380.0, 520.0], [130.0, 170.0, 330.0, 360.0, 560.0]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("a", T0 + timedelta(hours=k), *v) for k, v in enumerate(zip(Y, P, B, strict=True))], "k string, ts timestamp, y double, p double, b double")


def test_core(five):
    r = evaluation.scores(five, ["k"]).first()
    assert (r.mae, r.bias, r.n) == (14.0, 2.0, 5)
    assert r.rmse == pytest.approx(14.832396974191326, abs=1e-12)
    assert r.mape == pytest.approx(5.466666666666667, abs=1e-12)
    assert r.smape == pytest.approx(5.396095386155006, abs=1e-10)
    assert five.agg(metrics.smape_whole()).first()[0] == pytest.approx(5.396095386303594, abs=1e-10)
    assert evaluation.directional(five, ["k"]).first().directional == 100.0
    assert evaluation.scaled_error(five, ["k"]).first().mase is None
    assert five.agg(metrics.skill(metrics.mae(), metrics.mae("y", "b"))).first()[0] == pytest.approx(0.631578947368421)


def test_distribution(five):
    r = evaluation.error_distribution(five, ["k"]).first()
    assert (r.p5, r.p25, r.median, r.p75, r.p95, r.max, r.min) == (-18, -10, 10, 10, 18, 20, -20)
    assert r.std == pytest.approx(14.696938456699069)
    assert r["skew"] == pytest.approx(-0.347767062246994)
    assert r["kurtosis"] == pytest.approx(-1.421810699588477)


def test_quantile_scores(five, spark):
    got = five.agg(*[metrics.pinball(q) for q in (0.1, 0.5, 0.9)]).first()
    assert list(got) == pytest.approx([7.8, 7.0, 6.2])
    rows = [("a", i, q, p, y) for i, (y, p) in enumerate(zip(Y, P, strict=True)) for q, p in ((0.1, y - 20), (0.5, p), (0.9, y + 20))]
    assert evaluation.crps(spark.createDataFrame(rows, "k string, i int, q double, pred double, y double"), ["k"], ["i"]).first().crps == pytest.approx(0.104)


def test_diebold_mariano(five):
    d = five.select("k", "ts", ((F.col("p") - F.col("y")) ** 2).alias("loss_a"), ((F.col("b") - F.col("y")) ** 2).alias("loss_b"))
    assert evaluation.dm_statistic(d, ["k"], 1).first().statistic == pytest.approx(-3.259601202601324)
    assert evaluation.dm_statistic(d, ["k"], 2).first().statistic == pytest.approx(-2.924088893653571)
    r = evaluation.dm_test(d, ["k"], 1).first()
    assert 0.03 < r.p_value < 0.032 and r.stars == "**" and r.better == "first"
    flat = evaluation.dm_test(d.withColumn("loss_b", F.col("loss_a")), ["k"], 1).first()
    assert (flat.statistic, flat.p_value, flat.better) == (0.0, 1.0, "inconclusive")


def test_t_distribution():
    for t, v, p in ((2.0, 10, 0.07338803), (1.0, 1, 0.5), (0.0, 5, 1.0), (12.706, 1, 0.05)):
        assert evaluation._beta_part(v / 2, 0.5, v / (v + t * t)) == pytest.approx(p, abs=2e-5)


def test_peak(spark):
    df = spark.createDataFrame(list(zip(Y, P, [7, 8, 9, 12, 20], strict=True)), "y double, p double, hour int")
    r = df.agg(*[c.alias(n) for n, c in metrics.peak("hour").items()]).first()
    assert (r.peak_mae, r.offpeak_mae) == (pytest.approx(13.333333333333334), 15.0)
    assert r.peak_ratio == pytest.approx(0.888888888888889)


def test_near_zero(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.01, 0.02), (0.001, 0.002), (100.0, 110.0)], "y double, p double")
    r = df.agg(metrics.mae(), metrics.mape(), metrics.mape(floor=1e-8), metrics.smape()).first()
    assert list(r) == pytest.approx([2.52775, 10.0, 77.5, 52.38082904814051], abs=1e-6)
    zero = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "y double, p double").agg(metrics.mape(), metrics.mape_unit(), metrics.mape_plain()).first()
    assert zero[0] is None and zero[1] == 100.0 and zero[2] == 100.0


def series(spark, values):
    return spark.createDataFrame([("a", T0 + timedelta(hours=k), None if v is None else float(v)) for k, v in enumerate(values)], "k string, ts timestamp, y double")


def values(df, column="y"):
    return [r[column] for r in df.orderBy("ts").collect()]


def test_interpolate(spark):
    assert values(shape.interpolate(series(spark, [None, 1, None, 3, None]), ["k"], "y")) == [None, 1.0, 2.0, 3.0, 3.0]
    assert values(shape.interpolate(series(spark, [None, None]), ["k"], "y")) == [None, None]


def test_fills(spark):
    s = series(spark, [None, 1, None, 3, None])
    assert values(shape.forward_fill(s, ["k"], ["y"])) == [None, 1, 1, 3, 3]
    once = shape.fill_both(s, ["k"], ["y"])
    assert values(once) == [1, 1, 1, 3, 3] == values(shape.fill_both(once, ["k"], ["y"]))


def test_trailing(spark):
    got = values(windows.trailing(series(spark, [1, 2, 4, 8]), ["k"], [2]), "y_roll_2h_std")
    assert got == [None, None, pytest.approx(0.7071067811865476), pytest.approx(1.4142135623730951)]


def test_resample(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=m), y) for m, y in ((10, 1.0), (130, 3.0), (70, None))], "k string, ts timestamp, y double")
    assert values(shape.resample(df, ["k"])) == [1.0, 3.0]
    assert shape.regular(shape.resample(df, ["k"]), ["k"]).count() == 3


def test_time_series_split(spark):
    rows = crossval.time_series_split(series(spark, range(10)), ["k"], 3).where("role = 'test'").groupBy("fold").agg(F.sort_array(F.collect_list("y")).alias("y")).orderBy("fold").collect()
    assert [r.y for r in rows] == [[4, 5], [6, 7], [8, 9]]


def test_folds_share_their_boundary(spark):
    days = spark.createDataFrame([("a", T0 + timedelta(days=k), 1.0) for k in range(400)], "k string, ts timestamp, y double")
    folds = crossval.walk_forward_folds(days, ["k"], 2, 30, 2, 180)
    got = crossval.in_folds(days, folds, ["k"]).where("role = 'test'").groupBy("ts").count().where("count > 1").collect()
    assert len(got) == 1
    assert crossval.walk_forward_folds(days.where("ts < '2024-06-01'"), ["k"], 2, 30, 2, 180).count() == 0


def test_holidays():
    assert features.easter(2024).isoformat() == "2024-03-31" and features.easter(2025).isoformat() == "2025-04-20"
    assert features.holidays("XX", range(2024, 2025)) == features.holidays("DE", range(2024, 2025))


def test_bridge_days(spark):
    table = spark.createDataFrame([("X", datetime(2024, 5, 9).date()), ("X", datetime(2024, 4, 30).date())], "country string, holiday date")
    df = spark.createDataFrame([("X", datetime(2024, 5, 10, 3)), ("X", datetime(2024, 4, 29, 3)), ("X", datetime(2024, 5, 8, 3))], "country string, ts timestamp")
    got = [(r.is_holiday, r.days_to_holiday, r.days_from_holiday, r.is_bridge_day) for r in features.holiday_features(df, table).orderBy("ts").collect()]
    assert got == [(0, 1, 7, 1), (0, 1, 7, 0), (0, 7, 1, 1)]


def test_mixed_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01T01:00:00+01:00",), ("x",)], "t string")
    assert [r[0] for r in df.select(scalars.parse_timestamp(F.col("t"))).collect()] == [T0, T0, None]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = control.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, control.upsert(once, new, ["id"]).collect()))


def test_rollback_needs_a_previous_version(spark):
    t = spark.createDataFrame([("a", 1, "x", "active", None)], "k string, version int, at string, status string, previous_version int")
    assert control.rollback(t, ["k"]).first().status == "active"
    new = spark.createDataFrame([("a", 2, "y")], "k string, version int, at string")
    both = control.deploy(t, new, ["k"])
    assert {(r.version, r.status, r.previous_version) for r in both.collect()} == {(1, "inactive", None), (2, "active", 1)}
    assert {(r.version, r.status) for r in control.rollback(both, ["k"]).collect()} == {(1, "active"), (2, "rolled_back")}


def test_equal_skill_is_not_promoted(spark):
    both = spark.createDataFrame([("a", 0.2, 0.2), ("b", 0.2, None), ("c", 0.0, None), ("d", 0.3, 0.2)], "k string, candidate_skill double, production_skill double")
    assert {r.k: r.reason for r in control.promote(both, ["k"]).collect()} == {"a": "not_better", "b": "first_deployment", "c": "below_minimum", "d": "improved"}


def test_row_and_time_lags_differ_at_gaps(spark):
    s = series(spark, range(60)).where("hour(ts) <> 5")
    by_rows = values(windows.lags(s, ["k"], [1]), "y_lag_1d")
    by_time = values(joins.offset_lookup(s, ["k"], 24, "p"), "p")
    assert by_rows != by_time and math.isclose(by_time[-1], 35)


def test_partitions_do_not_matter(spark):
    s = series(spark, range(100))
    one, many = (evaluation.scores(joins.offset_lookup(s.repartition(n), ["k"], 24, "p"), ["k"]).first() for n in (1, 8))
    assert list(one)[1:] == pytest.approx(list(many)[1:])
