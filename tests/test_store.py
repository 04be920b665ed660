"""The model store, holidays by law and year, sketches of quantiles."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import boosting, evaluation, features
from chronoloom.sources import sinks
from chronoloom.sources.store import KEEP, ModelStore

T0 = datetime(2024, 1, 1)


def models(spark, value, series=(("BE", "load"), ("DE", "load"))):
    return spark.createDataFrame([(c, t, value, [1, 2]) for c, t in series], "country_code string, forecast_type string, base double, at_ array<int>")


def series(spark, *rows):
    return spark.createDataFrame(list(rows), "country_code string, forecast_type string")


def held(store, location):
    return {(r.country_code, r.base, r.version) for r in store.load(location, None).collect()}


def test_store(spark, tmp_path):
    s = ModelStore(spark, str(tmp_path / "models"))
    assert s.exists().count() == 0
    s.save(models(spark, 1.0), "v1", "2024-01-01")
    assert held(s, "candidate") == {("BE", 1.0, "v1"), ("DE", 1.0, "v1")} and s.load().count() == 0
    s.promote(series(spark, ("BE", "load"), ("FR", "load")))
    assert held(s, "production") == {("BE", 1.0, "v1")} and held(s, "candidate") == {("DE", 1.0, "v1")}
    s.save(models(spark, 2.0), "v2", "2024-01-02")
    s.promote(series(spark, ("BE", "load"), ("DE", "load")))
    assert held(s, "production") == {("BE", 2.0, "v2"), ("DE", 2.0, "v2")} and held(s, "history") == {("BE", 1.0, "v1")}
    s.rollback(series(spark, ("BE", "load"), ("DE", "load")))  # DE has no history
    assert held(s, "production") == {("BE", 1.0, "v1"), ("DE", 2.0, "v2")} and held(s, "history") == {("BE", 2.0, "v2")}
    s.save(models(spark, 9.0, (("FR", "load"),)), "old", "2020-01-01", "legacy")
    assert {(r.country_code, r.location) for r in s.load().collect()} == {("BE", "production"), ("DE", "production"), ("FR", "legacy")}
    with pytest.raises(ValueError, match="location"):
        s.save(models(spark, 1.0), "v", "2024-01-01", "history")


def test_history_keeps_five_and_the_rest_is_collected(spark, tmp_path):
    s = ModelStore(spark, str(tmp_path / "models"))
    for k in range(KEEP + 3):
        s.save(models(spark, float(k), (("BE", "load"),)), f"v{k}", f"2024-01-0{k + 1}")
        s.promote(series(spark, ("BE", "load")))
    assert {v for _, _, v in held(s, "history")} == {f"v{k}" for k in range(2, KEEP + 2)}
    assert s.collect() == 2 and s.collect() == 0
    assert {v for _, _, v in held(s, "history")} == {f"v{k}" for k in range(2, KEEP + 2)} and held(s, "production") == {("BE", KEEP + 2.0, f"v{KEEP + 2}")}
    s.rollback(spark.createDataFrame([("BE", "load", "v3")], "country_code string, forecast_type string, version string"))
    assert held(s, "production") == {("BE", 3.0, "v3")}
    s.rollback(spark.createDataFrame([("BE", "load", "v0")], "country_code string, forecast_type string, version string"))  # is gone
    assert held(s, "production") == {("BE", 3.0, "v3")}


def test_a_crash_between_content_and_state(spark, tmp_path, monkeypatch):
    s = ModelStore(spark, str(tmp_path / "models"))
    s.save(models(spark, 1.0), "v1", "2024-01-01", "production")
    with monkeypatch.context() as m:
        m.setattr(sinks.VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.save(models(spark, 2.0), "v2", "2024-01-02", "production")
    assert held(s, "production") == {("BE", 1.0, "v1"), ("DE", 1.0, "v1")}
    s.save(models(spark, 3.0), "v3", "2024-01-03")
    assert s.collect() == 2  # what the crash left
    assert held(s, "production") == {("BE", 1.0, "v1"), ("DE", 1.0, "v1")} and held(s, "candidate") == {("BE", 3.0, "v3"), ("DE", 3.0, "v3")}
    s.save(models(spark, 1.0), "v4", "2024-01-04")  # the same model again: one folder, loaded once
    assert s.load("candidate", None).count() == 2


def test_trained_models_are_stored_and_predict_the_same(spark, tmp_path):
    r = random.Random(1)
    df = spark.createDataFrame([(c, "load", T0 + timedelta(hours=h), float(h % 24), h % 24 + r.random()) for c in ("BE", "DE") for h in range(200)], "country_code string, forecast_type string, ts timestamp, x double, y double")
    keys = ["country_code", "forecast_type"]
    found = boosting.fit_all(df, keys, ["x"], trials=[{"rounds": 5}])
    s = ModelStore(spark, str(tmp_path / "models"))
    s.save(found, "v1", "2024-01-01", "production")
    again = s.load().drop("version", "location")
    a = boosting.predict_all(df, found, keys, ["x"]).orderBy(*keys, "ts").collect()
    assert a == boosting.predict_all(df, again.select(*found.columns), keys, ["x"]).orderBy(*keys, "ts").collect()


@pytest.mark.parametrize(
    ("country", "day", "kept"),
    [
        ("NL", date(2025, 4, 26), True), ("NL", date(2025, 4, 27), False), ("NL", date(2024, 4, 27), True), ("NL", date(2025, 5, 5), True), ("NL", date(2024, 5, 5), False),
        ("PL", date(2024, 12, 24), False), ("PL", date(2025, 12, 24), True), ("RO", date(2023, 1, 6), False), ("RO", date(2024, 1, 6), True), ("RO", date(2024, 1, 7), True),
        ("HR", date(2019, 6, 25), True), ("HR", date(2020, 6, 25), False), ("HR", date(2019, 5, 30), False), ("HR", date(2020, 5, 30), True), ("HR", date(2019, 10, 8), True),
        ("BG", date(2024, 3, 4), True), ("BG", date(2022, 12, 27), True), ("BG", date(2022, 12, 28), True), ("BG", date(2023, 12, 27), True), ("BG", date(2024, 12, 27), False), ("LV", date(2024, 5, 6), True), ("LV", date(2023, 11, 20), True),
        ("SK", date(2023, 9, 1), True), ("SK", date(2024, 9, 1), False), ("CZ", date(2015, 4, 3), False), ("CZ", date(2016, 3, 25), True), ("DE", date(2017, 10, 31), True), ("DE", date(2018, 10, 31), False),
        ("PT", date(2014, 11, 1), False), ("PT", date(2016, 11, 1), True), ("SI", date(2015, 1, 2), False), ("SI", date(2018, 1, 2), True), ("LV", date(2024, 5, 12), True), ("xx", date(2024, 10, 3), True),
    ],
)
def test_holidays_by_year(country, day, kept):
    assert (day in features.holidays(country, range(day.year, day.year + 1))) == kept


def test_sketches_of_days_add_up(spark):
    r = random.Random(2)
    e = [r.gauss(0, 1) ** 3 for _ in range(40_000)]
    df = spark.createDataFrame([("a", k % 365, 0.0, v) for k, v in enumerate(e)] + [("a", 1, 0.0, float("nan")), ("a", 2, None, 1.0)], "k string, day int, y double, p double").repartition(6)
    parts = evaluation.error_sketches(df, ["k", "day"])
    months = parts.withColumn("month", F.floor(F.col("day") / 30)).groupBy("k", "month").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", evaluation.SKETCH).alias("sketch"))
    order = sorted(e)
    for sketches in (parts, months):
        for x in evaluation.error_quantiles(sketches, ["k"], (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)).collect():
            rank = sum(v <= x.value for v in order) / len(order)
            assert x.n == 40_000 and abs(rank - x.q) <= evaluation.RANK_ERROR
    assert parts.selectExpr("max(length(sketch))").first()[0] < 20_000
