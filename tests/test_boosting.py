"""The learner against a brute-force tree, and many series in one job."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import boosting, crossval

T0 = datetime(2024, 1, 1)
PLAIN = {"rounds": 1, "rate": 1.0, "leaves": 4, "depth": 9, "least": 2, "penalty": 0.5, "rows": 1.0, "columns": 1.0}


def brute(x, y, leaves, least, penalty):
    """The tree that at each step splits the leaf where the error falls most, over all splits of all columns; as a function of rows."""
    parts, score = [np.arange(len(y))], lambda at: y[at].sum() ** 2 / (len(at) + penalty)
    rules = [[]]
    while len(parts) < leaves:
        best = None
        for k, at in enumerate(parts):
            for c in range(x.shape[1]):
                v = np.unique(x[at, c])
                for cut in (v[:-1] + v[1:]) / 2:
                    low, high = at[x[at, c] <= cut], at[x[at, c] > cut]
                    if min(len(low), len(high)) >= least:
                        gain = score(low) + score(high) - score(at)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, k, c, cut, low, high)
        if best is None:
            break
        _, k, c, cut, low, high = best
        parts[k : k + 1] = [low, high]
        rules[k : k + 1] = [[*rules[k], (c, cut, True)], [*rules[k], (c, cut, False)]]
    out = np.empty(len(y))
    for at in parts:
        out[at] = y[at].sum() / (len(at) + penalty)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_a_tree_is_the_brute_force_one(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.standard_normal((40, 3)), 1)
    y = np.where(x[:, 0] > 0.2, 3.0, -1.0) * x[:, 1] + 0.1 * r.standard_normal(40)
    m = boosting.fit(x, y, None, PLAIN)
    want = brute(x, y - y.mean(), 4, 2, 0.5)
    assert np.allclose(boosting.predict(x, m) - y.mean(), want)


def test_missing_values_go_right():
    x = np.array([[0.0], [1.0], [np.nan], [np.nan]] * 5)
    y = np.array([0.0, 5.0, 5.0, 5.0] * 5)
    m = boosting.fit(x, y, None, PLAIN | {"penalty": 0.0})
    assert np.allclose(boosting.predict(x, m), y)


def test_early_stopping_keeps_the_best_round():
    r = np.random.default_rng(0)
    x, z = r.standard_normal((300, 4)), r.standard_normal((200, 4))
    y, w = x[:, 0] + 2 * r.standard_normal(300), z[:, 0] + 2 * r.standard_normal(200)
    p = boosting.PRESETS["xgboost"]
    m = boosting.fit(x, y, (z, w), p, patience=20)
    losses = [np.abs(boosting.predict(z, boosting.fit(x, y, None, p | {"rounds": k})) - w).mean() for k in range(1, len(m["begin"]) + 15)]
    assert len(m["begin"]) == int(np.argmin(losses)) + 1 and m["loss"] == pytest.approx(min(losses))
    assert m["gain"].argmax() == 0


def test_constants_and_no_columns():
    assert boosting.predict(np.zeros((3, 1)), boosting.fit(np.zeros((3, 1)), np.full(3, 7.0), None, PLAIN)).tolist() == [7.0] * 3
    assert boosting.predict(np.zeros((2, 0)), boosting.fit(np.zeros((2, 0)), np.array([1.0, 3.0]), None, PLAIN)).tolist() == [2.0] * 2


@pytest.fixture(scope="module")
def many(spark):
    """100 series of 240 hours, each with a slope of its own."""
    rows = spark.range(100 * 240).select(F.floor(F.col("id") / 240).cast("int").alias("k"), (F.lit(T0) + F.make_dt_interval(hours=(F.col("id") % 240).cast("int"))).alias("ts"))
    x = F.pmod(F.xxhash64("k", "ts"), F.lit(1000)) / 1000
    return rows.withColumn("x", x).withColumn("z", F.pmod(F.xxhash64("ts"), F.lit(7))).withColumn("y", F.col("k") * F.col("x") + F.when(F.hour("ts") < 6, 5.0).otherwise(0.0)).withColumn("hour", F.hour("ts")).repartition(6).cache()


def test_a_hundred_series_and_six_folds_in_one_job(spark, many):
    folds = crossval.walk_forward_folds(many, ["k"], folds=6, test_days=1, gap_days=0, least_days=2)
    rows = crossval.in_folds(many, folds, ["k"])
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    models = boosting.fit_all(rows.where("role = 'train'"), ["k", "fold"], ["x", "hour", "z"], trials=[{"rounds": 20}])
    got = models.select("k", "fold", "n").collect()
    assert len(got) == 600
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert len(jobs) < 20  # the stages of one query, each a job with adaptive execution, and not a job for each of 600 models
    want = {(r.k, r.fold): r.n for r in rows.where("role = 'train'").groupBy("k", "fold").agg(F.count("*").alias("n")).collect()}
    assert {(r.k, r.fold): r.n for r in got} == want
    scored = boosting.out_of_fold(rows, ["k"], ["x", "hour", "z"], trials=[{"rounds": 60}])
    loss = scored.agg(F.avg(F.abs(F.col("p") - F.col("y"))), F.count("*")).first()
    assert loss[0] < 2.5 and loss[1] == rows.where("role = 'test'").count()


def test_models_do_not_depend_on_partitions(many):
    few = many.where("k < 3")
    a = boosting.fit_all(few, ["k"], ["x", "hour"], trials=[{"rounds": 5}]).orderBy("k").collect()
    b = boosting.fit_all(few.repartition(11), ["k"], ["x", "hour"], trials=[{"rounds": 5}]).orderBy("k").collect()
    assert a == b


def test_trials_with_their_own_columns(many):
    few = many.where("k in (40, 41)").withColumn("late", F.col("ts") >= F.lit("2024-01-09").cast("timestamp"))
    models = boosting.fit_all(few, ["k"], [["x", "hour"], ["z"]], trials=[{"rounds": 50}] * 2, check="late")
    loss = {(r.k, r.trial): r.loss for r in models.collect()}
    assert len(loss) == 4 and all(loss[k, 0] < loss[k, 1] / 3 for k in (40, 41))
    scored = boosting.predict_all(few.where("late"), models, ["k"], [["x", "hour"], ["z"]])
    for r in scored.groupBy("k", "trial").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).collect():
        assert r.mae == pytest.approx(loss[r.k, r.trial])
    top = boosting.importance(models.where("trial = 0"), ["k"], ["x", "hour"]).where("place = 1").collect()
    assert [r.feature for r in top] == ["x", "x"]


def test_groups_without_rows_or_models(spark, many):
    none = many.where("k = 1").withColumn("y", F.lit(None).cast("double"))
    assert boosting.fit_all(none, ["k"], ["x"]).count() == 0
    got = boosting.predict_all(many.where("k < 2"), boosting.fit_all(many.where("k = 0"), ["k"], ["x"], trials=[{"rounds": 2}]), ["k"], ["x"])
    assert got.groupBy("k").agg(F.count("p").alias("n")).orderBy("k").collect() == [(0, 240), (1, 0)]
    with pytest.raises(ValueError, match="algorithm"):
        boosting.fit_all(none, ["k"], ["x"], algorithm="none")


def test_rows_in_any_order_with_nulls(spark):
    r = random.Random(2)
    rows = [("a", T0 + timedelta(hours=k), r.random() if k % 5 else None, float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double, y double")
    assert boosting.fit_all(df, ["k"], ["x"], trials=[{"rounds": 3}]).first().n == 60
