"""Trailing statistics and means against exact arithmetic, from the smallest to the largest magnitudes."""

import math
import random
import statistics
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import metrics
from chronoloom.operators import windows

T0 = datetime(2024, 1, 1)
WIDTHS = [1, 2, 5, 24]


def drawn(name):
    r = random.Random(name)
    near = lambda centre, spread, n=70: [centre + spread * r.gauss(0, 1) for _ in range(n)]
    return {
        "1e9 +- 1": near(1e9, 1), "1e6 +- 0.01": near(1e6, 0.01), "5e4 +- 0.001": near(5e4, 0.001), "1e-7": near(1e-7, 3e-8), "1e-100": near(1e-100, 1e-102), "1e13 +- 1": near(1e13, 1), "1e150": near(1e150, 1e140),
        "jumps": near(1e13, 1, 20) + near(1e-7, 1e-9, 30) + near(-5e6, 1e-3, 20), "constant": [123456789.123] * 40,
        "gaps": [None if k % 7 == 3 else float("nan") if k % 11 == 5 else v for k, v in enumerate(near(1e9, 1e-2))], "long gap": near(3.0, 1.0, 10) + [None] * 60 + near(1e8, 1e-4, 10),
    }[name]


NAMES = ["1e9 +- 1", "1e6 +- 0.01", "5e4 +- 0.001", "1e-7", "1e-100", "1e13 +- 1", "1e150", "jumps", "constant", "gaps", "long gap"]


def exact(window):
    have = [Fraction(v) for v in window if v is not None and not math.isnan(v)]
    if not have:
        return None, None, None, None
    mean = sum(have) / len(have)
    spread = sum((v - mean) ** 2 for v in have)
    std = None
    if len(have) > 1:  # by whole roots, as floats would lose what is to be shown
        q = spread / (len(have) - 1)
        scale = 10**700
        std = float(Fraction(math.isqrt(int(q * scale * scale)), scale))
    return float(mean), std, float(min(have)), float(max(have))


@pytest.fixture(scope="module")
def all_series(spark):
    rows = [(name, T0 + timedelta(hours=k), v) for name in NAMES for k, v in enumerate(drawn(name))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, y double").repartition(7)
    before = windows.trailing(df, ["k"], WIDTHS)
    return {(r.k, r.ts): r for r in windows.trailing_inclusive(before.withColumn("z", F.col("y")), ["k"], WIDTHS, y="z", stats=windows.STATS).collect()}


@pytest.mark.parametrize("name", NAMES)
def test_trailing_at_every_magnitude(all_series, name):
    y = drawn(name)
    for k in range(len(y)):
        row = all_series[name, T0 + timedelta(hours=k)]
        for w in WIDTHS:
            for column, window, none in ((f"y_roll_{w}h", y[max(0, k - w) : k], None), (f"z_roll_{w}h", y[max(0, k - w + 1) : k + 1], 0.0)):
                mean, std, low, high = exact(window)
                assert (row[f"{column}_min"], row[f"{column}_max"]) == (low, high)
                assert row[f"{column}_mean"] == (None if mean is None else pytest.approx(mean, rel=1e-14, abs=0)), (w, k)
                assert row[f"{column}_std"] == (none if std is None else pytest.approx(std, rel=1e-11, abs=0)), (w, k)


def test_exact_is_right():
    assert exact([1.0, 2.0, 4.0])[1] == pytest.approx(statistics.stdev([1.0, 2.0, 4.0]), rel=1e-15)


@pytest.mark.parametrize("size", [1e-140, 1e-12, 1.0, 1e20, 1e150])
def test_means_at_every_magnitude(spark, size):
    r = random.Random(3)
    e = [size * r.gauss(1, 1) for _ in range(500)]
    df = spark.createDataFrame([(0.0, v) for v in e] + [(float("nan"), 1.0), (None, 1.0), (1.0, float("nan"))], "y double, p double").repartition(5)
    got = df.agg(*[c.alias(n) for n, c in metrics.bundle().items()]).first()
    assert got.n == 500
    assert got.mae == pytest.approx(float(sum(abs(Fraction(v)) for v in e) / 500), rel=1e-13, abs=0)
    assert got.bias == pytest.approx(float(sum(map(Fraction, e)) / 500), rel=1e-12, abs=0)
    assert got.rmse == pytest.approx(math.sqrt(sum(Fraction(v) ** 2 for v in e) / 500), rel=1e-13, abs=0)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0.0, float("nan")), (0.0, 1.0)], "y double, p double")
    assert df.agg(metrics.mae(), metrics.rmse(), metrics.bias(), metrics.smape()).first()[:3] == (1.0, 1.0, 1.0)
