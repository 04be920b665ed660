"""Forecasting models on `pyspark.ml` gradient-boosted trees: training, search, cascades, residual correction, feature elimination.

Series of one job are trained one after the other, each on the whole cluster; membership in folds comes from `crossval`. Trees depend on how rows lie in
partitions, so training rows are first sorted into a fixed layout.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from . import crossval, windows

#: Presets in place of the three tree libraries' defaults.
PRESETS: dict[str, dict] = {
    "xgboost": {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8},
    "lightgbm": {"maxIter": 30, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "catboost": {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0},
}


@dataclass
class Forecaster:
    """A regressor for one series: `fit`, `predict`, `importance`, `save` and `load`. Rows are laid in `partitions`; set more for a long series."""

    features: list[str]
    target: str = "y"
    algorithm: str = "xgboost"
    params: dict = field(default_factory=dict)
    partitions: int = 8
    model: GBTRegressionModel | None = None

    def __post_init__(self) -> None:
        if self.algorithm not in PRESETS:
            raise ValueError(f"algorithm: one of {', '.join(PRESETS)}")

    def _rows(self, df: DataFrame) -> DataFrame:
        filled = df.fillna(0.0, self.features)
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(filled)

    def fit(self, df: DataFrame, order: str = "ts", rounds: int | None = None) -> Forecaster:
        rows = self._rows(df.where(F.col(self.target).isNotNull())).select("features", self.target, order)
        laid = rows.repartitionByRange(self.partitions, order).sortWithinPartitions(order).cache()
        params = PRESETS[self.algorithm] | self.params | ({"maxIter": rounds} if rounds else {})
        self.model = GBTRegressor(featuresCol="features", labelCol=self.target, predictionCol="p", seed=42, **params).fit(laid)
        laid.unpersist()
        return self

    def fit_early(self, train: DataFrame, validation: DataFrame, order: str = "ts") -> Forecaster:
        """Fitted with as many trees as do best on the validation rows."""
        self.fit(train, order)
        losses = self.model.evaluateEachIteration(self._rows(validation), "absolute")
        best = min(range(len(losses)), key=losses.__getitem__) + 1
        return self if best == len(losses) else self.fit(train, order, rounds=best)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._rows(df)).drop("features")

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Forecaster:
        self.model = GBTRegressionModel.load(path)
        return self


def train(df: DataFrame, features: list[str], validation_rows: int = 720, algorithm: str = "xgboost", params: dict | None = None, ts: str = "ts") -> tuple[Forecaster, DataFrame]:
    """A model of one series with early stopping on its last rows, and its metrics there."""
    rows = windows.tail_split(df.withColumn("__s", F.lit(1)), ["__s"], validation_rows, ts).cache()
    fit, check = rows.where("not is_validation"), rows.where("is_validation")
    model = Forecaster(features, algorithm=algorithm, params=params or {})
    model = model.fit(fit, ts) if check.isEmpty() else model.fit_early(fit, check, ts)
    return model, model.predict(check).agg(*[c.alias(n) for n, c in metrics.bundle().items()])


def cross_validated(df: DataFrame, features: list[str], folds: int, make: Callable[[], Forecaster], ts: str = "ts") -> DataFrame:
    """Rows of all test folds with their out-of-fold forecasts `p`; each fold is trained on what is before it."""
    rows = crossval.time_series_split(df.withColumn("__s", F.lit(1)), ["__s"], folds, ts).drop("__s").cache()
    out = None
    for k in range(1, folds + 1):
        part = rows.where(F.col("fold") == k)
        got = make().fit(part.where("role = 'train'"), ts).predict(part.where("role = 'test'"))
        out = got if out is None else out.unionByName(got)
    return out


def grid_search(df: DataFrame, features: list[str], grid: list[dict], folds: int = 3, algorithm: str = "xgboost", ts: str = "ts") -> tuple[dict, float]:
    """The parameters of `grid` with the least mean absolute error over expanding folds."""
    best: tuple[float, dict] | None = None
    for params in grid:
        got = cross_validated(df, features, folds, lambda p=params: Forecaster(features, algorithm=algorithm, params=p), ts)
        loss = got.groupBy("fold").agg(metrics.mae().alias("mae")).agg(F.avg("mae")).first()[0]
        if best is None or loss < best[0]:
            best = (loss, params)
    return best[1], best[0]


def random_search(df: DataFrame, features: list[str], space: dict[str, list], trials: int, folds: int = 3, algorithm: str = "xgboost", seed: int = 42, ts: str = "ts") -> tuple[dict, float]:
    """Seeded random draws from `space`, scored as by `grid_search`."""
    r = random.Random(seed)
    return grid_search(df, features, [{k: r.choice(v) for k, v in sorted(space.items())} for _ in range(trials)], folds, algorithm, ts)


def compare_algorithms(df: DataFrame, features: list[str], folds: int = 3, params: dict | None = None, ts: str = "ts") -> list[tuple[str, float]]:
    """(algorithm, mean absolute error over expanding folds), the best first."""
    return sorted(((name, grid_search(df, features, [params or {}], folds, name, ts)[1]) for name in PRESETS), key=lambda x: x[1])


def cascade(df: DataFrame, features: list[str], stages: list[str], target: str = "y", folds: int = 5, params: dict | None = None, ts: str = "ts") -> tuple[Forecaster, DataFrame]:
    """Out-of-fold forecasts of the `stages` columns (the full model's for the first block), their difference, and a model of the target on all of them."""
    df = out = df.cache()
    for stage in stages:
        make = lambda s=stage: Forecaster(features, target=s, params=params or {})
        oof = cross_validated(df, features, folds, make, ts).select(ts, F.col("p").alias("__oof"))
        full = make().fit(df, ts).predict(df).select(ts, F.col("p").alias("__full"))
        out = out.join(oof, ts, "left").join(full, ts).withColumn(f"cascade_{stage}", F.coalesce("__oof", "__full")).drop("__oof", "__full")
    extra = [f"cascade_{s}" for s in stages]
    if len(stages) > 1:
        out = out.withColumn("cascade_residual", F.col(extra[0]) - F.col(extra[1]))
        extra.append("cascade_residual")
    out = out.cache()
    return Forecaster([*features, *extra], target=target, params=params or {}).fit(out, ts), out


def correction(df: DataFrame, features: list[str], split: str, tso: str = "tso", ts: str = "ts") -> DataFrame:
    """Rows from `split` on with corrected = forecast + the error that a model of earlier errors foresees, 0 at least."""
    model = Forecaster(features, target="err").fit(df.where(F.col(ts) < F.lit(split).cast("timestamp")).dropna(subset=features), ts)
    got = model.predict(df.where(F.col(ts) >= F.lit(split).cast("timestamp")))
    return got.withColumn("corrected", F.greatest(F.lit(0.0), F.col(tso) + F.col("p")))


def eliminate(df: DataFrame, features: list[str], rounds: int = 5, share: float = 0.1, patience: int = 3, least: int = 5, folds: int = 3, params: dict | None = None, ts: str = "ts") -> list[tuple[int, int, float, str]]:
    """Backward elimination: (round, features, mean absolute error, dropped), dropping the least important tenth each round."""
    now, best, bad, log = list(features), float("inf"), 0, []
    for k in range(rounds):
        loss = grid_search(df, now, [params or {}], folds, ts=ts)[1]
        bad = 0 if loss < best else bad + 1
        best = min(best, loss)
        gone = [n for n, _ in Forecaster(now, params=params or {}).fit(df, ts).importance()[::-1][: max(1, int(len(now) * share))]]
        log.append((k, len(now), loss, ",".join(gone)))
        if bad >= patience or len(now) - len(gone) < max(least, len(features) // 2):
            break
        now = [c for c in now if c not in gone]
    return log

