"""Workflows of models over all series at once, on `boosting`: cascades, correction of an external forecast, elimination of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, crossval

#: Rows with a forecast beside its truth that a correction needs, and the shares of series and rows that gates look at. Fixed values.
LEAST_CORRECTION = 500


def cascade_all(df: DataFrame, keys: list[str], features: list[str], stages: list[str], target: str = "y", folds: int = 5, params: dict | None = None, algorithm: str = "xgboost", ts: str = "ts") -> tuple[DataFrame, DataFrame, list[str]]:
    """(models of the target, rows, columns): each of `stages` is forecast out of fold (by the full model where a row is in no test fold), the difference of
    the first two is put beside, and the target's models learn from all of these. A job for the folds of a stage, whatever the number of series."""
    out = df
    for stage in stages:
        split = crossval.time_series_split(df.where(F.col(stage).isNotNull()), keys, folds, ts)
        oof = boosting.out_of_fold(split, keys, features, stage, [params or {}], algorithm, ts).select(*keys, ts, F.col("p").alias("__oof"))
        full = boosting.predict_all(df, boosting.fit_all(df, keys, features, stage, [params or {}], algorithm, ts=ts), keys, features).select(*keys, ts, F.col("p").alias("__full"))
        out = out.join(oof, [*keys, ts], "left").join(full, [*keys, ts], "left").withColumn(f"cascade_{stage}", F.coalesce("__oof", "__full")).drop("__oof", "__full")
    extra = [f"cascade_{s}" for s in stages]
    if len(stages) > 1:
        out = out.withColumn("cascade_residual", F.col(extra[0]) - F.col(extra[1]))
        extra.append("cascade_residual")
    return boosting.fit_all(out, keys, [*features, *extra], target, [params or {}], algorithm, ts=ts), out, [*features, *extra]


def corrected_all(df: DataFrame, keys: list[str], features: list[str], split: str, tso: str = "tso", error: str = "err", least: int = LEAST_CORRECTION, params: dict | None = None, algorithm: str = "lightgbm", ts: str = "ts") -> DataFrame:
    """Rows from `split` on with `p`, the error that a model of the rows before foresees, and `corrected`, the forecast with it, 0 at least. Series with
    fewer than `least` errors before the split have no model and keep null in both."""
    at = F.lit(split).cast("timestamp")
    past = df.where((F.col(ts) < at) & F.col(error).isNotNull())
    enough = past.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys)
    models = boosting.fit_all(past.join(enough, keys, "left_semi"), keys, features, error, [params or {}], algorithm, ts=ts)
    got = boosting.predict_all(df.where(F.col(ts) >= at), models, keys, features).drop("trial")
    return got.withColumn("corrected", F.when(F.col("p").isNotNull(), F.greatest(F.lit(0.0), F.col(tso) + F.col("p"))))


def eliminate_all(rows: DataFrame, keys: list[str], features: list[str], target: str = "y", rounds: int = 5, share: float = 0.1, patience: int = 3, least: int = 5, params: dict | None = None, algorithm: str = "lightgbm", ts: str = "ts") -> DataFrame:
    """(keys, round, features, mae, dropped) of backward elimination, each series in a task of its own: a round measures the columns over the folds of `rows`
    (fold, role) and drops the tenth with the least gain. It ends after `patience` rounds without a better one, or with half of the columns left."""
    p = boosting.PRESETS[algorithm] | (params or {})
    lot = rows.where(F.col(target).isNotNull()).select(*keys, "fold", "role", F.col(ts).alias("__ts"), F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features])

    def task(group: pa.Table) -> pa.Table:
        group = group.sort_by([("fold", "ascending"), ("__ts", "ascending"), ("__y", "ascending")])
        x, y, fold = boosting.numbers(group, features), group["__y"].to_numpy(), group["fold"].to_numpy()
        test = np.array(group["role"].to_pylist()) == "test"
        now, best, bad, log = list(range(len(features))), np.inf, 0, []
        for k in range(rounds):
            losses, gain = [], np.zeros(len(now))
            for f in np.unique(fold):
                a, b = (fold == f) & ~test, (fold == f) & test
                if a.any() and b.any():
                    m = boosting.fit(x[a][:, now], y[a], None, p)
                    losses.append(np.abs(boosting.predict(x[b][:, now], m) - y[b]).mean())
                    gain += m["gain"]
            if not losses:
                break
            loss = float(np.mean(losses))
            bad = 0 if loss < best else bad + 1
            best = min(best, loss)
            gone = sorted(range(len(now)), key=lambda c: (gain[c], features[now[c]]))[: max(1, int(len(now) * share))]
            log.append((k, len(now), loss, ",".join(features[now[c]] for c in gone)))
            if bad >= patience or len(now) - len(gone) < max(least, len(features) // 2):
                break
            now = [c for i, c in enumerate(now) if i not in gone]
        out = {k: pa.array([group[k][0].as_py()] * len(log), group.schema.field(k).type) for k in keys}
        return pa.table(out | {"round": pa.array([r[0] for r in log], pa.int32()), "features": pa.array([r[1] for r in log], pa.int32()), "mae": pa.array([r[2] for r in log], pa.float64()), "dropped": pa.array([r[3] for r in log], pa.string())})

    form = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return boosting.spread(lot, keys).groupBy(*keys).applyInArrow(task, f"{form}, round int, features int, mae double, dropped string")
