"""Boosted trees for many series in one job: each series, and each fold of it, is a group that a task trains on its own.

The learner is a small one: histograms of at most BINS bins a column, trees grown leaf by leaf where the squared error falls most, early stopping on
validation rows. Trees are arrays in the rows of a table of models, so models are joined, stored and compared like other rows. A series is hours of some
years, and its rows (a byte for each column's bin, eight for each number) are what a task holds; there are as many tasks as series and folds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
#: Presets under the names of three tree libraries: their growth in small, not their figures. `rows` and `columns` are shares drawn for each tree.
PRESETS: dict[str, dict] = {
    "xgboost": {"rounds": 200, "rate": 0.1, "leaves": 32, "depth": 5, "least": 1, "penalty": 1.0, "rows": 0.8, "columns": 1.0},
    "lightgbm": {"rounds": 200, "rate": 0.1, "leaves": 31, "depth": 8, "least": 20, "penalty": 0.0, "rows": 0.8, "columns": 0.8},
    "catboost": {"rounds": 200, "rate": 0.1, "leaves": 16, "depth": 4, "least": 1, "penalty": 3.0, "rows": 1.0, "columns": 1.0},
}
PATIENCE = 50
#: A model's columns beside its keys: the trial it comes from, rows it is trained on, the mean they start from, its loss on validation rows (null without),
#: and its trees, node by node: column (-1 for a leaf), cut (`<=` goes to the next node, all else to `right`), value of a leaf; where trees begin; gains.
MODEL = "trial int, n long, base double, loss double, at array<int>, cut array<double>, right array<int>, value array<double>, begin array<int>, gain array<double>"


def edges(x: np.ndarray) -> np.ndarray:
    """Where a column is cut: between distinct values if they are few, else at quantiles."""
    v = np.unique(x[~np.isnan(x)])
    if len(v) > BINS:
        v = np.unique(np.quantile(x[~np.isnan(x)], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        return v
    return (v[:-1] + v[1:]) / 2


def grow(codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, p: dict) -> list[list]:
    """A tree on rows of binned columns as nodes [column, bin, right, value, gain], first child next to its parent; grown best leaf first."""
    wide, shift = len(columns), np.arange(len(columns)) * BINS
    least, penalty = p["least"], p["penalty"]

    def histogram(at: np.ndarray) -> np.ndarray:
        flat = (codes[np.ix_(at, columns)] + shift).ravel()
        return np.stack([np.bincount(flat, minlength=wide * BINS), np.bincount(flat, np.repeat(residual[at], wide), wide * BINS)]).reshape(2, wide, BINS)

    def best(h: np.ndarray) -> tuple[float, int, int]:
        n, g = np.cumsum(h[0], 1), np.cumsum(h[1], 1)
        all_n, all_g = n[0, -1], g[0, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / (n + penalty) + (all_g - g) ** 2 / (all_n - n + penalty) - all_g * all_g / (all_n + penalty)
        gain[(n < least) | (all_n - n < least) | (n == 0) | (n == all_n)] = -np.inf
        k = int(np.argmax(gain))
        return float(gain.flat[k]), k // BINS, k % BINS

    # a leaf: rows, histogram, depth; children are filled in when it is split
    leaves = [[rows, histogram(rows), 0, None]]
    heap: list[tuple[float, int, int, int]] = []

    def offer(k: int) -> None:
        if leaves[k][2] < p["depth"] and len(leaves[k][0]) >= 2 * max(1, least):
            gain, column, cut = best(leaves[k][1])
            if gain > 1e-12:
                heapq.heappush(heap, (-gain, k, column, cut))

    offer(0)
    count = 1
    while heap and count < p["leaves"]:
        gain, k, column, cut = heapq.heappop(heap)
        at, h, depth, _ = leaves[k]
        low = codes[at, columns[column]] <= cut
        sides = at[low], at[~low]
        small = 0 if len(sides[0]) <= len(sides[1]) else 1
        part = histogram(sides[small])
        parts = (part, h - part) if small == 0 else (h - part, part)
        leaves[k][3] = (int(columns[column]), cut, -gain, len(leaves))
        leaves[k][1] = None
        for side, hist in zip(sides, parts, strict=True):
            leaves.append([side, hist, depth + 1, None])
            offer(len(leaves) - 1)
        count += 1

    nodes: list[list] = []

    def lay(k: int) -> int:
        at, _, _, split = leaves[k]
        here = len(nodes)
        if split is None:
            nodes.append([-1, 0, 0, float(residual[at].sum() / (len(at) + penalty)), 0.0])
        else:
            nodes.append([split[0], split[1], 0, 0.0, split[2]])
            lay(split[3])
            nodes[here][2] = lay(split[3] + 1)
        return here

    lay(0)
    return nodes


def walk(x: np.ndarray, at: np.ndarray, cut: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The leaf values of rows in one tree."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = at[node] >= 0
        if not inner.any():
            return value[node]
        k = node[inner]
        node[inner] = np.where(x[rows[inner], at[k]] <= cut[k], k + 1, right[k])


def fit(x: np.ndarray, y: np.ndarray, check: tuple[np.ndarray, np.ndarray] | None, p: dict, patience: int = PATIENCE, seed: int = 42) -> dict:
    """A model of one series. With `check` rows it keeps as many trees as have the least mean absolute error there, and stops `patience` trees after."""
    r = np.random.default_rng(seed)
    bounds = [edges(x[:, k]) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, k]) for k, b in enumerate(bounds)], 1).astype(np.uint8) if x.size else np.zeros(x.shape, np.uint8)
    base = float(y.mean())
    now, seen = np.full(len(y), base), None if check is None else np.full(len(check[1]), base)
    trees, gain = [], np.zeros(x.shape[1])
    best = (np.inf if check is None else float(np.abs(check[1] - seen).mean()), 0)
    for k in range(p["rounds"]):
        rows = np.sort(r.choice(len(y), max(1, int(len(y) * p["rows"])), replace=False)) if p["rows"] < 1 else np.arange(len(y))
        columns = np.sort(r.choice(x.shape[1], max(1, int(x.shape[1] * p["columns"])), replace=False)) if p["columns"] < 1 else np.arange(x.shape[1])
        nodes = grow(codes, y - now, rows, columns, p)
        if len(nodes) == 1 and p["rows"] == p["columns"] == 1:
            break
        at, right = np.array([n[0] for n in nodes], np.int32), np.array([n[2] for n in nodes], np.int32)
        cut = np.array([bounds[n[0]][n[1]] if n[0] >= 0 else 0.0 for n in nodes])
        value = np.array([n[3] for n in nodes]) * p["rate"]
        trees.append((at, cut, right, value))
        now = now + walk(x, at, cut, right, value)
        for n in nodes:
            if n[0] >= 0:
                gain[n[0]] += n[4]
        if check is not None:
            seen = seen + walk(check[0], at, cut, right, value)
            best = min(best, (float(np.abs(check[1] - seen).mean()), k + 1))
            if k + 1 - best[1] >= patience:
                break
    if check is not None:
        trees = trees[: best[1]]
    join = lambda k, kind: np.concatenate([t[k] for t in trees]).astype(kind) if trees else np.zeros(0, kind)
    return {"n": len(y), "base": base, "loss": None if check is None else best[0], "at": join(0, np.int32), "cut": join(1, float), "right": join(2, np.int32), "value": join(3, float), "begin": np.cumsum([0, *[len(t[0]) for t in trees]])[:-1].astype(np.int32), "gain": gain}


def predict(x: np.ndarray, m: dict) -> np.ndarray:
    out = np.full(len(x), m["base"])
    begin = [*np.asarray(m["begin"]).tolist(), len(m["at"])]
    parts = [np.asarray(m[c]) for c in ("at", "cut", "right", "value")]
    for a, z in zip(begin, begin[1:], strict=False):
        out += walk(x, *[part[a:z] for part in parts])
    return out


def numbers(rows: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) if columns else np.zeros((rows.num_rows, 0))


def _doubles(df: DataFrame, columns: list[str]) -> list:
    return [F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key over all tasks: groups are little data and much work, so their partitions mustn't be put together for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fit_all(df: DataFrame, keys: list[str], features: list[str] | list[list[str]], target: str = "y", trials: list[dict] | None = None, algorithm: str = "xgboost", check: str | None = None, ts: str = "ts", patience: int = PATIENCE) -> DataFrame:
    """Models (keys, then MODEL) of all groups of `keys`, all trained in one job: for each of `trials` (parameters over the algorithm's preset; one by
    default) a row. `features` may be a list of columns for each trial. Rows whose target is null don't count; those where the column `check` is true
    aren't trained on and end the training early. Null features go to the right of every cut. A group without rows to train on has no model.

    Rows of a group are put in the order of `ts` and all numbers, so models don't depend on how rows lie.
    """
    if algorithm not in PRESETS:
        raise ValueError(f"algorithm: one of {', '.join(PRESETS)}")
    tries = [PRESETS[algorithm] | t for t in (trials or [{}])]
    sets: list[list[str]] = [list(s) for s in features] if features and not isinstance(features[0], str) else [list(features)] * len(tries)
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = df.where(F.col(target).isNotNull()).select(*keys, F.col(ts).alias("__ts"), F.col(target).cast("double").alias("__y"), (F.coalesce(F.col(check), F.lit(False)) if check else F.lit(False)).alias("__check"), *_doubles(df, columns))
    names = [f.split()[0] for f in MODEL.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__ts", "ascending"), ("__y", "ascending"), *[(c, "ascending") for c in columns]])
        y, held = group["__y"].to_numpy(), group["__check"].to_numpy(zero_copy_only=False).astype(bool)
        found = []
        for k, (p, own) in enumerate(zip(tries, sets, strict=True)):
            x = numbers(group, own)
            if (~held).any():
                found.append({"trial": k} | fit(x[~held], y[~held], (x[held], y[held]) if held.any() else None, p, patience))
        out = {k: pa.array([group[k][0].as_py()] * len(found), group.schema.field(k).type) for k in keys}
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.table(out | {c: pa.array([m[c] for m in found], kind) for c, kind in zip(names, kinds, strict=True)})

    form = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(rows, keys).groupBy(*keys).applyInArrow(run, f"{form}, {MODEL}")


def predict_all(df: DataFrame, models: DataFrame, keys: list[str], features: list[str] | list[list[str]], name: str = "p") -> DataFrame:
    """The rows with the forecast `name` of their group's model, null for groups without one; with several trials a row for each, and its `trial`."""
    sets: list[list[str]] | None = [list(s) for s in features] if features and not isinstance(features[0], str) else None
    columns = list(dict.fromkeys(c for s in sets for c in s)) if sets else list(features)
    wide = df.withColumns({f"__x{k}": F.col(c).cast("double") for k, c in enumerate(columns)})
    place = {c: f"__x{k}" for k, c in enumerate(columns)}

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        own = group.drop_columns(list(place.values()))
        out = []
        for m in known.to_pylist():
            x = numbers(group, [place[c] for c in (sets[m["trial"]] if sets else columns)])
            out.append(own.append_column("trial", pa.array(np.full(len(own), m["trial"], np.int32))).append_column(name, pa.array(predict(x, m))))
        if not out:
            out = [own.append_column("trial", pa.nulls(len(own), pa.int32())).append_column(name, pa.nulls(len(own), pa.float64()))]
        return pa.concat_tables(out)

    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return spread(wide, keys).groupBy(*keys).cogroup(spread(models, keys).groupBy(*keys)).applyInArrow(run, f"{form}, trial int, `{name}` double")


def importance(models: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, share, place) of each model: the share of all gain that came from a column, the largest first."""
    from pyspark.sql.window import Window

    names = F.array(*map(F.lit, features))
    rows = models.select(*keys, "trial", F.posexplode("gain").alias("__k", "__g"), F.aggregate("gain", F.lit(0.0), lambda a, g: a + g).alias("__all"))
    out = rows.select(*keys, "trial", F.get(names, F.col("__k")).alias("feature"), F.coalesce(F.try_divide("__g", "__all"), F.lit(0.0)).alias("share"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "trial").orderBy(F.desc("share"), "feature")))


def out_of_fold(rows: DataFrame, keys: list[str], features: list[str] | list[list[str]], target: str = "y", trials: list[dict] | None = None, algorithm: str = "xgboost", ts: str = "ts") -> DataFrame:
    """The test rows of (fold, role) rows with the forecast `p` of a model trained on the train rows of their fold; all series and folds in one job.
    Folds without train rows are left out."""
    models = fit_all(rows.where("role = 'train'"), [*keys, "fold"], features, target, trials, algorithm, ts=ts)
    return predict_all(rows.where("role = 'test'"), models, [*keys, "fold"], features).where("p is not null")
