"""Search for hyperparameters, one series to a task: draws by Parzen densities of good and bad trials, and trials given up when they run behind the median."""

from __future__ import annotations

import json
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

#: What is searched by default: (kind, lowest, highest) or ("choice", values).
SPACE: dict[str, tuple] = {"rate": ("log", 0.02, 0.3), "depth": ("int", 2, 9), "leaves": ("int", 4, 48), "penalty": ("log", 0.01, 10.0), "rows": ("float", 0.5, 1.0), "columns": ("float", 0.5, 1.0)}
START, GOOD, CANDIDATES, WARM = 8, 0.1, 24, 4


class Parzen:
    """Draws parameters where good trials lie thick and bad ones thin, each parameter by itself; the first START draws are even."""

    def __init__(self, space: dict[str, tuple], seed: int = 42):
        self.space, self.r = space, np.random.default_rng(seed)

    def _unit(self, name: str, value) -> float:
        kind, low, high = self.space[name]
        return float(np.log(value / low) / np.log(high / low)) if kind == "log" else (value - low + (kind == "int") * 0.5) / (high - low + (kind == "int"))

    def _value(self, name: str, u: float):
        kind, low, high = self.space[name]
        if kind == "log":
            return float(low * (high / low) ** u)
        return int(min(high, low + int(u * (high - low + 1)))) if kind == "int" else float(low + u * (high - low))

    @staticmethod
    def _density(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A mixture of normal bumps, one a point, and an even one, and their widths; a bump is as wide as the farther of its neighbours is away."""
        order = np.sort(np.concatenate([[0.0, 1.0], points]))
        place = np.searchsorted(order, points)
        wide = np.clip(np.maximum(points - order[np.maximum(place - 1, 0)], order[np.minimum(place + 1, len(order) - 1)] - points), 0.3 / (1 + len(points)), 1.0)
        bumps = np.exp(-0.5 * ((at[:, None] - points) / wide) ** 2) / (wide * np.sqrt(2 * np.pi))
        return (bumps.sum(1) + 1) / (len(points) + 1), wide

    def draw(self, trials: list[tuple[dict, float]]) -> dict:
        if len(trials) < START:
            return {n: s[1][self.r.integers(len(s[1]))] if s[0] == "choice" else self._value(n, self.r.random()) for n, s in self.space.items()}
        ranked = [p for p, _ in sorted(trials, key=lambda t: t[1])]
        cut = max(1, int(np.ceil(GOOD * len(ranked))))
        good, bad = ranked[:cut], ranked[cut:]
        out = {}
        for name, s in self.space.items():
            if s[0] == "choice":
                weigh = lambda lot, s=s, name=name: np.array([1.0 + sum(p[name] == v for p in lot) for v in s[1]])
                g, b = weigh(good), weigh(bad)
                ratio = g / g.sum() / (b / b.sum())
                out[name] = s[1][self.r.choice(len(s[1]), p=g * ratio / (g * ratio).sum())]
                continue
            points = np.array([self._unit(name, p[name]) for p in good])
            _, wide = self._density(points, points)
            own = self.r.integers(len(points) + 1, size=CANDIDATES)
            even = own == len(points)
            own = np.minimum(own, len(points) - 1)
            drawn = np.where(even, self.r.random(CANDIDATES), np.clip(self.r.normal(points[own], wide[own]), 0, 1 - 1e-9))
            ratio = np.log(self._density(points, drawn)[0]) - np.log(self._density(np.array([self._unit(name, p[name]) for p in bad]), drawn)[0])
            out[name] = self._value(name, float(drawn[np.argmax(ratio)]))
        return out


def run(objective, space: dict[str, tuple], trials: int, seed: int = 42, prune: bool = True) -> list[tuple[dict, float, bool]]:
    """(parameters, loss, given up) of each trial. `objective` yields a loss a step; the loss is their mean. After a step a trial is given up if its mean so
    far is over the median of what earlier whole trials had there."""
    sampler, log = Parzen(space, seed), []
    whole: list[list[float]] = []
    for _ in range(trials):
        params = sampler.draw([(p, loss) for p, loss, _ in log])
        seen, total, stopped = [], 0.0, False
        for step, loss in enumerate(objective(params), 1):
            total += loss
            seen.append(total / step)
            others = [w[step - 1] for w in whole if len(w) > step]
            if prune and len(others) >= WARM and seen[-1] > median(others):
                stopped = True
                break
        if not stopped:
            whole.append(seen)
        log.append((params, seen[-1], stopped))
    return log


def search_all(rows: DataFrame, keys: list[str], features: list[str], target: str = "y", space: dict[str, tuple] = SPACE, trials: int = 30, algorithm: str = "lightgbm", rounds: int = 100, seed: int = 42, ts: str = "ts") -> DataFrame:
    """(keys, trial, params, loss, pruned, best) for all series in one job: `rows` have fold and role, the losses are mean absolute errors of folds, in
    their order. `best` marks the whole trial with the least loss, the first of equal ones. A series without a fold to train and test has no rows."""
    base = boosting.PRESETS[algorithm] | {"rounds": rounds}
    lot = rows.where(F.col(target).isNotNull()).select(*keys, "fold", "role", F.col(ts).alias("__ts"), F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features])

    def task(group: pa.Table) -> pa.Table:
        group = group.sort_by([("fold", "ascending"), ("__ts", "ascending"), ("__y", "ascending")])
        x, y = boosting.numbers(group, features), group["__y"].to_numpy()
        fold, test = group["fold"].to_numpy(), np.array(group["role"].to_pylist()) == "test"
        parts = [(x[(fold == f) & ~test], y[(fold == f) & ~test], x[(fold == f) & test], y[(fold == f) & test]) for f in np.unique(fold)]
        parts = [p for p in parts if len(p[1]) and len(p[3])]

        def objective(params: dict):
            for a, b, c, d in parts:
                yield float(np.abs(boosting.predict(c, boosting.fit(a, b, None, base | params)) - d).mean())

        log = run(objective, space, trials, seed) if parts else []
        best = min((k for k, t in enumerate(log) if not t[2]), key=lambda k: log[k][1], default=None)
        out = {k: pa.array([group[k][0].as_py()] * len(log), group.schema.field(k).type) for k in keys}
        return pa.table(out | {"trial": pa.array(range(len(log)), pa.int32()), "params": pa.array([json.dumps(p, sort_keys=True) for p, _, _ in log], pa.string()), "loss": pa.array([t[1] for t in log], pa.float64()), "pruned": pa.array([t[2] for t in log], pa.bool_()), "best": pa.array([k == best for k in range(len(log))], pa.bool_())})

    form = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return boosting.spread(lot, keys).groupBy(*keys).applyInArrow(task, f"{form}, trial int, params string, loss double, pruned boolean, best boolean")
