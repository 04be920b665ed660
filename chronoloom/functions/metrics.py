"""Forecast metrics as aggregate columns: each works on all groups of a `groupBy` at once. y is the truth, p the forecast, e = p - y.

Rows where either is null or NaN don't count. Ratios without a denominator are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least |y| for a percentage error to count, by series type; else 1. Fixed values.
PERCENT_FLOOR = {"load": 100.0, "price": 5.0, "renewable": 10.0, "solar": 10.0, "wind_onshore": 10.0, "wind_offshore": 10.0, "hydro_total": 10.0, "biomass": 5.0}
#: Hours of day with the highest demand. Fixed values.
PEAK_HOURS = (8, 9, 10, 11, 17, 18, 19, 20)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """A double; null for NaN, which counts as missing."""
    return F.nanvl(_c(x).cast("double"), F.lit(None).cast("double"))


def mean(x: Column | str) -> Column:
    """The mean of what is there. A plain sum of doubles: right to about 13 digits of the largest addend, at any magnitude and in any order."""
    return F.avg(number(x))


def error(y: Column | str, p: Column | str) -> Column:
    return _c(p) - _c(y)


def mae(y="y", p="p") -> Column:
    return mean(F.abs(error(y, p)))


def rmse(y="y", p="p") -> Column:
    return F.sqrt(mean(error(y, p) * error(y, p)))


def bias(y="y", p="p") -> Column:
    return mean(error(y, p))


def mape(y="y", p="p", floor: float | Column = 1.0) -> Column:
    """Over rows whose |y| is over `floor`, in percent."""
    y, p = _c(y), _c(p)
    return mean(F.when(F.abs(y) > floor, F.abs(error(y, p) / F.when(y != 0, y)))) * 100


def mape_unit(y="y", p="p") -> Column:
    """With 1 in place of a zero truth."""
    y, p = _c(y), _c(p)
    return mean(F.abs(error(y, p) / F.when(y == 0, 1.0).otherwise(y))) * 100


def mape_plain(y="y", p="p") -> Column:
    """Without a floor: null where a truth is zero."""
    return mean(F.abs(F.try_divide(error(y, p), _c(y)))) * 100


def smape(y="y", p="p", eps: float = 1e-8) -> Column:
    y, p = _c(y), _c(p)
    return mean(F.abs(error(y, p)) / ((F.abs(y) + F.abs(p)) / 2 + eps)) * 100


def smape_whole(y="y", p="p", eps: float = 1e-8) -> Column:
    """With `eps` beside the whole denominator, not its half."""
    y, p = _c(y), _c(p)
    return mean(2 * F.abs(error(y, p)) / (F.abs(y) + F.abs(p) + eps)) * 100


def skill(model: Column, base: Column) -> Column:
    """1 - model / base; null for a base of zero."""
    return 1 - F.try_divide(model, base)


def skill_or_zero(model: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise(skill(model, base))


def pinball(q: float | Column, y="y", p="p") -> Column:
    d = _c(y) - _c(p)
    return mean(F.when(d >= 0, d * q).otherwise(d * (q - 1)))


def peak(hour: Column | str, y="y", p="p") -> dict[str, Column]:
    """Errors in peak hours, off them, and their ratio (null unless both are over zero)."""
    on = _c(hour).isin(*PEAK_HOURS)
    e = F.abs(error(y, p))
    inside, outside = mean(F.when(on, e)), mean(F.when(~on, e))
    return {
        "peak_mae": inside,
        "offpeak_mae": outside,
        "peak_mape": mean(F.when(on & (F.abs(_c(y)) > 1), F.abs(error(y, p) / F.when(_c(y) != 0, _c(y))))) * 100,
        "peak_ratio": F.when((inside > 0) & (outside > 0), inside / outside),
    }


def distribution(e: Column | str) -> dict[str, Column]:
    """Mean, population deviation, quantiles, skewness and excess kurtosis (0 for a constant), and extremes of an error."""
    e = number(e)
    q = F.percentile(e, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    flat = F.stddev_pop(e) == 0
    return {
        "mean": mean(e), "std": F.stddev_pop(e),
        **{n: q[k] for k, n in enumerate(("p5", "p25", "median", "p75", "p95"))},
        "skew": F.when(flat, 0.0).otherwise(F.skewness(e)), "kurtosis": F.when(flat, 0.0).otherwise(F.kurtosis(e)),
        "max": F.max(e), "min": F.min(e),
    }


def bundle(y="y", p="p", floor: float | Column = 1.0) -> dict[str, Column]:
    return {"mae": mae(y, p), "rmse": rmse(y, p), "mape": mape(y, p, floor), "smape": smape(y, p), "bias": bias(y, p), "n": F.count(number(error(y, p)))}
