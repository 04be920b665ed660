"""Scalar columns: calendar parts, cycles, degree days, ladders and defaults."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(ts: Column | str = "ts") -> dict[str, Column]:
    """hour, day_of_week (0 is Monday), day_of_month, month, day_of_year, is_weekend (0 or 1)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.weekday(ts)
    return {"hour": F.hour(ts), "day_of_week": day, "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "day_of_year": F.dayofyear(ts), "is_weekend": (day >= 5).cast("int")}


def cyclical(ts: Column | str = "ts") -> dict[str, Column]:
    parts = calendar(ts)
    out = {}
    for name, part, period in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12)):
        x = 2 * pi * parts[part] / period
        out |= {f"{name}_sin": F.sin(x), f"{name}_cos": F.cos(x)}
    return out


def kelvin_to_celsius(k: Column) -> Column:
    return k - 273.15


def degree_days(celsius: Column, base: float = 18.0) -> dict[str, Column]:
    """Degrees below and above the base; null for a null temperature."""
    return {"heating_degree": F.when(celsius.isNotNull(), F.greatest(F.lit(0.0), base - celsius)), "cooling_degree": F.when(celsius.isNotNull(), F.greatest(F.lit(0.0), celsius - base))}


def parse_timestamp(text: Column) -> Column:
    """Timestamp text with or without an offset, as UTC (the session's zone); null where it can't be read."""
    return text.try_cast("timestamp")


def season(ts: Column | str = "ts") -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def or_default(x: Column, default: Column | float) -> Column:
    """x unless it is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(default) if not isinstance(default, Column) else default)


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def freshness(hours: Column, healthy: int = 24, warning: int = 48) -> Column:
    return F.when(hours < healthy, "healthy").when(hours < warning, "warning").otherwise("critical")


def horizon_hours(target: Column, now: Column) -> Column:
    """Whole hours from now to the target, one at least."""
    return F.greatest(F.lit(1), F.floor((F.unix_seconds(target) - F.unix_seconds(now)) / 3600).cast("int"))


def unreliable(mape: Column, most: float = 1000.0) -> Column:
    return F.coalesce(mape > most, F.lit(False))


def version_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
