"""Feature frames: calendar, holidays, weather, and the whole matrix that models are trained on."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from . import joins, shape, windows

#: Public holidays as (month, day) and the countries that keep them. The countries' laws.
COUNTRIES = "AT BE BG CH CZ DE EE ES FI FR GR HR HU IT LT LV NL NO PL PT RO SE SI SK"
FIXED = {
    (1, 1): COUNTRIES, (1, 2): "RO SI", (1, 6): "AT ES FI GR HR IT PL RO SE SK", (1, 7): "RO", (1, 24): "RO",
    (2, 8): "SI", (2, 16): "LT", (2, 24): "EE", (3, 3): "BG", (3, 11): "LT", (3, 15): "HU", (3, 25): "GR",
    (4, 25): "IT PT", (4, 27): "NL", (5, 1): "AT BE BG CZ DE EE ES FI FR GR HR HU IT LT LV NO PL PT RO SE SI SK", (5, 2): "SI", (5, 3): "PL",
    (5, 4): "LV", (5, 5): "NL", (5, 6): "BG", (5, 8): "CZ FR SK", (5, 17): "NO", (5, 24): "BG", (5, 30): "HR",
    (6, 1): "RO", (6, 2): "IT", (6, 6): "SE", (6, 10): "PT", (6, 22): "HR", (6, 23): "EE LV", (6, 24): "EE LT LV", (6, 25): "HR SI",
    (7, 5): "CZ SK", (7, 6): "CZ LT", (7, 14): "FR", (7, 21): "BE",
    (8, 1): "CH", (8, 5): "HR", (8, 15): "AT BE ES FR GR HR IT LT PL PT RO SI", (8, 20): "EE HU", (8, 29): "SK",
    (9, 1): "SK", (9, 6): "BG", (9, 15): "SK", (9, 22): "BG", (9, 28): "CZ",
    (10, 3): "DE", (10, 5): "PT", (10, 8): "HR", (10, 12): "ES", (10, 23): "HU", (10, 26): "AT", (10, 28): "CZ GR", (10, 31): "SI",
    (11, 1): "AT BE ES FR HR HU IT LT PL PT SI SK", (11, 2): "LT", (11, 11): "BE FR PL", (11, 17): "CZ SK", (11, 18): "HR LV", (11, 30): "RO",
    (12, 1): "PT RO", (12, 6): "ES FI", (12, 8): "AT ES IT PT", (12, 24): "BG CZ EE LT LV PL SK", (12, 25): COUNTRIES,
    (12, 26): "AT BG CZ DE EE FI GR HR HU IT LT LV NL NO PL RO SE SI SK", (12, 31): "LV",
}
#: Days from Easter Sunday, which ORTHODOX countries take from the Julian calendar. Fixed values.
EASTER = {
    -48: "GR", -3: "NO", -2: "BG CZ DE EE ES FI GR HU LV NO PT RO SE SK", -1: "BG", 0: "BG EE FI GR HR HU IT LT LV NL NO PL PT RO SE SI",
    1: "AT BE BG CZ DE FI FR GR HR HU IT LT LV NL NO PL RO SE SI SK", 39: "AT BE CH DE FI FR NL NO SE", 49: "EE FI HU NL NO PL RO SE SI",
    50: "AT BE DE FR GR HU NL NO RO", 60: "AT HR PL PT",
}
ORTHODOX = "BG GR RO"
#: The first such weekday (Monday is 0) on or after (month, day).
WEEKDAY = {(6, 20, 5): "FI SE", (10, 31, 5): "FI SE", (5, 1, 6): "LT", (5, 8, 6): "LV", (6, 1, 6): "LT"}

#: (country, rule) -> the spans of years in which it holds, first and last; rules not named here hold in all. A rule is a key of the tables above.
YEARS = {
    ("RO", (1, 6)): [(2024, 9999)], ("RO", (1, 7)): [(2024, 9999)], ("RO", (1, 24)): [(2017, 9999)], ("RO", (6, 1)): [(2017, 9999)], ("RO", -2): [(2018, 9999)], ("PL", (12, 24)): [(2025, 9999)],
    ("HR", (6, 25)): [(0, 2019)], ("HR", (10, 8)): [(0, 2019)], ("HR", (5, 30)): [(2020, 9999)], ("HR", (11, 18)): [(2020, 9999)], ("SK", (9, 1)): [(0, 2023)], ("SK", (11, 17)): [(0, 2024)],
    ("CZ", -2): [(2016, 9999)], ("HU", -2): [(2017, 9999)], ("LT", (11, 2)): [(2020, 9999)], ("SI", (1, 2)): [(0, 2012), (2017, 9999)],
    ("PT", 60): [(0, 2012), (2016, 9999)], ("PT", (10, 5)): [(0, 2012), (2016, 9999)], ("PT", (11, 1)): [(0, 2012), (2016, 9999)], ("PT", (12, 1)): [(0, 2012), (2016, 9999)],
}
#: Days that were holidays once.
ONCE = {"DE": [date(2017, 10, 31)], "SK": [date(2018, 10, 30)], "GR": [date(2021, 5, 4), date(2022, 5, 2), date(2024, 5, 7)]}


def _moved(country: str, days: set[date], y: int) -> set[date]:
    """What a country's laws move or add by weekday, given the year's days by date."""
    if country == "NL":  # the king's birthday isn't kept on a Sunday; liberation is a day off every five years
        if date(y, 4, 27).weekday() == 6:
            days = days - {date(y, 4, 27)} | {date(y, 4, 26)}
        return days if y % 5 == 0 else days - {date(y, 5, 5)}
    if country == "BG" and y >= 2017:  # for each day that falls on a weekend the next working day, in turn
        out = set(days)
        for d in sorted(d for d in days if d.weekday() >= 5 and (d.month, d.day) in FIXED):
            while d in out or d.weekday() >= 5:
                d += timedelta(days=1)
            out.add(d)
        return out
    if country == "LV":
        return days | {d + timedelta(days=7 - d.weekday()) for d in (date(y, 5, 4), date(y, 11, 18)) if d.weekday() >= 5}
    return days


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def orthodox_easter(year: int) -> date:
    """Easter Sunday of the Julian calendar, as a Gregorian date (1900 to 2099)."""
    a, b, c = year % 4, year % 7, year % 19
    d = (19 * c + 15) % 30
    month, day = divmod(d + (2 * a + 4 * b - d + 34) % 7 + 114, 31)
    return date(year, month, day + 1) + timedelta(days=13)


def holidays(country: str, years: range) -> list[date]:
    """A country's nationwide holidays in those years, by the laws of each; one without a calendar here has Germany's."""
    country = country.upper() if country.upper() in COUNTRIES.split() else "DE"
    sunday = orthodox_easter if country in ORTHODOX.split() else easter
    holds = lambda rule, y: any(a <= y <= z for a, z in YEARS.get((country, rule), [(0, 9999)]))
    out = set()
    for y in years:
        days = {date(y, m, d) for (m, d), who in FIXED.items() if country in who.split() and holds((m, d), y)}
        days |= {sunday(y) + timedelta(days=k) for k, who in EASTER.items() if country in who.split() and holds(k, y)}
        for (m, d, weekday), who in WEEKDAY.items():
            if country in who.split():
                first = date(y, m, d)
                days.add(first + timedelta(days=(weekday - first.weekday()) % 7))
        out |= _moved(country, days, y) | {d for d in ONCE.get(country, []) if d.year == y}
    return sorted(out)


def holiday_table(spark: SparkSession, countries: list[str], years: range) -> DataFrame:
    return spark.createDataFrame([(c, d) for c in countries for d in holidays(c, years)], "country string, holiday date")


def holiday_features(df: DataFrame, table: DataFrame, country: str = "country", ts: str = "ts", most: int = 7) -> DataFrame:
    """is_holiday, days_to_holiday, days_from_holiday (strictly ahead and behind, `most` at most), is_bridge_day.

    The calendar is spread over the days around each holiday and joined by equality; it grows with countries and years, not with the data.
    """
    near = table.select(F.col("country").alias(country), "holiday", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift"))
    near = near.select(country, F.date_add("holiday", F.col("shift")).alias("day"), "shift")
    bridge = ((F.col("shift") == 1) & (F.weekday("day") == 4)) | ((F.col("shift") == -1) & (F.weekday("day") == 0))
    near = near.groupBy(country, "day").agg(F.max((F.col("shift") == 0).cast("int")).alias("is_holiday"), F.min(F.when(F.col("shift") < 0, -F.col("shift"))).alias("days_to_holiday"), F.min(F.when(F.col("shift") > 0, F.col("shift"))).alias("days_from_holiday"), F.max(bridge.cast("int")).alias("is_bridge_day"))
    out = df.withColumn("day", F.to_date(ts)).join(near, [country, "day"], "left").drop("day")
    return out.fillna({"is_holiday": 0, "days_to_holiday": most, "days_from_holiday": most, "is_bridge_day": 0})


def weather_features(df: DataFrame, temperature: str = "temperature_2m_k", degrees: bool = True) -> DataFrame:
    celsius = scalars.kelvin_to_celsius(F.col(temperature))
    return df.withColumns({"temperature_c": celsius} | (scalars.degree_days(celsius) if degrees else {}))


def feature_matrix(df: DataFrame, keys: list[str], covariates: list[str], lag_days: tuple[int, ...] = (1, 7, 14), widths: tuple[int, ...] = (24, 168), ts: str = "ts", y: str = "y") -> DataFrame:
    """The training frame: covariates filled, calendar, cycles, lags, trailing statistics; rows without target, lags or trailing means go, other nulls are 0."""
    df = shape.fill_both(df, keys, [y, *covariates], ts)
    df = df.withColumns(scalars.calendar(ts) | scalars.cyclical(ts))
    df = windows.trailing(windows.lags(df, keys, list(lag_days), ts, y), keys, list(widths), ts, y)
    must = [y, *[c for c in df.columns if "_lag_" in c or c.endswith("_mean")]]
    return df.dropna(subset=must).fillna(0.0)


def lagged(df: DataFrame, keys: list[str], days: list[int], ts: str = "ts", y: str = "y") -> DataFrame:
    """Calendar, cycles, and y so many days earlier by time: rows to forecast have these as well as those of the past."""
    out = df.withColumns(scalars.calendar(ts) | scalars.cyclical(ts))
    for d in days:
        out = joins.offset_lookup(out, keys, 24 * d, f"{y}_lag_{d}d", ts, y)
    return out


def error_features(df: DataFrame, keys: list[str], ts: str = "ts", actual: str = "y", tso: str = "tso") -> DataFrame:
    """Of a forecast beside its truth: the error, its lags by rows and its trailing statistics with the row itself, and the forecast's trailing mean."""
    df = df.withColumn("err", F.col(actual) - F.col(tso)).withColumns(scalars.calendar(ts))
    df = windows.lags(df, keys, [1, 2, 7], ts, "err")
    df = windows.trailing_inclusive(df, keys, [24, 168], ts, "err")
    return windows.trailing_inclusive(df, keys, [24], ts, tso, ("mean",))


def model_columns(columns: list[str]) -> list[str]:
    """The numeric feature columns of a matrix, in a fixed order: calendar, cycles, holidays, lags, trailing statistics, others."""
    rank = lambda c: next((k for k, part in enumerate(("hour", "day_", "month", "is_", "holiday", "_lag_", "_roll_")) if part in c), 9)
    return sorted(columns, key=lambda c: (rank(c), c))
