"""Calendar columns: parts, flags, cyclical encodings, dummies, names, holidays.

All of them are built-in column expressions (whole-stage codegen); none
needs a UDF. ``day_of_week`` is Monday = 0 throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short weekday names used for the weekday dummies (Sunday is
# the reference level and has no column), Monday first.
SHORT_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat")

PARTS = ("year", "month", "day", "day_of_week", "day_of_year", "week_of_year", "quarter")
FLAGS = ("is_weekend", "is_monday", "is_friday", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end")


def day_of_week(d: Column) -> Column:
    return F.weekday(d)


def part_columns(date: str = "date") -> dict[str, Column]:
    """``calendar_parts``: year, month, day, weekday (Mon=0), day of year,
    ISO week, quarter."""
    d = F.col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
    }


def flag_columns(date: str = "date") -> dict[str, Column]:
    """``calendar_flags``: weekend, Monday, Friday, month/quarter start/end (0/1)."""
    d = F.col(date)
    wd = F.weekday(d)
    q_start = F.trunc(d, "quarter")
    flags = {
        "is_weekend": wd >= 5,
        "is_monday": wd == 0,
        "is_friday": wd == 4,
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": F.last_day(d) == d,
        "is_quarter_start": q_start == d,
        "is_quarter_end": F.date_sub(F.add_months(q_start, 3), 1) == d,
    }
    return {k: v.cast("int") for k, v in flags.items()}


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    """``cyclical_encoding``: sin and cos of 2*pi*x/period."""
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclical_columns(date: str = "date", with_day_of_year: bool = True) -> dict[str, Column]:
    d = F.col(date)
    out = {}
    for name, x, p in (("dow", F.weekday(d), 7), ("month", F.month(d), 12), ("day_of_year", F.dayofyear(d), 365)):
        if name == "day_of_year" and not with_day_of_year:
            continue
        s, c = cyclical(x, p)
        out[f"{name}_sin"], out[f"{name}_cos"] = s, c
    return out


def add_calendar(df: DataFrame, date: str = "date", parts=PARTS, flags=FLAGS, cyclic: bool = True, day_of_year_cyclic: bool = True) -> DataFrame:
    cols = {}
    pc = part_columns(date)
    fc = flag_columns(date)
    cols.update({k: pc[k] for k in parts})
    cols.update({k: fc[k] for k in flags})
    if cyclic:
        cols.update(cyclical_columns(date, day_of_year_cyclic))
    return df.withColumns(cols)


def dummy_columns(date: str = "date", full: bool = True) -> dict[str, Column]:
    """``calendar_dummies``: 6 weekday one-hots (Sunday is the reference);
    with ``full`` also weekend, 11 months (December is the reference),
    Q1-Q3, month start and end. The trend column is added by the caller
    (it depends on row position, see :func:`tidecast.operators.features.trend_index`)."""
    d = F.col(date)
    wd = F.weekday(d)
    cols = {name: (wd == i).cast("int") for i, name in enumerate(SHORT_DAYS)}
    if not full:
        return cols
    cols["is_weekend"] = (wd >= 5).cast("int")
    for m in range(1, 12):
        cols[f"month_{m}"] = (F.month(d) == m).cast("int")
    for q in (1, 2, 3):
        cols[f"Q{q}"] = (F.quarter(d) == q).cast("int")
    cols["month_start"] = (F.dayofmonth(d) == 1).cast("int")
    cols["month_end"] = (F.last_day(d) == d).cast("int")
    return cols


def day_name(date: Column | str, short: bool = False) -> Column:
    """``day_name``: full (Monday) or short (Mon) weekday name."""
    d = F.col(date) if isinstance(date, str) else date
    return F.date_format(d, "EEE" if short else "EEEE")


# US federal holidays as rules. Fixed-date holidays are
# (month, day); floating ones are (month, weekday Mon=0, n-th; -1 = last).
FIXED_HOLIDAYS = (
    ("New Year's Day", 1, 1),
    ("Juneteenth National Independence Day", 6, 19),
    ("Independence Day", 7, 4),
    ("Veterans Day", 11, 11),
    ("Christmas Day", 12, 25),
)
FLOATING_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, 0, 3),
    ("Washington's Birthday", 2, 0, 3),
    ("Memorial Day", 5, 0, -1),
    ("Labor Day", 9, 0, 1),
    ("Columbus Day", 10, 0, 2),
    ("Thanksgiving", 11, 3, 4),
)
JUNETEENTH_FROM = 2021


def holidays_for_years(years: DataFrame, year_col: str = "year") -> DataFrame:
    """US federal holidays for the years in ``years`` (lazy: no action).

    One row per holiday and year, built from the rules above with column
    expressions; its size is 11 x the number of distinct years.
    """
    y = F.col(year_col).cast("int")
    items = []
    for name, m, dd in FIXED_HOLIDAYS:
        date = F.make_date(y, F.lit(m), F.lit(dd))
        if name.startswith("Juneteenth"):
            date = F.when(y >= JUNETEENTH_FROM, date)
        items.append(F.struct(F.lit(name).alias("holiday"), date.alias("date")))
    for name, m, wd, nth in FLOATING_HOLIDAYS:
        first = F.make_date(y, F.lit(m), F.lit(1))
        if nth > 0:
            offset = (F.lit(wd) - F.weekday(first) + 7) % 7 + (nth - 1) * 7
            date = F.date_add(first, offset.cast("int"))
        else:
            last = F.last_day(first)
            date = F.date_sub(last, ((F.weekday(last) - F.lit(wd) + 7) % 7).cast("int"))
        items.append(F.struct(F.lit(name).alias("holiday"), date.alias("date")))
    out = years.select(y.alias("year"), F.inline(F.array(*items))).where(F.col("date").isNotNull())
    wd = F.weekday("date")
    observed = F.when(wd == 5, F.date_sub("date", 1)).when(wd == 6, F.date_add("date", 1)).otherwise(F.col("date"))
    return out.select("holiday", "year", "date", observed.alias("observed"))


def us_holidays(spark, first_year: int, last_year: int) -> DataFrame:
    """``holiday_flags``: the US federal holiday calendar for a year range,
    built from rules in SQL (one row per holiday and year; size bounded by
    11 x years). Saturday holidays are observed on Friday and Sunday ones on
    Monday, as observed dates are what a sales calendar sees; both the
    actual and the observed date are returned.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return holidays_for_years(years)
