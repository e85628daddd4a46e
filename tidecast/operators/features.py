"""Leak-safe time-series features over the gap-filled daily table.

Every window is ``partitionBy(series_key).orderBy(date)`` and every frame
ends at the previous row (``-1``), so a row at day t sees only days < t.
Catalyst groups window expressions with the same partitioning and ordering
into one Window operator, so all features of one table cost one shuffle by
key and one sort per key, whatever the number of columns.

Rolling statistics are NULL until the frame holds ``w`` rows, like a
rolling window that requires a full window.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar

KEY = "series_key"

SK_LAGS = (1, 2, 3, 5, 7, 14, 21, 28)
XGB_LAGS = (1, 2, 3, 7, 14, 21, 28)
VALIDATION_LAGS = (1, 2, 3, 7, 14, 28)


def _ordered(key: str = KEY, order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def lag_columns(value: str = "sales", lags: Iterable[int] = SK_LAGS, key: str = KEY, prefix: str = "lag_") -> dict[str, Column]:
    """``lag_features`` (and ``same_day_prior_weeks`` under other names)."""
    w = _ordered(key)
    return {f"{prefix}{n}": F.lag(value, n).over(w) for n in lags}


def rolling_columns(
    value: str = "sales",
    windows: Iterable[int] = (7, 14, 21, 28),
    stats: Iterable[str] = ("mean", "std", "min", "max", "median"),
    key: str = KEY,
) -> dict[str, Column]:
    """``rolling_mean`` / ``rolling_std`` / ``rolling_min_max`` /
    ``rolling_median`` over the previous ``w`` rows."""
    out = {}
    base = _ordered(key)
    for w in windows:
        frame = base.rowsBetween(-w, -1)
        full = F.count(value).over(frame) == w
        fns = {
            "mean": F.avg(value),
            "std": F.stddev_samp(value),
            "min": F.min(value),
            "max": F.max(value),
            "median": F.percentile(value, 0.5),
        }
        for s in stats:
            out[f"rolling_{s}_{w}"] = F.when(full, fns[s].over(frame))
    return out


def expanding_columns(
    value: str = "sales", stats: Iterable[str] = ("mean", "std"), key: str = KEY, decimal_scale: int | None = 2
) -> dict[str, Column]:
    """``expanding_stats``: mean and sample std of all previous rows.

    With ``decimal_scale`` (the series holds cents), the running sums are
    exact decimals and the mean / variance come from them with one final
    double division: the result does not depend on summation order, so it
    is the same however the data is partitioned.
    """
    frame = _ordered(key).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(value).over(frame)
    if decimal_scale is None:
        fns = {"mean": F.avg(value).over(frame), "std": F.stddev_samp(value).over(frame)}
    else:
        x = F.col(value).cast(f"decimal(20,{decimal_scale})")
        s1 = F.sum(x).over(frame)
        s2 = F.sum(x * x).over(frame)
        mean = F.when(n > 0, s1.cast("double") / n)
        num = (n.cast("decimal(20,0)") * s2 - s1 * s1).cast("double")
        std = F.when(n > 1, F.sqrt(F.greatest(num, F.lit(0.0)) / (n * (n - 1)).cast("double")))
        fns = {"mean": mean, "std": std}
    return {f"expanding_{s}": fns[s] for s in stats}


def days_since_start(key: str = KEY, date: str = "date") -> Column:
    """``days_since_start``: days from the series' first date."""
    return F.datediff(F.col(date), F.min(date).over(Window.partitionBy(key)))


def trend_index(key: str = KEY, date: str = "date") -> Column:
    """``trend_index``: 0-based row number in date order (equals
    ``days_since_start`` on gap-free data)."""
    return F.row_number().over(_ordered(key, date)) - 1


def wow_columns(value: str = "sales", key: str = KEY) -> dict[str, Column]:
    """``wow_change`` and ``wow_pct_change`` (NULL when 8 days ago was 0)."""
    w = _ordered(key)
    l1, l8 = F.lag(value, 1).over(w), F.lag(value, 8).over(w)
    return {"wow_change": l1 - l8, "wow_pct_change": F.try_divide(l1, F.nullif(l8, F.lit(0.0))) - 1}


def derived_rolling(windows: Iterable[int] = (7, 14)) -> dict[str, Column]:
    """``rolling_range`` and ``rolling_cv`` from already-added rolling columns."""
    out = {}
    for w in windows:
        out[f"rolling_range_{w}"] = F.col(f"rolling_max_{w}") - F.col(f"rolling_min_{w}")
        out[f"rolling_cv_{w}"] = F.try_divide(F.col(f"rolling_std_{w}"), F.nullif(F.col(f"rolling_mean_{w}"), F.lit(0.0)))
    return out


def drop_leaky(df: DataFrame) -> DataFrame:
    """``drop_leaky_cols``: counts known only after the day has happened."""
    return df.drop("invoice_count", "customer_count")


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """``drop_incomplete``: drop rows with any missing feature."""
    return df.na.drop(subset=list(cols) if cols is not None else None)


# ----------------------------------------------------------------- named sets
def full_features(daily: DataFrame, value: str = "sales", key: str = KEY) -> DataFrame:
    """The 61-column set: 7 parts, 7 flags, 6 cyclical, 8 lags, 5 rolling
    stats x 4 windows, expanding mean/std, same day 1-4 weeks ago, wow change
    and pct, days since start, range 7/14, cv 7/14."""
    df = drop_leaky(daily)
    df = calendar.add_calendar(df)
    cols: dict[str, Column] = {}
    cols.update(lag_columns(value, SK_LAGS, key))
    cols.update(rolling_columns(value, (7, 14, 21, 28), ("mean", "std", "min", "max", "median"), key))
    cols.update(expanding_columns(value, ("mean", "std"), key))
    w = _ordered(key)
    for n, name in ((7, "same_day_last_week"), (14, "same_day_2_weeks_ago"), (21, "same_day_3_weeks_ago"), (28, "same_day_4_weeks_ago")):
        cols[name] = F.lag(value, n).over(w)
    cols.update(wow_columns(value, key))
    cols["days_since_start"] = days_since_start(key)
    df = df.withColumns(cols)
    return df.withColumns(derived_rolling((7, 14)))


def xgb_features(daily: DataFrame, value: str = "sales", key: str = KEY) -> DataFrame:
    """The 37-column set of the boosted-tree forecaster."""
    df = drop_leaky(daily)
    df = calendar.add_calendar(df, flags=("is_weekend", "is_month_start", "is_month_end"), day_of_year_cyclic=False)
    cols: dict[str, Column] = {}
    cols.update(lag_columns(value, XGB_LAGS, key))
    cols.update(rolling_columns(value, (7, 14, 28), ("mean", "std", "min", "max"), key))
    cols.update(expanding_columns(value, ("mean",), key))
    w = _ordered(key)
    cols["same_day_last_week"] = F.lag(value, 7).over(w)
    cols["same_day_2_weeks_ago"] = F.lag(value, 14).over(w)
    cols["days_since_start"] = days_since_start(key)
    return df.withColumns(cols)


def validation_features(daily: DataFrame, value: str = "sales", key: str = KEY) -> DataFrame:
    """The 22-column set used by the backtest's tree models."""
    df = drop_leaky(daily)
    df = calendar.add_calendar(df, parts=("day_of_week", "day", "month"), flags=("is_weekend",), day_of_year_cyclic=False)
    cols: dict[str, Column] = {"days_since_start": days_since_start(key)}
    cols.update(lag_columns(value, VALIDATION_LAGS, key))
    cols.update(rolling_columns(value, (7, 14, 28), ("mean", "std"), key))
    cols.update(expanding_columns(value, ("mean",), key))
    return df.withColumns(cols)


FEATURE_SETS = {"full": full_features, "xgb": xgb_features, "validation": validation_features}


def feature_names(df: DataFrame, key: str = KEY, value: str = "sales") -> list[str]:
    """Model input columns of a feature frame (everything but ids and target)."""
    skip = {key, "date", value, "invoice_count", "customer_count", "role", "cutoff", "fold"}
    return [c for c in df.columns if c not in skip]
