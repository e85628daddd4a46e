"""Recursive multi-step forecasting with a state row per series.

Recomputing the whole feature table for each of H steps (what a pandas loop
does) is quadratic. Instead each series keeps one state row:

    series_key, last_date, first_date, tail array<double> (last 28 values),
    n, s1, s2 (count, sum and sum of squares of all values)

``recursive_forecast`` takes all H steps of a series in one stage: a batch of
state rows is a matrix, each step derives the features of all its series with
numpy, scores the fitted models (flat trees, coefficients: bounded by the
model, shipped with the task), floors the driving model's prediction at 0 and
appends it to the tail. ``stepwise_forecast`` does the same with Spark columns,
one step after the other, for any model with a ``transform``; its lineage is
cut by reliable checkpoints every few steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.session import cut_lineage

KEY = "series_key"
TAIL = 28


def initial_state(daily: DataFrame, value: str = "sales", key: str = KEY, tail: int = TAIL) -> DataFrame:
    """State after the last known day of each series."""
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    last = daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= tail)
    tails = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v")))).alias("_t"))
    totals = daily.groupBy(key).agg(
        F.max("date").alias("last_date"),
        F.min("date").alias("first_date"),
        F.count(value).alias("n"),
        F.sum(F.col(value).cast("double")).alias("s1"),
        F.sum(F.col(value).cast("double") * F.col(value).cast("double")).alias("s2"),
    )
    return totals.join(tails.select(key, F.transform("_t", lambda s: s["v"]).alias("tail")), key).withColumn(
        "path", F.array().cast("array<struct<date:date,step:int,yhat:double>>")
    )


def _window_stats(tail: Column, w: int) -> dict[str, Column]:
    sl = F.slice(tail, -w, w)
    full = F.size(tail) >= w
    s = F.aggregate(sl, F.lit(0.0), lambda a, x: a + x)
    ss = F.aggregate(sl, F.lit(0.0), lambda a, x: a + x * x)
    srt = F.array_sort(sl)
    lo, hi = (w + 1) // 2, (w + 2) // 2
    return {
        f"rolling_mean_{w}": F.when(full, s / w),
        f"rolling_std_{w}": F.when(full, F.sqrt(F.greatest((ss - s * s / w) / (w - 1), F.lit(0.0)))),
        f"rolling_min_{w}": F.when(full, F.array_min(sl)),
        f"rolling_max_{w}": F.when(full, F.array_max(sl)),
        f"rolling_median_{w}": F.when(full, (F.element_at(srt, lo) + F.element_at(srt, hi)) / 2),
    }


def state_features(date: str = "date") -> dict[str, Column]:
    """Every feature of the named sets, computed from a state row for the
    day ``date`` (the day after ``last_date``)."""
    tail = F.col("tail")
    cols: dict[str, Column] = {}
    cols.update(calendar.part_columns(date))
    cols.update(calendar.flag_columns(date))
    cols.update(calendar.cyclical_columns(date))
    for k in (1, 2, 3, 5, 7, 8, 14, 21, 28):
        cols[f"lag_{k}"] = F.when(F.size(tail) >= k, F.element_at(tail, -k))
    for w in (7, 14, 21, 28):
        cols.update(_window_stats(tail, w))
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    cols["expanding_mean"] = F.when(n > 0, s1 / n)
    cols["expanding_std"] = F.when(n > 1, F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))))
    for k, name in ((7, "same_day_last_week"), (14, "same_day_2_weeks_ago"), (21, "same_day_3_weeks_ago"), (28, "same_day_4_weeks_ago")):
        cols[name] = cols[f"lag_{k}"]
    cols["wow_change"] = cols["lag_1"] - cols["lag_8"]
    # q9: in forecasting a missing ratio is imputed as 0 instead of failing.
    cols["wow_pct_change"] = F.coalesce(F.try_divide(cols["lag_1"], F.nullif(cols["lag_8"], F.lit(0.0))) - 1, F.lit(0.0))
    cols["days_since_start"] = F.datediff(F.col(date), F.col("first_date"))
    for w in (7, 14):
        cols[f"rolling_range_{w}"] = cols[f"rolling_max_{w}"] - cols[f"rolling_min_{w}"]
        cols[f"rolling_cv_{w}"] = F.coalesce(
            F.try_divide(cols[f"rolling_std_{w}"], F.nullif(cols[f"rolling_mean_{w}"], F.lit(0.0))), F.lit(0.0)
        )
    return cols


def _step_features(dates: pd.DatetimeIndex, first: pd.DatetimeIndex, tail: np.ndarray, n, s1, s2) -> dict[str, np.ndarray]:
    """The features of :func:`state_features` for one step of many series;
    ``tail`` holds a series' last values at the right, NaN before them."""
    month_end, quarter_end = dates.is_month_end, dates.is_quarter_end
    out = {
        "year": dates.year, "month": dates.month, "day": dates.day, "day_of_week": dates.dayofweek, "day_of_year": dates.dayofyear,
        "week_of_year": dates.isocalendar().week.to_numpy(dtype=float), "quarter": dates.quarter,
        "is_weekend": dates.dayofweek >= 5, "is_monday": dates.dayofweek == 0, "is_friday": dates.dayofweek == 4,
        "is_month_start": dates.is_month_start, "is_month_end": month_end, "is_quarter_start": dates.is_quarter_start, "is_quarter_end": quarter_end,
    }
    for name, x, period in (("dow", dates.dayofweek, 7.0), ("month", dates.month, 12.0), ("day_of_year", dates.dayofyear, 365.0)):
        angle = 2 * np.pi * np.asarray(x, float) / period
        out[f"{name}_sin"], out[f"{name}_cos"] = np.sin(angle), np.cos(angle)
    for k in (1, 2, 3, 5, 7, 8, 14, 21, 28):
        out[f"lag_{k}"] = tail[:, -k]
    with np.errstate(invalid="ignore", divide="ignore"):
        for w in (7, 14, 21, 28):
            x = tail[:, -w:]  # any NaN: not w values yet
            total = x.sum(axis=1)
            out[f"rolling_mean_{w}"] = total / w
            out[f"rolling_std_{w}"] = np.sqrt(np.maximum((np.square(x).sum(axis=1) - total * total / w) / (w - 1), 0.0))
            out[f"rolling_min_{w}"], out[f"rolling_max_{w}"], out[f"rolling_median_{w}"] = x.min(axis=1), x.max(axis=1), np.median(x, axis=1)
        out["expanding_mean"] = np.where(n > 0, s1 / n, np.nan)
        out["expanding_std"] = np.where(n > 1, np.sqrt(np.maximum((s2 - s1 * s1 / n) / (n - 1), 0.0)), np.nan)
        for k, name in ((7, "same_day_last_week"), (14, "same_day_2_weeks_ago"), (21, "same_day_3_weeks_ago"), (28, "same_day_4_weeks_ago")):
            out[name] = out[f"lag_{k}"]
        out["wow_change"] = out["lag_1"] - out["lag_8"]
        out["wow_pct_change"] = np.where((out["lag_8"] != 0) & ~np.isnan(out["wow_change"]), out["lag_1"] / out["lag_8"] - 1, 0.0)
        out["days_since_start"] = (dates - first).days
        for w in (7, 14):
            mean = out[f"rolling_mean_{w}"]
            out[f"rolling_range_{w}"] = out[f"rolling_max_{w}"] - out[f"rolling_min_{w}"]
            out[f"rolling_cv_{w}"] = np.where((mean != 0) & ~np.isnan(mean), out[f"rolling_std_{w}"] / mean, 0.0)
    return {k: np.asarray(v, float) for k, v in out.items()}


def recursive_forecast(
    daily: DataFrame, fitted: Mapping[str, object], features: Sequence[str], horizon: int = 30, driver: str | None = None, value: str = "sales"
) -> DataFrame:
    """``recursive_forecast``: H one-step predictions, each fed back as the
    next lag, of all series at once. ``fitted`` maps model name -> fitted
    model; the ``driver`` model's (floored) prediction drives the recursion for
    all of them (default: the first). Returns the long table
    ``(series_key, model, date, step, yhat)``. Models that score only data
    frames take :func:`stepwise_forecast`.
    """
    if not all(hasattr(m, "scorer") for m in fitted.values()):
        return stepwise_forecast(daily, fitted, features, horizon, driver, value)
    names, features = list(fitted), list(features)
    drives = names.index(driver or names[0])
    score = [fitted[m].scorer() for m in names]
    state = initial_state(daily, value).select(KEY, "last_date", "first_date", "tail", F.col("n").cast("double").alias("n"), "s1", "s2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            tail = np.full((len(b), TAIL), np.nan)
            for i, t in enumerate(b["tail"]):
                if len(t):
                    tail[i, -len(t) :] = np.asarray(t, float)[-TAIL:]
            last, first = pd.DatetimeIndex(b["last_date"]), pd.DatetimeIndex(b["first_date"])
            n, s1, s2 = (b[c].to_numpy(dtype=float) for c in ("n", "s1", "s2"))
            for step in range(1, horizon + 1):
                dates = last + pd.Timedelta(days=step)
                known = _step_features(dates, first, tail, n, s1, s2)
                x = np.column_stack([known[c] for c in features])
                found = [np.maximum(s(x), 0.0) for s in score]
                for name, y in zip(names, found):
                    yield pd.DataFrame({KEY: b[KEY], "model": name, "date": dates.date, "step": step, "yhat": y})
                y = found[drives]
                tail = np.column_stack([tail[:, 1:], y])
                n, s1, s2 = n + 1, s1 + y, s2 + y * y

    kind = daily.schema[KEY].dataType.simpleString()
    return state.mapInPandas(run, f"{KEY} {kind}, model string, date date, step int, yhat double")


def stepwise_forecast(
    daily: DataFrame,
    fitted: Mapping[str, object],
    features: Sequence[str],
    horizon: int = 30,
    driver: str | None = None,
    value: str = "sales",
    checkpoint_every: int = 5,
) -> DataFrame:
    """H one-step predictions, each fed back as the
    next lag. ``fitted`` maps model name -> :class:`FittedModel`; the
    ``driver`` model's (floored) prediction drives the recursion for all of
    them (default: the first). Returns the long table
    ``(series_key, model, date, step, yhat)``.
    """
    names = list(fitted)
    driver = driver or names[0]
    feat_exprs = state_features("date")
    state = initial_state(daily, value)
    path_type = "array<struct<date:date,step:int,yhat:double,model:string>>"
    state = state.withColumn("path", F.array().cast(path_type))
    for step in range(1, horizon + 1):
        x = state.withColumn("date", F.date_add("last_date", 1))
        x = x.withColumns({c: feat_exprs[c] for c in features})
        for name in names:
            x = fitted[name].transform(x, out=f"_yhat_{name}")
        preds = [
            F.struct(F.col("date"), F.lit(step).alias("step"), F.greatest(F.col(f"_yhat_{m}"), F.lit(0.0)).alias("yhat"), F.lit(m).alias("model"))
            for m in names
        ]
        y = F.greatest(F.col(f"_yhat_{driver}"), F.lit(0.0))
        grown = F.concat(F.col("tail"), F.array(y))
        state = x.select(
            KEY,
            F.col("date").alias("last_date"),
            "first_date",
            # The last TAIL values; slice() from before the start would be empty.
            F.slice(grown, F.greatest(F.size(grown) - (TAIL - 1), F.lit(1)), TAIL).alias("tail"),
            (F.col("n") + 1).alias("n"),
            (F.col("s1") + y).alias("s1"),
            (F.col("s2") + y * y).alias("s2"),
            F.concat(F.col("path"), F.array(*preds)).alias("path"),
        )
        if checkpoint_every and step % checkpoint_every == 0 and step < horizon:
            state = cut_lineage(state)
    out = state.select(KEY, F.inline("path"))
    return out.select(KEY, "model", "date", "step", "yhat")
