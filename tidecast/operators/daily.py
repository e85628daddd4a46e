"""Daily series: aggregation, calendar gap fill, profiles and simple cuts.

Every table here is keyed by ``(series_key, date)``. The invoice fact is
reduced to one row per key and day by a partial + final hash aggregate, so
the heavy input is shuffled once, already combined map-side; everything
after that works on the (small, bounded by keys x days) daily table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_key"


def daily_sales(invoices: DataFrame, key: str = KEY) -> DataFrame:
    """``daily_sales``: per key and day the sales sum, invoice count and
    distinct customers.

    The amount is summed as ``decimal(18,2)`` (exact, order independent) and
    only then turned into a double. ``count_distinct`` is planned by Catalyst
    as a two-level aggregate (key, day, customer) then (key, day), both with
    map-side partial aggregation.
    """
    return invoices.groupBy(key, F.col("invoice_date").alias("date")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("sales"),
        F.count("invoice_number").alias("invoice_count"),
        F.count_distinct("customer_no").alias("customer_count"),
    )


def daily_sales_simple(invoices: DataFrame, key: str = KEY) -> DataFrame:
    """``daily_sales_simple``: per key and day the sales sum only."""
    return invoices.groupBy(key, F.col("invoice_date").alias("date")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("sales")
    )


def key_calendar(daily: DataFrame, key: str = KEY, start: str = "date", end: str = "date") -> DataFrame:
    """One row per key and every calendar day between its first and last day."""
    bounds = daily.groupBy(key).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    return bounds.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("date"))


def gap_fill(daily: DataFrame, key: str = KEY, fill_cols: tuple[str, ...] | None = None) -> DataFrame:
    """``gap_fill``: every calendar day of each key's range, missing measures 0.

    The calendar is generated per key from that key's min/max (a
    ``sequence`` + ``explode``, no driver loop) and left-joined to the daily
    totals on ``(key, date)``; both sides are keyed the same way so the join
    is one co-partitioned shuffle of a small table.
    """
    measures = fill_cols or tuple(c for c in daily.columns if c not in (key, "date"))
    # The daily totals feed both the calendar bounds and the join; the two
    # uses prune different columns, so without this the fact would be read
    # twice. The table is bounded by keys x days, so caching it is cheap.
    daily = daily.persist()
    cal = key_calendar(daily, key)
    joined = cal.join(daily, [key, "date"], "left")
    return joined.select(
        key,
        "date",
        *[F.coalesce(F.col(c), F.lit(0).cast(dict(daily.dtypes)[c])).alias(c) for c in measures],
    )


def dataset_profile(invoices: DataFrame, key: str = KEY) -> DataFrame:
    """``dataset_profile``: rows, date range, distinct customers and mean
    daily sales (over days with sales) per key."""
    # Days are counted on the daily table and customers by one distinct, so
    # no row of the fact is expanded once per distinct count.
    days = invoices.groupBy(key, "invoice_date").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_s"))
    customers = invoices.select(key, "customer_no").distinct().groupBy(key).agg(F.count("customer_no").alias("n_customers"))
    per_day = days.groupBy(key).agg(
        F.sum("_n").alias("n_records"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast("double").alias("total_sales"),
        F.count("invoice_date").alias("n_days"),
    )
    per_key = per_day.join(customers.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return per_key.withColumn("avg_daily_sales", F.col("total_sales") / F.col("n_days"))


def weekday_pattern(daily: DataFrame, key: str = KEY, value: str = "sales") -> DataFrame:
    """``weekday_pattern`` + ``weekday_vs_mean``: mean value by weekday
    (Monday = 0) and whether it is above the mean of the seven means."""
    by_day = daily.groupBy(key, F.weekday("date").alias("day_of_week")).agg(
        F.avg(value).alias("avg_sales"), F.count(F.lit(1)).alias("n_days")
    )
    w = Window.partitionBy(key)
    return by_day.withColumn("mean_of_means", F.avg("avg_sales").over(w)).withColumn(
        "above_mean", F.col("avg_sales") > F.col("mean_of_means")
    ).withColumn("day_name", F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.col("day_of_week") + 1))


# Weekday names, Monday first (matches ``weekday`` = 0 for Monday).
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def series_stats(daily: DataFrame, key: str = KEY, value: str = "sales") -> DataFrame:
    """``series_stats``: mean, median and sample standard deviation."""
    return daily.groupBy(key).agg(
        F.avg(value).alias("mean_sales"),
        F.percentile(value, 0.5).alias("median_sales"),
        F.stddev_samp(value).alias("std_sales"),
        F.count(F.lit(1)).alias("n_days"),
    )


def holdout_split(daily: DataFrame, test_days: int = 30, key: str = KEY) -> DataFrame:
    """``holdout_split``: tags each row ``train`` (date <= max - test_days)
    or ``test``; adds ``cutoff``. Per key, by a window max (the daily table is
    already partitioned by key for the feature windows that follow)."""
    w = Window.partitionBy(key)
    cutoff = F.date_sub(F.max("date").over(w), test_days)
    # Forecasters read the split several times (train and test branches of
    # each model); it is bounded by keys x days, so persist it once instead
    # of re-running the window in every branch.
    return (
        daily.withColumn("cutoff", cutoff)
        .withColumn("role", F.when(F.col("date") <= F.col("cutoff"), "train").otherwise("test"))
        .persist()
    )


def future_dates(daily: DataFrame, horizon: int = 30, key: str = KEY) -> DataFrame:
    """``future_dates``: the ``horizon`` days after each key's last date,
    with the 1-based step number."""
    last = daily.groupBy(key).agg(F.max("date").alias("_last"))
    return last.select(
        key,
        F.posexplode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("_pos", "date"),
    ).select(key, "date", (F.col("_pos") + 1).alias("step"))


def append_future(daily: DataFrame, horizon: int = 30, key: str = KEY) -> DataFrame:
    """``append_future_rows``: history plus future days with empty measures."""
    fut = future_dates(daily, horizon, key).drop("step")
    return daily.unionByName(fut, allowMissingColumns=True)


def recent_history(daily: DataFrame, n: int = 60, key: str = KEY) -> DataFrame:
    """``recent_history``: the last ``n`` rows of each series."""
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def horizon_head(forecast: DataFrame, daily: DataFrame, horizon: int = 30, key: str = KEY) -> DataFrame:
    """``horizon_head``: forecast rows in (last actual, last actual + horizon]."""
    last = daily.groupBy(key).agg(F.max("date").alias("_last_actual"))
    return (
        forecast.join(last, key)
        .where((F.col("date") > F.col("_last_actual")) & (F.col("date") <= F.date_add("_last_actual", horizon)))
        .drop("_last_actual")
    )
