"""Join-based forecasters: seasonal naive and the SQL-expressible stand-ins.

All of them take the output of :func:`tidecast.operators.daily.holdout_split`
(rows tagged ``train`` / ``test``) and return the long prediction table::

    series_key, model, date, actual, yhat, lower, upper

They are plain equi-joins of the (small) test rows to per-key train
aggregates, so they scale with the number of series, not with history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_key"
PRED_COLS = (KEY, "model", "date", "actual", "yhat", "lower", "upper")


def _train_test(split: DataFrame, value: str):
    train = split.where(F.col("role") == "train").select(KEY, "date", F.col(value).alias("_v"))
    test = split.where(F.col("role") == "test").select(KEY, "date", "cutoff", F.col(value).alias("actual"))
    return train, test


def exact_mean(col: str, scale: int = 2):
    """Mean of a cents-valued column from an exact decimal sum: one final
    double division, so the value is the same in any partitioning."""
    return F.sum(F.col(col).cast(f"decimal(20,{scale})")).cast("double") / F.count(col)


def _train_mean(train: DataFrame) -> DataFrame:
    return train.groupBy(KEY).agg(exact_mean("_v").alias("_train_mean"))


def _finish(df: DataFrame, model: str, band: tuple[float, float] | None) -> DataFrame:
    yhat = F.col("yhat")
    if band is None:
        lower, upper = F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        lower, upper = yhat * F.lit(band[0]), yhat * F.lit(band[1])
    return df.select(
        KEY, F.lit(model).alias("model"), "date", "actual", yhat.alias("yhat"), lower.alias("lower"), upper.alias("upper")
    )


def seasonal_naive(
    split: DataFrame,
    season: int = 7,
    value: str = "sales",
    recursive: bool = False,
    model: str = "seasonal_naive",
    band: tuple[float, float] | None = None,
) -> DataFrame:
    """``seasonal_naive`` / ``naive_lookup``: the value ``season`` days
    earlier, looked up in train only; when that day is not in train the
    train mean is used (so hold-out days past the first season get the mean).

    ``recursive=True`` instead repeats the last train season: a test day
    looks ``k * season`` days back for the smallest ``k`` that lands in train.
    """
    train, test = _train_test(split, value)
    if recursive:
        back = F.expr(f"CAST(ceil(datediff(date, cutoff) / {season}) AS INT) * {season}")
    else:
        back = F.lit(season)
    probe = test.withColumn("_src", F.date_sub(F.col("date"), back))
    looked = probe.join(
        train.select(KEY, F.col("date").alias("_src"), "_v"), [KEY, "_src"], "left"
    ).join(_train_mean(train), KEY, "left")
    out = looked.withColumn("yhat", F.coalesce(F.col("_v"), F.col("_train_mean")))
    return _finish(out, model, band)


def weekday_mean(split: DataFrame, value: str = "sales", band=(0.8, 1.2), model: str = "weekday_mean") -> DataFrame:
    """Stand-in forecaster: train mean of the same weekday (Monday = 0)."""
    train, test = _train_test(split, value)
    means = train.groupBy(KEY, F.weekday("date").alias("_wd")).agg(exact_mean("_v").alias("yhat"))
    out = test.withColumn("_wd", F.weekday("date")).join(means, [KEY, "_wd"], "left")
    return _finish(out, model, band)


def trailing_mean(split: DataFrame, window: int = 28, value: str = "sales", band=(0.8, 1.2), model: str = "trailing_28") -> DataFrame:
    """Stand-in forecaster: mean of the last ``window`` train days."""
    train, test = _train_test(split, value)
    w = Window.partitionBy(KEY).orderBy(F.col("date").desc())
    tail = train.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    means = tail.groupBy(KEY).agg(exact_mean("_v").alias("yhat"))
    return _finish(test.join(means, KEY, "left"), model, band)


def last_week(split: DataFrame, value: str = "sales", band=(0.8, 1.2)) -> DataFrame:
    """Stand-in forecaster: seasonal naive with a +-20 % band."""
    return seasonal_naive(split, 7, value, model="last_week", band=band)


def standin_forecasts(split: DataFrame, value: str = "sales") -> DataFrame:
    """The three SQL-expressible stand-ins as one long prediction table."""
    return last_week(split, value).unionByName(weekday_mean(split, value)).unionByName(trailing_mean(split, value=value))
