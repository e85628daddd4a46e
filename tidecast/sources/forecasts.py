"""Forecast files and result sinks.

Forecasts are one long table ``(series_key, model, date, yhat, lower,
upper)``. ``write_table`` stores any result as parquet (or CSV with a
header), partitioned by ``model`` when present, so readers prune to the
models they need; ``load_forecasts`` reads it back (a missing model is just
absent rows: the ensemble renormalises over what is there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("yhat", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
    ]
)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "model", mode: str = "overwrite") -> None:
    """``sink_csv``: write a result table (parquet by default, or CSV with a
    header). Partitioned by ``partition_by`` when the column exists."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def load_forecasts(spark: SparkSession, path: str, fmt: str = "parquet", models: list[str] | None = None) -> DataFrame:
    """``scan_forecast_csv``: read a forecast table with a fixed schema
    (dates typed on read; no inference pass). ``models`` filters the
    partition column, so only those folders are read."""
    if fmt == "csv":
        df = spark.read.schema(
            T.StructType([f for f in FORECAST_SCHEMA.fields if f.name != "model"] + [T.StructField("model", T.StringType())])
        ).option("header", "true").csv(path)
    else:
        df = spark.read.parquet(path)
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in FORECAST_SCHEMA.fields])
    return df.where(F.col("model").isin(*models)) if models else df


def read_wide_forecast(spark: SparkSession, path: str, model: str, date_col: str = "date", yhat: str = "predicted_sales",
                       lower: str | None = "lower_ci", upper: str | None = "upper_ci", series_key: str = "ALL") -> DataFrame:
    """A single-model CSV forecast (``date, predicted_sales[, lower_ci,
    upper_ci]`` or the decomposition's ``ds, yhat, ...``) as long rows."""
    df = spark.read.option("header", "true").csv(path)
    cols = set(df.columns)
    return df.select(
        F.lit(series_key).alias("series_key"),
        F.lit(model).alias("model"),
        F.to_date(F.col(date_col)).alias("date"),
        F.col(yhat).cast("double").alias("yhat"),
        (F.col(lower).cast("double") if lower and lower in cols else F.lit(None).cast("double")).alias("lower"),
        (F.col(upper).cast("double") if upper and upper in cols else F.lit(None).cast("double")).alias("upper"),
    )
