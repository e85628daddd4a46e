"""Invoice sources: the fixture star schema, JSON invoice files, and cleaning.

The invoice table is the only fact every pipeline starts from::

    invoice_number string, invoice_date date, customer_no string,
    account_number string, customer_name string, amount decimal(18,2),
    invoice_type string, source string, series_key string

``series_key`` is our addition: it names the series a row belongs to
(one constant for the whole business, or nation / market segment), so
every per-series step can be partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.session import table_path
from tidecast.sources.json_array import RANGE_BYTES, array_records

AMOUNT_TYPE = T.DecimalType(18, 2)

# Raw JSON schema: every field read as text so a bad amount or date survives
# the read and is coerced by ``clean`` instead of failing the whole file.
RAW_INVOICE_SCHEMA = T.StructType(
    [
        T.StructField("invoice_number", T.StringType()),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("customer_no", T.StringType()),
        T.StructField("account_number", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("invoice_type", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

SERIES_KEYS = ("nation", "segment", "all")
GLOBAL_SERIES = "ALL"


def series_key_expr(mode: str, nation_col: str = "c_nationkey", segment_col: str = "c_mktsegment") -> Column:
    if mode == "nation":
        return F.col(nation_col).cast("string")
    if mode == "segment":
        return F.col(segment_col)
    if mode == "all":
        return F.lit(GLOBAL_SERIES)
    raise ValueError(f"series key must be one of {SERIES_KEYS}, got {mode!r}")


def invoices_from_orders(spark: SparkSession, sf_dir: str, series: str = "nation", only_invoices: bool = False) -> DataFrame:
    """``scan_invoices_parquet``: invoices derived from ``orders`` x ``customer``.

    Only the columns used are read (Catalyst prunes the scan) and the join is a
    plain equi-join on the customer key; the optimizer picks the strategy
    (customer is a dimension, orders the fact).
    """
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    if only_invoices:
        # Same rows as ``filter_invoices`` on the derived type, written on the
        # scan column so it reaches the parquet reader as a pushed filter.
        orders = orders.where((F.col("o_orderstatus") != "P") | F.col("o_orderstatus").isNull())
    customer = spark.read.parquet(table_path(sf_dir, "customer")).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("invoice_number"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_custkey").cast("string").alias("customer_no"),
        F.col("o_custkey").cast("string").alias("account_number"),
        F.col("c_name").alias("customer_name"),
        F.col("o_totalprice").cast(AMOUNT_TYPE).alias("amount"),
        F.when(F.col("o_orderstatus") == "P", F.lit("CM")).otherwise(F.lit("IN")).alias("invoice_type"),
        F.lit("orders").alias("source"),
        series_key_expr(series).alias("series_key"),
    )


def read_invoices(
    spark: SparkSession, path: str, series_col: str | None = None, json_array: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``scan_invoices_json``: files holding a JSON array of invoice records
    (``json_array=True``) or JSON lines (``False``).

    Array files are read by byte ranges of ``range_bytes`` (see
    ``sources.json_array``), so one large file is many tasks; JSON lines are
    split by Spark.
    """
    schema = RAW_INVOICE_SCHEMA
    if series_col and series_col not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(series_col, T.StringType())])
    if json_array:
        records = array_records(spark, path, range_bytes)
        raw = records.select(F.from_json("record", schema).alias("r")).select("r.*")
    else:
        raw = spark.read.schema(schema).json(path)
    key = F.col(series_col) if series_col else F.lit(GLOBAL_SERIES)
    return raw.withColumn("series_key", key)


def parse_date(col: str | Column) -> Column:
    """``parse_date``: text or timestamp to a day-grain date; bad text is NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_to_date(c.cast("string")), F.to_date(F.try_to_timestamp(c.cast("string"))))


def coerce_amount(col: str | Column, fill_zero: bool = False) -> Column:
    """``coerce_amount`` / ``coerce_amount_zero``: bad numbers become NULL (or 0).

    Forecasting skips a bad amount (NULL is ignored by ``sum``), churn counts
    it as a zero-value order; both behaviours are kept.
    """
    c = F.col(col) if isinstance(col, str) else col
    value = c.cast("string").try_cast(AMOUNT_TYPE)
    return F.coalesce(value, F.lit(0).cast(AMOUNT_TYPE)) if fill_zero else value


def clean(df: DataFrame, fill_zero: bool = False) -> DataFrame:
    """Date parsing and amount coercion on a raw or typed invoice frame.

    Columns that already have the target type are left alone, so a typed
    parquet scan keeps its pushed filters and no needless casts are added.
    """
    types = dict(df.dtypes)
    if types["invoice_date"] != "date":
        df = df.withColumn("invoice_date", parse_date("invoice_date"))
    if types["amount"] != "decimal(18,2)":
        df = df.withColumn("amount", coerce_amount("amount", fill_zero))
    elif fill_zero:
        df = df.withColumn("amount", F.coalesce(F.col("amount"), F.lit(0).cast(AMOUNT_TYPE)))
    return df


def filter_invoices(df: DataFrame) -> DataFrame:
    """``filter_invoices``: keep real invoices, drop credit and debit memos.

    A simple comparison on a scan column, so it reaches the parquet reader as
    a pushed filter.
    """
    return df.where(F.col("invoice_type") == "IN")


def prepared_invoices(spark: SparkSession, sf_dir: str, series: str = "nation", fill_zero: bool = False) -> DataFrame:
    """Fixture invoices, cleaned and filtered: the input of every pipeline."""
    return filter_invoices(clean(invoices_from_orders(spark, sf_dir, series, only_invoices=True), fill_zero))
