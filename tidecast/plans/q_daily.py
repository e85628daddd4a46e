"""Registered queries: sources, cleaning, daily series, hold-out baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import baselines, daily, metrics
from tidecast.plans.checks import register
from tidecast.plans.sql_oracle import metrics_select, with_ctes
from tidecast.sources import invoices as src


def _inv(spark, d, series="nation", fill_zero=False):
    return src.prepared_invoices(spark, d, series, fill_zero)


def _daily(spark, d, series="nation"):
    return daily.gap_fill(daily.daily_sales(_inv(spark, d, series)))


def _split(spark, d, series="nation"):
    return daily.holdout_split(_daily(spark, d, series), 30)


# --------------------------------------------------------------- sources
@register(
    "scan_invoices_parquet",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS invoice_number, CAST(o.o_orderdate AS DATE) AS invoice_date,
       CAST(o.o_custkey AS VARCHAR) AS customer_no, CAST(o.o_custkey AS VARCHAR) AS account_number,
       c.c_name AS customer_name, CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       CASE WHEN o.o_orderstatus = 'P' THEN 'CM' ELSE 'IN' END AS invoice_type, 'orders' AS source,
       CAST(c.c_nationkey AS VARCHAR) AS series_key
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def q_scan(spark, d):
    return src.invoices_from_orders(spark, d).withColumn("amount", F.col("amount").cast("double"))


@register(
    "filter_invoices",
    with_ctes("invoices")
    + "SELECT invoice_number, invoice_date, customer_no, CAST(amount AS DOUBLE) AS amount FROM invoices",
)
def q_filter(spark, d):
    return _inv(spark, d).select("invoice_number", "invoice_date", "customer_no", F.col("amount").cast("double"))


@register(
    "parse_date",
    """SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number,
       COALESCE(TRY_CAST(CAST(o_orderdate AS VARCHAR) AS DATE), TRY_CAST(TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS DATE)) AS invoice_date
FROM orders""",
)
def q_parse_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.col("o_orderkey").cast("string").alias("invoice_number"),
        src.parse_date(F.col("o_orderdate").cast("string")).alias("invoice_date"),
    )


_COERCE_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number,
       CAST({expr} AS DOUBLE) AS amount
FROM orders"""


@register(
    "coerce_amount",
    _COERCE_SQL.format(expr="TRY_CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS DECIMAL(18,2))"),
)
def q_coerce(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.col("o_orderkey").cast("string").alias("invoice_number"),
        src.coerce_amount(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).cast("double").alias("amount"),
    )


@register(
    "coerce_amount_zero",
    _COERCE_SQL.format(
        expr="COALESCE(TRY_CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || "
        "(CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END) AS DECIMAL(18,2)), 0)"
    ),
)
def q_coerce_zero(spark, d):
    # Memo rows get a junk suffix so the zero fill is exercised on real rows.
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.when(F.col("o_orderstatus") == "P", "x").otherwise(""),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("invoice_number"),
        src.coerce_amount(text, fill_zero=True).cast("double").alias("amount"),
    )


# --------------------------------------------------------------- daily
@register("daily_sales", with_ctes("daily_raw") + "SELECT * FROM daily_raw")
def q_daily_sales(spark, d):
    return daily.daily_sales(_inv(spark, d))


@register(
    "daily_sales_simple",
    with_ctes("invoices")
    + "SELECT series_key, invoice_date AS date, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS sales FROM invoices GROUP BY 1, 2",
)
def q_daily_simple(spark, d):
    return daily.daily_sales_simple(_inv(spark, d))


@register("gap_fill", with_ctes("daily") + "SELECT * FROM daily")
def q_gap_fill(spark, d):
    return _daily(spark, d)


@register(
    "dataset_profile",
    with_ctes("invoices")
    + """SELECT series_key, count(*) AS n_records, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
       count(DISTINCT customer_no) AS n_customers, CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS total_sales,
       count(DISTINCT invoice_date) AS n_days,
       CAST(COALESCE(sum(amount), 0) AS DOUBLE) / count(DISTINCT invoice_date) AS avg_daily_sales
FROM invoices GROUP BY series_key""",
)
def q_profile(spark, d):
    return daily.dataset_profile(_inv(spark, d))


@register(
    "weekday_pattern",
    with_ctes("daily")
    + """SELECT series_key, day_of_week, avg_sales, n_days,
       avg(avg_sales) OVER (PARTITION BY series_key) AS mean_of_means,
       avg_sales > avg(avg_sales) OVER (PARTITION BY series_key) AS above_mean,
       dayname(DATE '2024-01-01' + CAST(day_of_week AS INTEGER)) AS day_name
FROM (SELECT series_key, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, avg(sales) AS avg_sales, count(*) AS n_days
      FROM daily GROUP BY 1, 2)""",
    rnd=("avg_sales", "mean_of_means"),
)
def q_weekday(spark, d):
    return daily.weekday_pattern(_daily(spark, d))


@register(
    "series_stats",
    with_ctes("daily")
    + """SELECT series_key, avg(sales) AS mean_sales, quantile_cont(sales, 0.5) AS median_sales,
       stddev_samp(sales) AS std_sales, count(*) AS n_days
FROM daily GROUP BY series_key""",
    rnd=("mean_sales", "std_sales"),
)
def q_series_stats(spark, d):
    return daily.series_stats(_daily(spark, d))


@register(
    "holdout_split",
    with_ctes("daily_split")
    + "SELECT series_key, date, sales, cutoff, role FROM daily_split",
)
def q_holdout(spark, d):
    return _split(spark, d).select("series_key", "date", "sales", "cutoff", "role")


@register(
    "future_dates",
    with_ctes("daily")
    + """SELECT series_key, CAST(last + INTERVAL (s) DAY AS DATE) AS date, CAST(s AS INTEGER) AS step
FROM (SELECT series_key, max(date) AS last FROM daily GROUP BY 1), range(1, 31) t(s)""",
)
def q_future(spark, d):
    return daily.future_dates(_daily(spark, d), 30)


@register(
    "append_future_rows",
    with_ctes("daily")
    + """SELECT series_key, date, sales FROM daily
UNION ALL
SELECT series_key, CAST(last + INTERVAL (s) DAY AS DATE), CAST(NULL AS DOUBLE)
FROM (SELECT series_key, max(date) AS last FROM daily GROUP BY 1), range(1, 31) t(s)""",
)
def q_append_future(spark, d):
    return daily.append_future(_daily(spark, d).select("series_key", "date", "sales"), 30)


@register(
    "recent_history",
    with_ctes("daily")
    + """SELECT series_key, date, sales FROM (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 60""",
)
def q_recent(spark, d):
    return daily.recent_history(_daily(spark, d).select("series_key", "date", "sales"), 60)


# --------------------------------------------------------------- baselines + metrics
@register(
    "seasonal_naive",
    with_ctes("naive_pred") + "SELECT * FROM naive_pred",
    rnd=("yhat",),
)
def q_naive(spark, d):
    return baselines.seasonal_naive(_split(spark, d))


@register(
    "naive_lookup",
    with_ctes("daily_split")
    + """SELECT t.series_key, t.date, coalesce(p.sales, m.mean) AS last_week_sales
FROM daily_split t JOIN (SELECT series_key, CAST(sum(CAST(sales AS DECIMAL(20, 6))) AS DOUBLE) / count(sales) AS mean
                         FROM daily_split WHERE role = 'train' GROUP BY series_key) m USING (series_key)
     LEFT JOIN daily_split p ON p.role = 'train' AND p.series_key = t.series_key
     AND p.date = CAST(t.date - INTERVAL 7 DAY AS DATE)
WHERE t.role = 'test'""",
    rnd=("last_week_sales",),
)
def q_naive_lookup(spark, d):
    naive = baselines.seasonal_naive(_split(spark, d))
    return naive.select("series_key", "date", F.col("yhat").alias("last_week_sales"))


_MRND = ("mae", "rmse", "mape", "total_predicted", "total_actual", "total_error_pct")


@register("forecast_metrics", with_ctes("naive_pred") + metrics_select("naive_pred"), rnd=_MRND)
def q_forecast_metrics(spark, d):
    return metrics.forecast_metrics(baselines.seasonal_naive(_split(spark, d)))


@register("standin_forecasts", with_ctes("standin_long") + "SELECT * FROM standin_long", rnd=("yhat", "lower", "upper"))
def q_standins(spark, d):
    return baselines.standin_forecasts(_split(spark, d))


@register("backtest_metrics", with_ctes("standin_metrics") + "SELECT * FROM standin_metrics", rnd=_MRND)
def q_backtest_metrics(spark, d):
    return metrics.forecast_metrics(baselines.standin_forecasts(_split(spark, d)))


# --------------------------------------------------------------- file sources and sinks
def _roundtrip_csv(spark, d):
    from tidecast.session import scratch_path
    from tidecast.sources import forecasts

    path = scratch_path(spark, "forecast-csv")
    fc = baselines.standin_forecasts(_split(spark, d)).drop("actual")
    forecasts.write_table(fc, path, fmt="csv")
    return path


@register("sink_csv", with_ctes("standin_long") + "SELECT series_key, model, date, yhat, lower, upper FROM standin_long", rnd=("yhat", "lower", "upper"))
def q_sink_csv(spark, d):
    from tidecast.sources import forecasts

    return forecasts.load_forecasts(spark, _roundtrip_csv(spark, d), fmt="csv")


@register(
    "scan_forecast_csv",
    with_ctes("standin_long") + "SELECT series_key, model, date, yhat, lower, upper FROM standin_long WHERE model IN ('last_week', 'trailing_28')",
    rnd=("yhat", "lower", "upper"),
)
def q_scan_forecast_csv(spark, d):
    from tidecast.sources import forecasts

    return forecasts.load_forecasts(spark, _roundtrip_csv(spark, d), fmt="csv", models=["last_week", "trailing_28"])


@register(
    "scan_invoices_json",
    with_ctes("invoices")
    + "SELECT invoice_number, invoice_date, customer_no, CAST(amount AS DOUBLE) AS amount, series_key FROM invoices",
)
def q_scan_json(spark, d):
    from tidecast.session import scratch_path
    from tidecast.sources.json_array import write_arrays

    path = scratch_path(spark, "invoices-json")
    raw = src.invoices_from_orders(spark, d).select(
        *[F.col(c).cast("string").alias(c) for c in ("invoice_number", "invoice_date", "customer_no", "account_number", "customer_name", "amount", "invoice_type", "source", "series_key")]
    )
    write_arrays(raw.select(F.to_json(F.struct("*"))), path)
    inv = src.filter_invoices(src.clean(src.read_invoices(spark, path, series_col="series_key")))
    return inv.select("invoice_number", "invoice_date", "customer_no", F.col("amount").cast("double").alias("amount"), "series_key")


# --------------------------------------------------------------- other series keys
@register(
    "daily_sales_by_segment",
    with_ctes("invoices_segment")
    + """SELECT series_key, invoice_date AS date, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS sales,
       COUNT(invoice_number) AS invoice_count, COUNT(DISTINCT customer_no) AS customer_count
FROM invoices_segment GROUP BY series_key, invoice_date""",
)
def q_daily_segment(spark, d):
    return daily.daily_sales(_inv(spark, d, "segment"))


@register("gap_fill_all", with_ctes("daily_all") + "SELECT * FROM daily_all")
def q_gap_fill_all(spark, d):
    return _daily(spark, d, "all")
