"""Customer features for churn: RFM, tenure, order gaps, period trends,
quarterly seasonality and rates (24 features per customer).

Plan shape (built for one customer holding a large share of all rows):

1. invoices -> one row per (customer, day): a partial + final hash
   aggregate. Whatever a customer's order count, it now has at most one
   row per calendar day.
2. Everything else reads that customer-day table once: a per-customer window
   (gaps between order days) and, in its partitions, one per-customer
   aggregate of totals, gaps and quarter counts.

Gaps between consecutive orders are recovered exactly from the
customer-day table: a day with ``n`` orders contributes ``n - 1`` zero gaps
and one gap to the previous order day. Their median is a weighted exact
``percentile`` (value, frequency).

Sums of amounts and squares are exact decimals or integers; each variance is
one double subtraction of them, so results do not depend on partitioning or
summation order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import stored

CUST = "customer_no"

# Model input columns of the churn matrix (21 of the 24 features; the two
# revenue windows and the peak quarter are reported but not fed to models).
CHURN_FEATURES = (
    "recency", "frequency", "monetary", "avg_order_value", "customer_tenure", "log_tenure",
    "avg_gap", "gap_std", "gap_cv", "min_gap", "max_gap", "median_gap", "recency_gap_ratio",
    "recent_orders", "prior_orders", "order_trend", "revenue_trend", "seasonality_cv",
    "orders_per_month", "revenue_per_month", "order_value_cv",
)


def reference_date(invoices: DataFrame, ref: dt.date | str | None = None) -> DataFrame:
    """One-row frame with the reference date: given, or last invoice day + 1."""
    if ref is not None:
        return invoices.sparkSession.range(1).select(F.lit(ref).cast("date").alias("ref_date"))
    return invoices.agg(F.date_add(F.max("invoice_date"), 1).alias("ref_date"))


def customer_days(invoices: DataFrame) -> DataFrame:
    """Step 1: one row per customer and order day (count, exact sums, the
    day's first name by invoice number)."""
    amt = F.col("amount").cast("decimal(18,2)")
    return invoices.where(F.col(CUST).isNotNull()).groupBy(CUST, F.col("invoice_date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(amt).alias("amt"),
        F.sum(amt * amt).alias("amt2"),
        F.min_by("customer_name", "invoice_number").alias("first_name"),
    )


def _sample_std(n: Column, s1: Column, s2: Column) -> Column:
    """Sample std from count, sum and sum of squares (doubles of exact sums)."""
    a, b = s1.cast("double"), s2.cast("double")
    var = (b - a * a / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


def customer_features(invoices: DataFrame, ref: dt.date | str | None = None) -> DataFrame:
    """``customer_features``: the 24-feature table, one row per customer.

    ``invoices`` must already be cleaned (amount coerced, NULL -> 0 for churn)
    and filtered to real invoices.
    """
    # The customer-day table feeds the reference date and the features: store
    # it once so the invoices are scanned and shuffled a single time. It has one row per
    # customer and order day: nearly as many as invoices where customers
    # rarely order twice a day, but only a few narrow columns.
    cd = stored(customer_days(invoices), "customer-days")
    # A one-row frame: its size is fixed, so broadcasting it is always safe.
    # The last order day is read from the customer-day table, not the raw
    # invoices (same value, no extra pass over the fact).
    refdf = F.broadcast(reference_date(cd.withColumnRenamed("date", "invoice_date"), ref))

    # Gaps: per customer, days between consecutive order days, plus n-1
    # zero gaps inside each day. Rows per customer <= order days.
    d = F.col("date")
    w = Window.partitionBy(CUST).orderBy("date")
    stepped = cd.withColumn("_step", F.datediff(d, F.lag(d).over(w)))
    # A day's row carries the gap before it; its zero gaps are a second row
    # that counts for the gaps alone.
    day = F.struct(F.col("_step").alias("gap"), F.lit(1).cast("long").alias("freq"), F.lit(True).alias("day"))
    zeros = F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("freq"), F.lit(False).alias("day"))
    rows = stepped.select("*", F.inline(F.when(F.col("n") > 1, F.array(day, zeros)).otherwise(F.array(day))))

    # One aggregate over the window's own partitions: no further exchange.
    r = F.col("ref_date")
    recent = d >= F.date_sub(r, 180)
    prior = (d >= F.date_sub(r, 365)) & (d < F.date_sub(r, 180))
    gap, n_gaps = F.col("gap"), F.when(F.col("gap").isNotNull(), F.col("freq"))

    def total(col: str, of: Column | None = None) -> Column:
        return F.sum(F.when(F.col("day") if of is None else F.col("day") & of, F.col(col)).otherwise(0))

    def counted(of: Column) -> Column:
        return total("n", of)

    q = F.quarter("date")
    j = (
        rows.crossJoin(refdf)
        .groupBy(CUST)
        .agg(
            F.first("ref_date").alias("ref_date"),
            F.min_by("first_name", "date").alias("customer_name"),
            F.max("date").alias("last_order"),
            F.min("date").alias("first_order"),
            F.sum(F.when(F.col("day"), F.col("n"))).alias("frequency"),
            F.sum(F.when(F.col("day"), F.col("amt"))).alias("_s1"),
            F.sum(F.when(F.col("day"), F.col("amt2"))).alias("_s2"),
            counted(recent).alias("recent_orders"),
            counted(prior).alias("prior_orders"),
            total("amt", recent).alias("_recent_rev"),
            total("amt", prior).alias("_prior_rev"),
            F.sum(n_gaps).alias("_m"),
            F.sum(gap * F.col("freq")).alias("_g1"),
            F.sum(gap.cast("long") * gap * F.col("freq")).alias("_g2"),
            F.min("gap").alias("_min_gap"),
            F.max("gap").alias("_max_gap"),
            F.percentile("gap", 0.5, F.col("freq")).alias("_median_gap"),
            *[counted(q == i).alias(f"_q{i}") for i in range(1, 5)],
            counted(q.isNull()).alias("_q0"),
        )
    )
    # Quarterly seasonality over quarters present (quarter of year, 1-4; days
    # without a date count as one more). The peak is the first of the largest.
    counts = [F.col(f"_q{i}") for i in range(5)]
    most = F.greatest(*counts[1:])
    peak = F.when(counts[0] <= most, F.coalesce(*[F.when(c == most, F.lit(i)) for i, c in enumerate(counts) if i]))
    j = j.withColumns(
        {
            "_k": sum((c > 0).cast("long") for c in counts),
            "_c1": sum(counts),
            "_c2": sum(c * c for c in counts),
            "peak_quarter": peak,
        }
    )

    freq = F.col("frequency")
    recency = F.datediff(r, F.col("last_order"))
    tenure = F.datediff(r, F.col("first_order"))
    monetary = F.col("_s1").cast("double")
    m = F.col("_m")
    has_gaps = freq > 1
    avg_gap = F.when(has_gaps, F.col("_g1") / m).otherwise(tenure.cast("double"))
    gap_std = F.when(has_gaps & (m > 1), _sample_std(m, F.col("_g1"), F.col("_g2"))).otherwise(F.lit(0.0))
    months = F.greatest(tenure / 30.0, F.lit(1.0))
    amount_std = _sample_std(freq, F.col("_s1"), F.col("_s2"))
    q_mean = F.col("_c1") / F.col("_k")

    def trend(recent_v: Column, prior_v: Column) -> Column:
        return (
            F.when(prior_v > 0, (recent_v - prior_v).cast("double") / prior_v.cast("double"))
            .when(recent_v > 0, F.lit(1.0))
            .otherwise(F.lit(-1.0))
        )

    out = j.select(
        CUST,
        "customer_name",
        recency.alias("recency"),
        freq.alias("frequency"),
        monetary.alias("monetary"),
        (monetary / freq).alias("avg_order_value"),
        tenure.alias("customer_tenure"),
        F.log1p(tenure).alias("log_tenure"),
        avg_gap.alias("avg_gap"),
        gap_std.alias("gap_std"),
        F.when(avg_gap > 0, gap_std / avg_gap).otherwise(F.lit(0.0)).alias("gap_cv"),
        F.when(has_gaps, F.col("_min_gap")).otherwise(tenure).cast("double").alias("min_gap"),
        F.when(has_gaps, F.col("_max_gap")).otherwise(tenure).cast("double").alias("max_gap"),
        F.when(has_gaps, F.col("_median_gap")).otherwise(tenure.cast("double")).alias("median_gap"),
        F.when(avg_gap > 0, recency / avg_gap).otherwise(recency.cast("double")).alias("recency_gap_ratio"),
        F.col("recent_orders"),
        F.col("prior_orders"),
        F.col("_recent_rev").cast("double").alias("recent_revenue"),
        F.col("_prior_rev").cast("double").alias("prior_revenue"),
        trend(F.col("recent_orders"), F.col("prior_orders")).alias("order_trend"),
        trend(F.col("_recent_rev"), F.col("_prior_rev")).alias("revenue_trend"),
        F.when(q_mean > 0, _sample_std(F.col("_k"), F.col("_c1"), F.col("_c2")) / q_mean)
        .otherwise(F.lit(0.0))
        .alias("seasonality_cv"),
        F.col("peak_quarter"),
        (freq / months).alias("orders_per_month"),
        (monetary / months).alias("revenue_per_month"),
        F.when(monetary / freq > 0, amount_std / (monetary / freq)).otherwise(F.lit(0.0)).alias("order_value_cv"),
    )
    return out


def customer_gaps(invoices: DataFrame) -> DataFrame:
    """``order_gaps``: days between consecutive orders of each customer, as
    weighted rows ``(customer_no, date, gap, n_gaps)``: the gap from the
    previous order day (one) and the same-day zero gaps (``n - 1``). Built
    from the customer-day table, so a customer with many orders is never one
    huge window and no row is ever repeated in memory."""
    cd = customer_days(invoices)
    w = Window.partitionBy(CUST).orderBy("date")
    stepped = cd.withColumn("_step", F.datediff(F.col("date"), F.lag("date").over(w)))
    return stepped.select(
        CUST,
        "date",
        F.inline(
            F.array(
                F.struct(F.col("_step").alias("gap"), F.lit(1).cast("long").alias("n_gaps")),
                F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n_gaps")),
            )
        ),
    ).where(F.col("gap").isNotNull() & (F.col("n_gaps") > 0))


def impute_zero(df: DataFrame, cols=CHURN_FEATURES) -> DataFrame:
    """``impute_zero``: missing features become 0 (no infinities arise: every
    ratio is guarded)."""
    return df.fillna(0, subset=list(cols))
