"""Churn labels, risk bands, revenue at risk, interventions and summaries.

All rule logic is column expressions (``when`` chains, ``array_compact``),
evaluated per row inside whole-stage codegen; summaries are single grouped
aggregates over the scored customer table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUST = "customer_no"

# Risk categories, highest first, with their probability bands
# (lower bound exclusive, upper bound inclusive).
RISK_BANDS = (("Critical", 0.7, 1.0), ("High", 0.5, 0.7), ("Medium", 0.3, 0.5), ("Low", 0.0, 0.3))
RISK_ORDER = ("Critical", "High", "Medium", "Low")

# Intervention texts, in rule order.
TXT_EXEC = "🔴 Executive outreach required"
TXT_OFFER = "💰 Prepare custom retention offer"
TXT_DECLINE = "📉 Revenue declining - investigate competitor/product issues"
TXT_QUIET = "⚠️ Previously active customer gone quiet"
TXT_CALL = "📞 Immediate follow-up call"
TXT_SEASONAL = "📅 Seasonal buyer - check timing"
TXT_NEW = "🆕 New customer at risk - onboarding review"
TXT_EMAIL = "📧 Send engagement email"
TXT_CHECKIN = "📞 Schedule check-in call"


def _true(c: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(c, F.lit(False))


def churn_labels(feat: DataFrame, churn_days: int = 90, ratio: float = 2.0) -> DataFrame:
    """``churn_labels``: absolute (recency > churn_days), relative
    (recency / mean gap > ratio) and their OR, as 0/1."""
    absolute = _true(F.col("recency") > churn_days)
    relative = _true(F.col("recency_gap_ratio") > ratio)
    return feat.withColumns(
        {
            "is_churned": absolute.cast("int"),
            "is_churned_relative": relative.cast("int"),
            "churn_label": (absolute | relative).cast("int"),
        }
    )


def class_rate(labelled: DataFrame) -> DataFrame:
    """``class_rate``: count and rate of each label."""
    return labelled.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.sum("is_churned").alias("n_churned"),
        F.avg("is_churned").alias("rate_churned"),
        F.sum("is_churned_relative").alias("n_churned_relative"),
        F.avg("is_churned_relative").alias("rate_churned_relative"),
        F.sum("churn_label").alias("n_churn_label"),
        F.avg("churn_label").alias("churn_rate"),
    )


def class_weights(df: DataFrame, label: str = "churn_label", mode: str = "balanced", pos_weight: float = 3.0) -> DataFrame:
    """``class_weights``: ``balanced`` = n / (2 * n_class); ``positive`` =
    ``pos_weight`` on positives, 1 on negatives."""
    if mode == "positive":
        return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(pos_weight)).otherwise(F.lit(1.0)))
    # Class counts: a grouped aggregate (one row per class), joined back as
    # a broadcast; no window without a partition key, so no single task
    # ever sees every customer.
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("_n"))
    per_class = counts.crossJoin(total).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(per_class), label, "left")


def standin_probability(feat: DataFrame, days: int = 365) -> DataFrame:
    """SQL-expressible stand-in score: ``least(1, recency / days)``."""
    return feat.withColumn("churn_probability", F.least(F.lit(1.0), F.col("recency") / float(days)))


def risk_bucket(col: str | Column = "churn_probability") -> Column:
    """``risk_bucket``: (0,.3] Low, (.3,.5] Medium, (.5,.7] High, (.7,1]
    Critical; 0 and out-of-range values are NULL."""
    p = F.col(col) if isinstance(col, str) else col
    expr = F.when(p.isNull(), F.lit(None))
    for name, lo, hi in RISK_BANDS:
        expr = expr.when((p > lo) & (p <= hi), F.lit(name))
    return expr


def risk_rank(col: str | Column = "risk_category") -> Column:
    """Explicit order of the categories (Critical = 1 ... Low = 4)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull(), F.lit(None))
    for i, name in enumerate(RISK_ORDER, 1):
        expr = expr.when(c == name, F.lit(i))
    return expr


def score_columns(scored: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """``risk_bucket`` + ``revenue_at_risk`` on a scored customer table."""
    return scored.withColumns(
        {"risk_category": risk_bucket(prob), "revenue_at_risk": F.col(prob) * F.col("monetary")}
    )


def mask_name(col: str = "customer_name") -> Column:
    """``mask_name``: first letter + ``***``; missing -> ``Unknown``."""
    c = F.col(col)
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(F.concat(F.substring(c, 1, 1), F.lit("***")))


def interventions(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``interventions``: customers with probability > threshold, their
    urgency and ' | '-joined strategies, by revenue at risk (descending)."""
    p = F.col("churn_probability")
    r1 = _true((F.col("monetary") > 100000) & (p > 0.7))
    r2 = _true(F.col("revenue_trend") < -0.3)
    r3 = _true((F.col("recency_gap_ratio") > 2.5) & (F.col("prior_orders") > 5))
    r4 = _true(F.col("seasonality_cv") > 0.5)
    r5 = _true((F.col("customer_tenure") < 180) & (p > 0.5))
    hits = F.array_compact(
        F.array(
            F.when(r1, F.lit(TXT_EXEC)),
            F.when(r1, F.lit(TXT_OFFER)),
            F.when(r2, F.lit(TXT_DECLINE)),
            F.when(r3, F.lit(TXT_QUIET)),
            F.when(r3, F.lit(TXT_CALL)),
            F.when(r4, F.lit(TXT_SEASONAL)),
            F.when(r5, F.lit(TXT_NEW)),
        )
    )
    strategies = F.when(F.size(hits) == 0, F.array(F.lit(TXT_EMAIL), F.lit(TXT_CHECKIN))).otherwise(hits)
    urgency = F.when(r1, "CRITICAL").when(r2 | r3, "HIGH").otherwise("MEDIUM")
    return scored.where(_true(p > threshold)).select(
        CUST,
        "customer_name",
        "churn_probability",
        "risk_category",
        "revenue_at_risk",
        F.col("monetary").alias("total_revenue"),
        F.col("recency").alias("recency_days"),
        "order_trend",
        urgency.alias("urgency"),
        F.array_join(strategies, " | ").alias("strategies"),
    )


def risk_summary(scored: DataFrame) -> DataFrame:
    """``risk_summary``: customers, revenue and revenue at risk per category."""
    return (
        scored.where(F.col("risk_category").isNotNull())
        .groupBy("risk_category")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("monetary").alias("revenue"),
            F.sum("revenue_at_risk").alias("revenue_at_risk"),
        )
        .withColumn("risk_rank", risk_rank())
    )


def risk_distribution(scored: DataFrame) -> DataFrame:
    """``risk_distribution``: count and share per category, absent
    categories shown with 0 (the 4-row category dimension drives the join)."""
    spark = scored.sparkSession
    from tidecast.session import literal_frame

    cats = literal_frame(spark, [(n, i) for i, n in enumerate(RISK_ORDER, 1)], "risk_category string, risk_rank int")
    counts = scored.where(F.col("risk_category").isNotNull()).groupBy("risk_category").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue_at_risk").alias("revenue_at_risk")
    )
    j = F.broadcast(cats).join(counts, "risk_category", "left").fillna(0, subset=["customers", "revenue_at_risk"])
    total = F.sum("customers").over(Window.partitionBy())
    return j.withColumn("share", F.try_divide(F.col("customers").cast("double"), total.cast("double")))


def exec_summary(scored: DataFrame, save_rate: float = 0.25) -> DataFrame:
    """``exec_summary``: critical and high counts, total revenue at risk and
    potential savings at ``save_rate``."""
    return scored.agg(
        F.count_if(F.col("risk_category") == "Critical").alias("critical_count"),
        F.count_if(F.col("risk_category") == "High").alias("high_count"),
        F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("total_at_risk"),
    ).withColumn("potential_savings", F.col("total_at_risk") * save_rate)


def top_at_risk(table: DataFrame, k: int = 15) -> DataFrame:
    """``top_at_risk``: the k customers with the highest revenue at risk
    (a top-k: Spark plans it as a per-partition top-k + merge)."""
    return table.orderBy(F.col("revenue_at_risk").desc_nulls_last(), F.col(CUST)).limit(k)


def histogram(df: DataFrame, col: str = "churn_probability", bins: int = 30) -> DataFrame:
    """``histogram``: equal-width bins between the column's min and max
    (the max falls in the last bin); counts per bin, empty bins included."""
    stats = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))
    ).cast("int")
    # ``stats`` is one row: broadcasting it is always safe.
    counted = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(stats)).groupBy(idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    edges = all_bins.crossJoin(F.broadcast(stats)).select(
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
    )
    return edges.join(counted, "bin", "left").fillna(0, subset=["count"])
