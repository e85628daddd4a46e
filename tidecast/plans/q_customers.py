"""Registered queries: customer features, churn labels, risk and interventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import churn, customers
from tidecast.plans.checks import register
from tidecast.plans.sql_oracle import with_ctes
from tidecast.sources import invoices as src

FLOATS = (
    "monetary", "avg_order_value", "log_tenure", "avg_gap", "gap_std", "gap_cv", "min_gap", "max_gap",
    "median_gap", "recency_gap_ratio", "recent_revenue", "prior_revenue", "order_trend", "revenue_trend",
    "seasonality_cv", "orders_per_month", "revenue_per_month", "order_value_cv",
)


def _feat(spark, d):
    return customers.customer_features(src.prepared_invoices(spark, d, "nation", fill_zero=True))


def _scored(spark, d):
    lab = churn.churn_labels(_feat(spark, d))
    return churn.score_columns(churn.standin_probability(lab))


def _subset(name, cols, rnd=None):
    cols = ("customer_no",) + tuple(cols)
    r = tuple(c for c in cols if c in FLOATS) if rnd is None else rnd

    @register(name, with_ctes("custfeat") + f"SELECT {', '.join(cols)} FROM custfeat", rnd=r)
    def q(spark, d):
        return _feat(spark, d).select(*cols)

    return q


_subset("rfm", ("recency", "frequency", "monetary", "avg_order_value"))
_subset("tenure", ("customer_tenure", "log_tenure"))
_subset("gap_stats", ("avg_gap", "gap_std", "gap_cv", "min_gap", "max_gap", "median_gap"))
_subset("period_compare", ("recent_orders", "prior_orders", "recent_revenue", "prior_revenue"))
_subset("trend_ratio", ("order_trend", "revenue_trend"))
_subset("seasonality_cv", ("seasonality_cv",))
_subset("peak_quarter", ("peak_quarter",))
_subset("rate_features", ("orders_per_month", "revenue_per_month"))
_subset("recency_gap_ratio", ("recency", "avg_gap", "recency_gap_ratio"))
_subset("order_value_cv", ("order_value_cv",))
_subset("customer_name_first", ("customer_name",))
_subset(
    "customer_features",
    (
        "customer_name", "recency", "frequency", "monetary", "avg_order_value", "customer_tenure", "log_tenure",
        "avg_gap", "gap_std", "gap_cv", "min_gap", "max_gap", "median_gap", "recency_gap_ratio", "recent_orders",
        "prior_orders", "recent_revenue", "prior_revenue", "order_trend", "revenue_trend", "seasonality_cv",
        "peak_quarter", "orders_per_month", "revenue_per_month", "order_value_cv",
    ),
)


@register(
    "order_gaps",
    with_ctes("invoices_zero")
    + """SELECT customer_no, date, gap, count(*) AS n_gaps FROM (
  SELECT customer_no, invoice_date AS date,
         date_diff('day', lag(invoice_date) OVER (PARTITION BY customer_no ORDER BY invoice_date, invoice_number), invoice_date) AS gap
  FROM invoices_zero) WHERE gap IS NOT NULL GROUP BY 1, 2, 3""",
)
def q_order_gaps(spark, d):
    g = customers.customer_gaps(src.prepared_invoices(spark, d, "nation", fill_zero=True))
    return g.select("customer_no", "date", F.col("gap").cast("bigint").alias("gap"), "n_gaps")


_IMPUTED = ", ".join(f"COALESCE({c}, 0) AS {c}" if c in ("seasonality_cv", "order_value_cv") else c for c in customers.CHURN_FEATURES)


@register(
    "impute_zero",
    with_ctes("custfeat") + f"SELECT customer_no, {_IMPUTED} FROM custfeat",
    rnd=tuple(c for c in customers.CHURN_FEATURES if c in FLOATS),
)
def q_impute(spark, d):
    return customers.impute_zero(_feat(spark, d).select("customer_no", *customers.CHURN_FEATURES))


@register(
    "churn_labels",
    with_ctes("churn_lab") + "SELECT customer_no, recency, recency_gap_ratio, is_churned, is_churned_relative, churn_label FROM churn_lab",
    rnd=("recency_gap_ratio",),
)
def q_labels(spark, d):
    return churn.churn_labels(_feat(spark, d)).select(
        "customer_no", "recency", "recency_gap_ratio", "is_churned", "is_churned_relative", "churn_label"
    )


@register(
    "class_rate",
    with_ctes("churn_lab")
    + """SELECT count(*) AS n_customers, sum(is_churned) AS n_churned, avg(is_churned) AS rate_churned,
       sum(is_churned_relative) AS n_churned_relative, avg(is_churned_relative) AS rate_churned_relative,
       sum(churn_label) AS n_churn_label, avg(churn_label) AS churn_rate FROM churn_lab""",
    rnd=("rate_churned", "rate_churned_relative", "churn_rate"),
)
def q_class_rate(spark, d):
    return churn.class_rate(churn.churn_labels(_feat(spark, d)))


@register(
    "class_weights",
    with_ctes("churn_lab")
    + "SELECT customer_no, churn_label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY churn_label)) AS weight FROM churn_lab",
    rnd=("weight",),
)
def q_class_weights(spark, d):
    return churn.class_weights(churn.churn_labels(_feat(spark, d))).select("customer_no", "churn_label", "weight")


@register(
    "risk_bucket",
    with_ctes("scored") + "SELECT customer_no, p AS churn_probability, risk_category FROM scored",
    rnd=("churn_probability",),
)
def q_risk_bucket(spark, d):
    return _scored(spark, d).select("customer_no", "churn_probability", "risk_category")


@register(
    "revenue_at_risk",
    with_ctes("scored") + "SELECT customer_no, monetary, revenue_at_risk FROM scored",
    rnd=("monetary", "revenue_at_risk"),
)
def q_rev_risk(spark, d):
    return _scored(spark, d).select("customer_no", "monetary", "revenue_at_risk")


@register("mask_name", with_ctes("custfeat") + "SELECT customer_no, CASE WHEN customer_name IS NULL THEN 'Unknown' ELSE substr(customer_name, 1, 1) || '***' END AS masked_name FROM custfeat")
def q_mask(spark, d):
    return _feat(spark, d).select("customer_no", churn.mask_name().alias("masked_name"))


def _sql_interventions() -> str:
    r1 = "COALESCE(monetary > 100000 AND p > 0.7, false)"
    r2 = "COALESCE(revenue_trend < -0.3, false)"
    r3 = "COALESCE(recency_gap_ratio > 2.5 AND prior_orders > 5, false)"
    r4 = "COALESCE(seasonality_cv > 0.5, false)"
    r5 = "COALESCE(customer_tenure < 180 AND p > 0.5, false)"
    parts = [
        (r1, churn.TXT_EXEC), (r1, churn.TXT_OFFER), (r2, churn.TXT_DECLINE), (r3, churn.TXT_QUIET),
        (r3, churn.TXT_CALL), (r4, churn.TXT_SEASONAL), (r5, churn.TXT_NEW),
    ]
    joined = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in parts) + ")"
    default = f"'{churn.TXT_EMAIL} | {churn.TXT_CHECKIN}'"
    return f"""SELECT customer_no, customer_name, p AS churn_probability, risk_category, revenue_at_risk,
       monetary AS total_revenue, recency AS recency_days, order_trend,
       CASE WHEN {r1} THEN 'CRITICAL' WHEN {r2} OR {r3} THEN 'HIGH' ELSE 'MEDIUM' END AS urgency,
       CASE WHEN {joined} = '' THEN {default} ELSE {joined} END AS strategies
FROM scored WHERE p > 0.3"""


@register(
    "interventions",
    with_ctes("scored") + _sql_interventions(),
    rnd=("churn_probability", "revenue_at_risk", "total_revenue", "order_trend"),
)
def q_interventions(spark, d):
    return churn.interventions(_scored(spark, d))


@register(
    "join_strings",
    with_ctes("scored") + "SELECT customer_no, strategies FROM (" + _sql_interventions() + ")",
)
def q_join_strings(spark, d):
    return churn.interventions(_scored(spark, d)).select("customer_no", "strategies")


@register(
    "risk_summary",
    with_ctes("scored")
    + """SELECT risk_category, count(*) AS customers, sum(monetary) AS revenue, sum(revenue_at_risk) AS revenue_at_risk,
       CASE risk_category WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 END AS risk_rank
FROM scored WHERE risk_category IS NOT NULL GROUP BY risk_category""",
    rnd={"revenue": 2, "revenue_at_risk": 2},
)
def q_risk_summary(spark, d):
    return churn.risk_summary(_scored(spark, d))


@register(
    "risk_distribution",
    with_ctes("scored")
    + """SELECT c.risk_category, c.risk_rank, COALESCE(s.customers, 0) AS customers, COALESCE(s.revenue_at_risk, 0) AS revenue_at_risk,
       COALESCE(s.customers, 0) / CAST(sum(COALESCE(s.customers, 0)) OVER () AS DOUBLE) AS share
FROM (VALUES ('Critical', 1), ('High', 2), ('Medium', 3), ('Low', 4)) c(risk_category, risk_rank)
LEFT JOIN (SELECT risk_category, count(*) AS customers, sum(revenue_at_risk) AS revenue_at_risk
           FROM scored WHERE risk_category IS NOT NULL GROUP BY 1) s USING (risk_category)""",
    rnd={"revenue_at_risk": 2, "share": 6},
)
def q_risk_dist(spark, d):
    return churn.risk_distribution(_scored(spark, d))


@register(
    "exec_summary",
    with_ctes("scored")
    + """SELECT count(*) FILTER (WHERE risk_category = 'Critical') AS critical_count,
       count(*) FILTER (WHERE risk_category = 'High') AS high_count,
       COALESCE(sum(revenue_at_risk), 0) AS total_at_risk,
       COALESCE(sum(revenue_at_risk), 0) * 0.25 AS potential_savings FROM scored""",
    rnd={"total_at_risk": 2, "potential_savings": 2},
)
def q_exec(spark, d):
    return churn.exec_summary(_scored(spark, d))


@register(
    "top_at_risk",
    with_ctes("scored") + "SELECT * FROM (" + _sql_interventions() + ") ORDER BY revenue_at_risk DESC, customer_no LIMIT 15",
    rnd=("churn_probability", "revenue_at_risk", "total_revenue", "order_trend"),
)
def q_top_at_risk(spark, d):
    return churn.top_at_risk(churn.interventions(_scored(spark, d)), 15)


@register(
    "histogram",
    with_ctes("scored")
    + """SELECT b.bin, lo + b.bin * (hi - lo) / 30 AS bin_start, lo + (b.bin + 1) * (hi - lo) / 30 AS bin_end,
       COALESCE(c.cnt, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
CROSS JOIN (SELECT min(p) AS lo, max(p) AS hi FROM scored) s
LEFT JOIN (SELECT CAST(CASE WHEN s2.hi = s2.lo THEN 0 ELSE least(floor((p - s2.lo) / ((s2.hi - s2.lo) / 30)), 29) END AS INTEGER) AS bin,
                  count(*) AS cnt
           FROM scored CROSS JOIN (SELECT min(p) AS lo, max(p) AS hi FROM scored) s2 WHERE p IS NOT NULL GROUP BY 1) c
  ON c.bin = b.bin""",
    rnd=("bin_start", "bin_end"),
)
def q_hist(spark, d):
    return churn.histogram(_scored(spark, d), "churn_probability", 30)
