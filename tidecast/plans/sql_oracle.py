"""DuckDB SQL twins of the Spark queries (the correctness oracle).

Shared building blocks are named common table expressions; ``with_ctes``
emits the ones a query needs, dependencies first. The SQL mirrors the
documented semantics, not the Spark code: it is written the way an analyst
would write each step directly in SQL.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, body)


def with_ctes(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n"


def invoices_cte(series: str = "nation") -> str:
    key = {
        "nation": "CAST(c.c_nationkey AS VARCHAR)",
        "segment": "c.c_mktsegment",
        "all": "'ALL'",
    }[series]
    return f"""SELECT CAST(o.o_orderkey AS VARCHAR) AS invoice_number,
       CAST(o.o_orderdate AS DATE) AS invoice_date,
       CAST(o.o_custkey AS VARCHAR) AS customer_no,
       c.c_name AS customer_name,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
       {key} AS series_key
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE (CASE WHEN o.o_orderstatus = 'P' THEN 'CM' ELSE 'IN' END) = 'IN'"""


cte("invoices", invoices_cte("nation"))
cte("invoices_all", invoices_cte("all"))
cte(
    "invoices_zero",
    """SELECT invoice_number, invoice_date, customer_no, customer_name,
       COALESCE(amount, CAST(0 AS DECIMAL(18,2))) AS amount, series_key
FROM invoices""",
    ("invoices",),
)

for _src, _name in (("invoices", "daily"), ("invoices_all", "daily_all")):
    cte(
        f"{_name}_raw",
        f"""SELECT series_key, invoice_date AS date,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS sales,
       COUNT(invoice_number) AS invoice_count,
       COUNT(DISTINCT customer_no) AS customer_count
FROM {_src} GROUP BY series_key, invoice_date""",
        (_src,),
    )
    cte(
        f"{_name}_cal",
        f"""SELECT series_key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT series_key, MIN(date) AS lo, MAX(date) AS hi FROM {_name}_raw GROUP BY series_key)""",
        (f"{_name}_raw",),
    )
    cte(
        _name,
        f"""SELECT c.series_key, c.date,
       COALESCE(d.sales, 0.0) AS sales,
       COALESCE(d.invoice_count, 0) AS invoice_count,
       COALESCE(d.customer_count, 0) AS customer_count
FROM {_name}_cal c LEFT JOIN {_name}_raw d ON c.series_key = d.series_key AND c.date = d.date""",
        (f"{_name}_cal", f"{_name}_raw"),
    )
    cte(
        f"{_name}_split",
        f"""SELECT *, CAST(max(date) OVER (PARTITION BY series_key) - INTERVAL 30 DAY AS DATE) AS cutoff,
       CASE WHEN date <= CAST(max(date) OVER (PARTITION BY series_key) - INTERVAL 30 DAY AS DATE)
            THEN 'train' ELSE 'test' END AS role
FROM {_name}""",
        (_name,),
    )

cte(
    "naive_pred",
    """SELECT t.series_key, 'seasonal_naive' AS model, t.date, t.sales AS actual,
       COALESCE(p.sales, m.train_mean) AS yhat,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM daily_split t
LEFT JOIN daily_split p ON p.role = 'train' AND p.series_key = t.series_key
      AND p.date = CAST(t.date - INTERVAL 7 DAY AS DATE)
LEFT JOIN (SELECT series_key, CAST(sum(CAST(sales AS DECIMAL(20,2))) AS DOUBLE) / count(sales) AS train_mean FROM daily_split WHERE role = 'train' GROUP BY series_key) m
      ON m.series_key = t.series_key
WHERE t.role = 'test'""",
    ("daily_split",),
)

cte(
    "standin_pred",
    """SELECT t.series_key, 'last_week' AS model, t.date, t.sales AS actual,
       COALESCE(p.sales, m.train_mean) AS yhat
FROM daily_split t
LEFT JOIN daily_split p ON p.role = 'train' AND p.series_key = t.series_key
      AND p.date = CAST(t.date - INTERVAL 7 DAY AS DATE)
LEFT JOIN (SELECT series_key, CAST(sum(CAST(sales AS DECIMAL(20,2))) AS DOUBLE) / count(sales) AS train_mean FROM daily_split WHERE role = 'train' GROUP BY series_key) m
      ON m.series_key = t.series_key
WHERE t.role = 'test'
UNION ALL
SELECT t.series_key, 'weekday_mean', t.date, t.sales, w.yhat
FROM daily_split t
LEFT JOIN (SELECT series_key, isodow(date) - 1 AS wd, CAST(sum(CAST(sales AS DECIMAL(20,2))) AS DOUBLE) / count(sales) AS yhat
           FROM daily_split WHERE role = 'train' GROUP BY 1, 2) w
      ON w.series_key = t.series_key AND w.wd = isodow(t.date) - 1
WHERE t.role = 'test'
UNION ALL
SELECT t.series_key, 'trailing_28', t.date, t.sales, r.yhat
FROM daily_split t
LEFT JOIN (SELECT series_key, CAST(sum(CAST(sales AS DECIMAL(20,2))) AS DOUBLE) / count(sales) AS yhat FROM (
             SELECT series_key, sales, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS rn
             FROM daily_split WHERE role = 'train') WHERE rn <= 28 GROUP BY series_key) r
      ON r.series_key = t.series_key
WHERE t.role = 'test'""",
    ("daily_split",),
)

cte(
    "standin_long",
    """SELECT series_key, model, date, actual, yhat, yhat * 0.8 AS lower, yhat * 1.2 AS upper FROM standin_pred""",
    ("standin_pred",),
)


def metrics_select(src: str, keys: str = "series_key, model") -> str:
    return f"""SELECT {keys},
       avg(abs(yhat - actual)) AS mae,
       sqrt(avg((yhat - actual) * (yhat - actual))) AS rmse,
       avg(CASE WHEN actual > 0 THEN abs(yhat - actual) / actual END) * 100 AS mape,
       sum(yhat) AS total_predicted,
       sum(actual) AS total_actual,
       count(*) AS n,
       (sum(yhat) - sum(actual)) / nullif(sum(actual), 0) * 100 AS total_error_pct
FROM {src} GROUP BY {keys}"""


cte("standin_metrics", metrics_select("standin_long"), ("standin_long",))


# ------------------------------------------------------------------ features
W_KEY = "PARTITION BY series_key ORDER BY date"

SQL_PARTS = {
    "year": "CAST(year(date) AS INTEGER)",
    "month": "CAST(month(date) AS INTEGER)",
    "day": "CAST(day(date) AS INTEGER)",
    "day_of_week": "CAST(isodow(date) - 1 AS INTEGER)",
    "day_of_year": "CAST(dayofyear(date) AS INTEGER)",
    "week_of_year": "CAST(week(date) AS INTEGER)",
    "quarter": "CAST(quarter(date) AS INTEGER)",
}
SQL_FLAGS = {
    "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
    "is_monday": "CAST(isodow(date) = 1 AS INTEGER)",
    "is_friday": "CAST(isodow(date) = 5 AS INTEGER)",
    "is_month_start": "CAST(day(date) = 1 AS INTEGER)",
    "is_month_end": "CAST(last_day(date) = date AS INTEGER)",
    "is_quarter_start": "CAST(CAST(date_trunc('quarter', date) AS DATE) = date AS INTEGER)",
    "is_quarter_end": "CAST(CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) = date AS INTEGER)",
}


def sql_cyclical(with_doy: bool = True) -> dict[str, str]:
    out = {}
    for name, x, p in (("dow", "(isodow(date) - 1)", 7), ("month", "month(date)", 12), ("day_of_year", "dayofyear(date)", 365)):
        if name == "day_of_year" and not with_doy:
            continue
        out[f"{name}_sin"] = f"sin(2 * pi() * {x} / {p}.0)"
        out[f"{name}_cos"] = f"cos(2 * pi() * {x} / {p}.0)"
    return out


def sql_lags(lags, prefix="lag_") -> dict[str, str]:
    return {f"{prefix}{n}": f"lag(sales, {n}) OVER ({W_KEY})" for n in lags}


def sql_rolling(windows, stats) -> dict[str, str]:
    fn = {"mean": "avg(sales)", "std": "stddev_samp(sales)", "min": "min(sales)", "max": "max(sales)",
          "median": "quantile_cont(sales, 0.5)"}
    out = {}
    for w in windows:
        frame = f"({W_KEY} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for s in stats:
            out[f"rolling_{s}_{w}"] = f"CASE WHEN count(sales) OVER {frame} = {w} THEN {fn[s]} OVER {frame} END"
    return out


def sql_expanding(stats) -> dict[str, str]:
    frame = f"({W_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    x = "CAST(sales AS DECIMAL(20,2))"
    n = f"count(sales) OVER {frame}"
    s1 = f"sum({x}) OVER {frame}"
    s2 = f"sum({x} * {x}) OVER {frame}"
    fn = {
        "mean": f"CASE WHEN {n} > 0 THEN CAST({s1} AS DOUBLE) / {n} END",
        "std": f"CASE WHEN {n} > 1 THEN sqrt(greatest(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE), 0.0) / CAST({n} * ({n} - 1) AS DOUBLE)) END",
    }
    return {f"expanding_{s}": fn[s] for s in stats}


SQL_DAYS_SINCE_START = "CAST(date_diff('day', min(date) OVER (PARTITION BY series_key), date) AS INTEGER)"
SQL_WOW = {
    "wow_change": f"lag(sales, 1) OVER ({W_KEY}) - lag(sales, 8) OVER ({W_KEY})",
    "wow_pct_change": f"lag(sales, 1) OVER ({W_KEY}) / nullif(lag(sales, 8) OVER ({W_KEY}), 0) - 1",
}


def sql_select(cols: dict[str, str], base: str = "series_key, date, sales", src: str = "daily") -> str:
    body = ",\n       ".join(f"{e} AS {n}" for n, e in cols.items())
    return f"SELECT {base},\n       {body}\nFROM {src}"


def sql_full_features() -> str:
    inner = {}
    inner.update(SQL_PARTS)
    inner.update(SQL_FLAGS)
    inner.update(sql_cyclical(True))
    inner.update(sql_lags((1, 2, 3, 5, 7, 14, 21, 28)))
    inner.update(sql_rolling((7, 14, 21, 28), ("mean", "std", "min", "max", "median")))
    inner.update(sql_expanding(("mean", "std")))
    for n, name in ((7, "same_day_last_week"), (14, "same_day_2_weeks_ago"), (21, "same_day_3_weeks_ago"), (28, "same_day_4_weeks_ago")):
        inner[name] = f"lag(sales, {n}) OVER ({W_KEY})"
    inner.update(SQL_WOW)
    inner["days_since_start"] = SQL_DAYS_SINCE_START
    outer = ("*, rolling_max_7 - rolling_min_7 AS rolling_range_7, rolling_std_7 / nullif(rolling_mean_7, 0) AS rolling_cv_7,"
             " rolling_max_14 - rolling_min_14 AS rolling_range_14, rolling_std_14 / nullif(rolling_mean_14, 0) AS rolling_cv_14")
    return f"SELECT {outer} FROM (\n{sql_select(inner)}\n)"


# ------------------------------------------------------------------ customers
cte("ref", "SELECT CAST(max(invoice_date) + INTERVAL 1 DAY AS DATE) AS ref_date FROM invoices_zero", ("invoices_zero",))
cte(
    "cust_gaps",
    """SELECT customer_no,
       date_diff('day', lag(invoice_date) OVER (PARTITION BY customer_no ORDER BY invoice_date, invoice_number), invoice_date) AS gap
FROM invoices_zero""",
    ("invoices_zero",),
)
cte(
    "cust_gap_stats",
    """SELECT customer_no, count(gap) AS m, avg(gap) AS avg_gap, stddev_samp(gap) AS gap_std,
       min(gap) AS min_gap, max(gap) AS max_gap, quantile_cont(gap, 0.5) AS median_gap
FROM cust_gaps WHERE gap IS NOT NULL GROUP BY customer_no""",
    ("cust_gaps",),
)
cte(
    "cust_quarters",
    """SELECT customer_no, stddev_samp(cnt) AS q_std, avg(cnt) AS q_mean,
       max(CASE WHEN rn = 1 THEN q END) AS peak_quarter
FROM (SELECT customer_no, q, cnt, row_number() OVER (PARTITION BY customer_no ORDER BY cnt DESC, q) AS rn
      FROM (SELECT customer_no, quarter(invoice_date) AS q, count(*) AS cnt FROM invoices_zero GROUP BY 1, 2))
GROUP BY customer_no""",
    ("invoices_zero",),
)
cte(
    "cust_base",
    """SELECT i.customer_no,
       first(i.customer_name ORDER BY i.invoice_date, i.invoice_number) AS customer_name,
       CAST(date_diff('day', max(i.invoice_date), any_value(r.ref_date)) AS INTEGER) AS recency,
       count(*) AS frequency,
       CAST(sum(i.amount) AS DOUBLE) AS monetary,
       CAST(sum(i.amount) AS DOUBLE) / count(*) AS avg_order_value,
       stddev_samp(CAST(i.amount AS DOUBLE)) AS amount_std,
       CAST(date_diff('day', min(i.invoice_date), any_value(r.ref_date)) AS INTEGER) AS customer_tenure,
       count(*) FILTER (WHERE i.invoice_date >= r.ref_date - INTERVAL 180 DAY) AS recent_orders,
       count(*) FILTER (WHERE i.invoice_date >= r.ref_date - INTERVAL 365 DAY AND i.invoice_date < r.ref_date - INTERVAL 180 DAY) AS prior_orders,
       CAST(COALESCE(sum(i.amount) FILTER (WHERE i.invoice_date >= r.ref_date - INTERVAL 180 DAY), 0) AS DOUBLE) AS recent_revenue,
       CAST(COALESCE(sum(i.amount) FILTER (WHERE i.invoice_date >= r.ref_date - INTERVAL 365 DAY AND i.invoice_date < r.ref_date - INTERVAL 180 DAY), 0) AS DOUBLE) AS prior_revenue
FROM invoices_zero i CROSS JOIN ref r GROUP BY i.customer_no""",
    ("invoices_zero", "ref"),
)
cte(
    "custfeat_raw",
    """SELECT b.*, g.m,
       CASE WHEN b.frequency > 1 THEN g.avg_gap ELSE CAST(b.customer_tenure AS DOUBLE) END AS avg_gap,
       CASE WHEN b.frequency > 1 AND g.m > 1 THEN g.gap_std ELSE 0.0 END AS gap_std,
       CAST(CASE WHEN b.frequency > 1 THEN g.min_gap ELSE b.customer_tenure END AS DOUBLE) AS min_gap,
       CAST(CASE WHEN b.frequency > 1 THEN g.max_gap ELSE b.customer_tenure END AS DOUBLE) AS max_gap,
       CAST(CASE WHEN b.frequency > 1 THEN g.median_gap ELSE b.customer_tenure END AS DOUBLE) AS median_gap,
       q.q_std, q.q_mean, q.peak_quarter
FROM cust_base b LEFT JOIN cust_gap_stats g USING (customer_no) LEFT JOIN cust_quarters q USING (customer_no)""",
    ("cust_base", "cust_gap_stats", "cust_quarters"),
)
cte(
    "custfeat",
    """SELECT customer_no, customer_name, recency, frequency, monetary, avg_order_value, customer_tenure,
       ln(1 + customer_tenure) AS log_tenure,
       avg_gap, gap_std,
       CASE WHEN avg_gap > 0 THEN gap_std / avg_gap ELSE 0.0 END AS gap_cv,
       min_gap, max_gap, median_gap,
       CASE WHEN avg_gap > 0 THEN recency / avg_gap ELSE CAST(recency AS DOUBLE) END AS recency_gap_ratio,
       recent_orders, prior_orders, recent_revenue, prior_revenue,
       CASE WHEN prior_orders > 0 THEN (recent_orders - prior_orders) / CAST(prior_orders AS DOUBLE)
            WHEN recent_orders > 0 THEN 1.0 ELSE -1.0 END AS order_trend,
       CASE WHEN prior_revenue > 0 THEN (recent_revenue - prior_revenue) / prior_revenue
            WHEN recent_revenue > 0 THEN 1.0 ELSE -1.0 END AS revenue_trend,
       CASE WHEN q_mean > 0 THEN q_std / q_mean ELSE 0.0 END AS seasonality_cv,
       CAST(peak_quarter AS INTEGER) AS peak_quarter,
       frequency / greatest(customer_tenure / 30.0, 1.0) AS orders_per_month,
       monetary / greatest(customer_tenure / 30.0, 1.0) AS revenue_per_month,
       CASE WHEN avg_order_value > 0 THEN amount_std / avg_order_value ELSE 0.0 END AS order_value_cv
FROM custfeat_raw""",
    ("custfeat_raw",),
)
cte(
    "churn_lab",
    """SELECT *, CAST(COALESCE(recency > 90, false) AS INTEGER) AS is_churned,
       CAST(COALESCE(recency_gap_ratio > 2.0, false) AS INTEGER) AS is_churned_relative,
       CAST(COALESCE(recency > 90, false) OR COALESCE(recency_gap_ratio > 2.0, false) AS INTEGER) AS churn_label
FROM custfeat""",
    ("custfeat",),
)
cte(
    "scored",
    """SELECT *,
       CASE WHEN p > 0.7 AND p <= 1.0 THEN 'Critical' WHEN p > 0.5 AND p <= 0.7 THEN 'High'
            WHEN p > 0.3 AND p <= 0.5 THEN 'Medium' WHEN p > 0.0 AND p <= 0.3 THEN 'Low' END AS risk_category,
       p * monetary AS revenue_at_risk
FROM (SELECT *, least(1.0, recency / 365.0) AS p FROM churn_lab)""",
    ("churn_lab",),
)


# ------------------------------------------------------------------ ensemble
cte(
    "ens_long",
    """SELECT series_key, model, date, actual, yhat,
       CASE WHEN model = 'trailing_28' THEN NULL ELSE lower END AS lower,
       CASE WHEN model = 'trailing_28' THEN NULL ELSE upper END AS upper
FROM standin_long""",
    ("standin_long",),
)
cte(
    "ens_weights",
    """SELECT * FROM (VALUES ('last_week', CAST(0.5 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)),
                     ('weekday_mean', CAST(0.3 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)),
                     ('trailing_28', CAST(0.2 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(1.3 AS DOUBLE))) w(model, weight, band_lo, band_hi)""",
)
cte(
    "ens",
    """SELECT series_key, date,
       greatest(sum(weight * yhat) / sum(weight), 0.0) AS ensemble,
       greatest(sum(weight * COALESCE(lower, yhat * band_lo)) / sum(weight), 0.0) AS ensemble_lower,
       sum(weight * COALESCE(upper, yhat * band_hi)) / sum(weight) AS ensemble_upper,
       count(*) AS n_models, dayname(date) AS day_of_week
FROM ens_long JOIN ens_weights USING (model) GROUP BY series_key, date""",
    ("ens_long", "ens_weights"),
)


cte("invoices_segment", invoices_cte("segment"))
