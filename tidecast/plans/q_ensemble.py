"""Registered queries: folds, ranking, weights, ensemble, spreads, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import baselines, churn, customers, daily, ensemble, metrics, splits
from tidecast.plans.checks import register
from tidecast.plans.sql_oracle import with_ctes
from tidecast.sources import invoices as src

KEY = "series_key"
STANDIN_WEIGHTS = {"last_week": 0.5, "weekday_mean": 0.3, "trailing_28": 0.2}
STANDIN_BANDS = {"trailing_28": (0.7, 1.3)}


def _daily(spark, d):
    return daily.gap_fill(daily.daily_sales(src.prepared_invoices(spark, d)))


def _split(spark, d):
    return daily.holdout_split(_daily(spark, d), 30)


def _long(spark, d):
    return baselines.standin_forecasts(_split(spark, d))


def _ens_long(spark, d):
    lg = _long(spark, d)
    t28 = F.col("model") == "trailing_28"
    return lg.withColumns({"lower": F.when(~t28, F.col("lower")), "upper": F.when(~t28, F.col("upper"))})


def _weights(spark):
    return ensemble.weights_frame(spark, STANDIN_WEIGHTS, STANDIN_BANDS)


def _metrics(spark, d):
    return metrics.forecast_metrics(_long(spark, d))


@register(
    "time_series_folds",
    with_ctes("daily")
    + """SELECT series_key, date, sales, fold, CASE WHEN rn <= n - (6 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT series_key, date, sales, row_number() OVER (PARTITION BY series_key ORDER BY date) AS rn,
             count(*) OVER (PARTITION BY series_key) AS n FROM daily) d,
     (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 6)) f
WHERE rn <= n - (5 - fold) * (n // 6) AND n // 6 > 0""",
)
def q_ts_folds(spark, d):
    return splits.time_series_folds(_daily(spark, d).select(KEY, "date", "sales"), 5)


@register(
    "contiguous_folds",
    with_ctes("daily") + "SELECT series_key, date, sales, CAST(ntile(3) OVER (PARTITION BY series_key ORDER BY date) AS INTEGER) AS fold FROM daily",
)
def q_contig(spark, d):
    return splits.contiguous_folds(_daily(spark, d).select(KEY, "date", "sales"), 3)


_ENS_RND = ("ensemble", "ensemble_lower", "ensemble_upper")


@register("weighted_ensemble", with_ctes("ens") + "SELECT * FROM ens", rnd=_ENS_RND)
def q_weighted(spark, d):
    return ensemble.weighted_ensemble(_ens_long(spark, d), _weights(spark))


@register(
    "ensemble_interval",
    with_ctes("ens") + "SELECT series_key, date, ensemble_lower, ensemble_upper FROM ens",
    rnd=("ensemble_lower", "ensemble_upper"),
)
def q_interval(spark, d):
    return ensemble.weighted_ensemble(_ens_long(spark, d), _weights(spark)).select(KEY, "date", "ensemble_lower", "ensemble_upper")


@register(
    "scan_optional_source",
    with_ctes("ens_long", "ens_weights")
    + """SELECT series_key, date,
       greatest(sum(weight * yhat) / sum(weight), 0.0) AS ensemble,
       greatest(sum(weight * COALESCE(lower, yhat * band_lo)) / sum(weight), 0.0) AS ensemble_lower,
       sum(weight * COALESCE(upper, yhat * band_hi)) / sum(weight) AS ensemble_upper,
       count(*) AS n_models, dayname(date) AS day_of_week
FROM (SELECT * FROM ens_long WHERE model <> 'weekday_mean') JOIN ens_weights USING (model) GROUP BY series_key, date""",
    rnd=_ENS_RND,
)
def q_optional(spark, d):
    # One forecaster is missing: the other two are blended with renormalised weights.
    lg = _ens_long(spark, d).where(F.col("model") != "weekday_mean")
    return ensemble.weighted_ensemble(lg, _weights(spark))


@register(
    "weights_join",
    with_ctes("ens_long", "ens_weights") + "SELECT series_key, model, date, yhat, weight, weight * yhat AS weighted FROM ens_long JOIN ens_weights USING (model)",
    rnd={"yhat": 6, "weighted": 4},
)
def q_weights_join(spark, d):
    j = _ens_long(spark, d).join(F.broadcast(_weights(spark)), "model")
    return j.select(KEY, "model", "date", "yhat", "weight", (F.col("weight") * F.col("yhat")).alias("weighted"))


@register(
    "align_forecasts",
    with_ctes("standin_long")
    + """SELECT series_key, date,
       max(CASE WHEN model = 'last_week' THEN greatest(yhat, 0.0) END) AS last_week,
       max(CASE WHEN model = 'weekday_mean' THEN greatest(yhat, 0.0) END) AS weekday_mean,
       max(CASE WHEN model = 'trailing_28' THEN greatest(yhat, 0.0) END) AS trailing_28
FROM standin_long GROUP BY series_key, date""",
    rnd=("last_week", "weekday_mean", "trailing_28"),
)
def q_align(spark, d):
    lg = _long(spark, d)
    return lg.groupBy(KEY, "date").pivot("model", list(STANDIN_WEIGHTS)).agg(F.first(F.greatest(F.col("yhat"), F.lit(0.0))))


_STAND_FOR = {"last_week": "seasonal_arx", "weekday_mean": "boosted_trees", "trailing_28": "decompose"}
_STAND_SQL = "CASE model " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STAND_FOR.items()) + " END"
_FALLBACK_SQL = "CASE m " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in ensemble.FALLBACK_WEIGHTS.items()) + " END"


@register(
    "ensemble_fallback",
    with_ctes("standin_long")
    + f"""SELECT series_key, date, greatest(sum({_FALLBACK_SQL} * yhat) / sum({_FALLBACK_SQL}), 0.0) AS ensemble, count(*) AS n_models
FROM (SELECT series_key, date, yhat, {_STAND_SQL} AS m FROM standin_long) WHERE m IS NOT NULL GROUP BY series_key, date""",
    rnd=("ensemble",),
)
def q_three_models(spark, d):
    # No regressor forecast: the three-model weights apply.
    names = F.create_map(*[F.lit(x) for pair in _STAND_FOR.items() for x in pair])
    lg = _long(spark, d).withColumn("model", names[F.col("model")]).where("model is not null")
    return ensemble.weighted_ensemble(lg, ensemble.weights_for(lg)).select("series_key", "date", "ensemble", "n_models")


@register(
    "sklearn_fallback",
    with_ctes("standin_long")
    + """SELECT l.series_key, 'stacking' AS model, l.date, l.yhat FROM standin_long l
JOIN (SELECT series_key, min(CASE model WHEN 'stacking' THEN 1 WHEN 'trailing_28' THEN 2 WHEN 'weekday_mean' THEN 3 END) AS p
      FROM standin_long WHERE model IN ('stacking', 'trailing_28', 'weekday_mean') GROUP BY 1) b
  ON l.series_key = b.series_key
 AND CASE l.model WHEN 'stacking' THEN 1 WHEN 'trailing_28' THEN 2 WHEN 'weekday_mean' THEN 3 END = b.p""",
    rnd=("yhat",),
)
def q_fallback(spark, d):
    # No stacking forecast exists here, so the next model in priority is used.
    return ensemble.pick_stacked(_long(spark, d), ("stacking", "trailing_28", "weekday_mean")).select(KEY, "model", "date", "yhat")


@register(
    "ensemble_avg",
    with_ctes("standin_long") + "SELECT series_key, date, avg(yhat) AS ensemble_avg, count(*) AS n_models FROM standin_long GROUP BY 1, 2",
    rnd=("ensemble_avg",),
)
def q_avg(spark, d):
    return ensemble.ensemble_avg(_long(spark, d))


@register(
    "model_spread",
    with_ctes("standin_long")
    + """SELECT series_key, date, min(yhat) AS min_pred, max(yhat) AS max_pred, avg(yhat) AS mean_pred, stddev_samp(yhat) AS std_pred
FROM standin_long GROUP BY 1, 2""",
    rnd=("min_pred", "max_pred", "mean_pred", "std_pred"),
)
def q_spread(spark, d):
    return ensemble.model_spread(_long(spark, d))[0]


@register(
    "consensus_band",
    with_ctes("standin_long")
    + """SELECT series_key, avg(std_pred) AS mean_std, avg(std_pred / nullif(mean_pred, 0)) AS mean_cv,
       CASE WHEN avg(std_pred / nullif(mean_pred, 0)) < 0.3 THEN 'Strong' WHEN avg(std_pred / nullif(mean_pred, 0)) < 0.5 THEN 'Moderate'
            WHEN avg(std_pred / nullif(mean_pred, 0)) IS NOT NULL THEN 'Weak' END AS consensus
FROM (SELECT series_key, date, avg(yhat) AS mean_pred, stddev_samp(yhat) AS std_pred FROM standin_long GROUP BY 1, 2) GROUP BY 1""",
    rnd=("mean_std", "mean_cv"),
)
def q_consensus(spark, d):
    return ensemble.model_spread(_long(spark, d))[1]


@register(
    "cumulative_forecast",
    with_ctes("standin_long")
    + """SELECT series_key, model, date, yhat, lower, upper,
       sum(yhat) OVER w AS cum_yhat, sum(lower) OVER w AS cum_lower, sum(upper) OVER w AS cum_upper
FROM standin_long WINDOW w AS (PARTITION BY series_key, model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    rnd={"yhat": 6, "lower": 6, "upper": 6, "cum_yhat": 4, "cum_lower": 4, "cum_upper": 4},
)
def q_cum(spark, d):
    return ensemble.cumulative(_long(spark, d).drop("actual"))


@register(
    "forecast_totals",
    with_ctes("standin_long")
    + "SELECT series_key, model, sum(yhat) AS total, avg(yhat) AS daily_avg, min(yhat) AS min_day, max(yhat) AS max_day, count(*) AS days FROM standin_long GROUP BY 1, 2",
    rnd=("total", "daily_avg", "min_day", "max_day"),
)
def q_totals(spark, d):
    return ensemble.forecast_totals(_long(spark, d))


@register(
    "vs_history",
    with_ctes("standin_long", "daily")
    + """SELECT t.series_key, t.model, t.forecast_total, h.hist_daily_avg, h.hist_daily_avg * t.horizon AS hist_est, h.recent_actual,
       (t.forecast_total / nullif(h.hist_daily_avg * t.horizon, 0) - 1) * 100 AS vs_hist_pct,
       (t.forecast_total / nullif(h.recent_actual, 0) - 1) * 100 AS vs_recent_pct
FROM (SELECT series_key, model, sum(yhat) AS forecast_total, count(*) AS horizon FROM standin_long GROUP BY 1, 2) t
JOIN (SELECT series_key, avg(sales) AS hist_daily_avg, sum(CASE WHEN rn <= 30 THEN sales END) AS recent_actual
      FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS rn FROM daily) GROUP BY 1) h
  ON t.series_key = h.series_key""",
    rnd=("forecast_total", "hist_daily_avg", "hist_est", "recent_actual", "vs_hist_pct", "vs_recent_pct"),
)
def q_vs_hist(spark, d):
    return ensemble.vs_history(_long(spark, d), _daily(spark, d))


@register(
    "horizon_head",
    with_ctes("daily")
    + """SELECT f.series_key, f.date, f.step FROM (
  SELECT series_key, CAST(last + INTERVAL (s) DAY AS DATE) AS date, CAST(s AS INTEGER) AS step
  FROM (SELECT series_key, max(date) AS last FROM daily GROUP BY 1), range(-10, 91) t(s)) f
JOIN (SELECT series_key, max(date) AS last FROM daily GROUP BY 1) m ON f.series_key = m.series_key
WHERE f.date > m.last AND f.date <= CAST(m.last + INTERVAL 30 DAY AS DATE)""",
)
def q_horizon(spark, d):
    # A 90-day forecast frame that also overlaps history; keep days 1..30.
    dd = _daily(spark, d)
    last = dd.groupBy(KEY).agg(F.max("date").alias("_l"))
    fc = last.select(KEY, F.posexplode(F.sequence(F.date_sub("_l", 10), F.date_add("_l", 90))).alias("_p", "date")).select(
        KEY, "date", (F.col("_p") - 10).cast("int").alias("step")
    )
    return daily.horizon_head(fc, dd, 30)


@register(
    "clip_floor",
    with_ctes("standin_long") + "SELECT series_key, model, date, greatest(yhat - actual, 0.0) AS clipped FROM standin_long",
    rnd=("clipped",),
)
def q_clip(spark, d):
    lg = _long(spark, d).withColumn("clipped", F.col("yhat") - F.col("actual"))
    return ensemble.clip_floor(lg, ("clipped",)).select(KEY, "model", "date", "clipped")


_MRND = ("mae", "rmse", "mape", "total_predicted", "total_actual", "total_error_pct")


@register(
    "model_rank",
    with_ctes("standin_metrics")
    + """SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY mae ASC NULLS LAST, model) AS INTEGER) AS rank,
       row_number() OVER (PARTITION BY series_key ORDER BY mae ASC NULLS LAST, model) = 1 AS is_best,
       row_number() OVER (PARTITION BY series_key ORDER BY mae ASC NULLS LAST, model) = count(*) OVER (PARTITION BY series_key) AS is_worst,
       CASE WHEN abs(total_error_pct) < 15 THEN 'GOOD' WHEN abs(total_error_pct) < 30 THEN 'FAIR'
            WHEN total_error_pct IS NOT NULL THEN 'POOR' END AS status
FROM standin_metrics""",
    rnd=_MRND,
)
def q_rank(spark, d):
    return metrics.model_rank(_metrics(spark, d))


@register(
    "best_model",
    with_ctes("standin_metrics")
    + """SELECT series_key,
       max(CASE WHEN a = 1 THEN model END) AS best_model, max(CASE WHEN a = 1 THEN mae END) AS best_mae,
       max(CASE WHEN b = 1 THEN model END) AS worst_model, max(CASE WHEN b = 1 THEN mae END) AS worst_mae
FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY mae ASC NULLS LAST, model) AS a,
             row_number() OVER (PARTITION BY series_key ORDER BY mae DESC NULLS LAST, model) AS b FROM standin_metrics)
GROUP BY series_key""",
    rnd=("best_mae", "worst_mae"),
)
def q_best(spark, d):
    return metrics.best_model(_metrics(spark, d))


@register(
    "inverse_error_weights",
    with_ctes("standin_metrics")
    + "SELECT series_key, model, mae, (1.0 / mae) / sum(1.0 / mae) OVER (PARTITION BY series_key) AS weight FROM standin_metrics",
    rnd=("mae", "weight"),
)
def q_inv_weights(spark, d):
    return metrics.inverse_error_weights(_metrics(spark, d))


@register(
    "good_bad_models",
    with_ctes("standin_metrics")
    + """SELECT *, CASE WHEN abs(total_error_pct) < 15 THEN 'good' ELSE 'bad' END AS verdict FROM standin_metrics
WHERE abs(total_error_pct) < 15 OR abs(total_error_pct) > 30""",
    rnd=_MRND,
)
def q_good_bad(spark, d):
    return metrics.good_bad_models(_metrics(spark, d))


@register(
    "status_band",
    with_ctes("standin_metrics")
    + """SELECT series_key, model, total_error_pct, CASE WHEN abs(total_error_pct) < 15 THEN 'GOOD' WHEN abs(total_error_pct) < 30 THEN 'FAIR'
       WHEN total_error_pct IS NOT NULL THEN 'POOR' END AS status FROM standin_metrics""",
    rnd=("total_error_pct",),
)
def q_status(spark, d):
    return _metrics(spark, d).select(KEY, "model", "total_error_pct", metrics.status_band().alias("status"))


@register(
    "daily_errors",
    with_ctes("standin_long", "standin_metrics")
    + """SELECT l.series_key, r.which, l.model, l.date, l.yhat - l.actual AS error FROM standin_long l
JOIN (SELECT series_key, model, CASE WHEN rk = 1 THEN 'best' ELSE 'worst' END AS which FROM (
        SELECT series_key, model, row_number() OVER (PARTITION BY series_key ORDER BY mae ASC NULLS LAST, model) AS rk,
               count(*) OVER (PARTITION BY series_key) AS n FROM standin_metrics) WHERE rk = 1 OR rk = n) r
  ON l.series_key = r.series_key AND l.model = r.model""",
    rnd=("error",),
)
def q_daily_errors(spark, d):
    return metrics.daily_errors(_long(spark, d), _metrics(spark, d))


@register(
    "r2",
    with_ctes("standin_long")
    + """SELECT series_key, model, 1 - sum((actual - yhat) * (actual - yhat)) / nullif(sum((actual - m) * (actual - m)), 0) AS r2
FROM (SELECT *, avg(actual) OVER (PARTITION BY series_key, model) AS m FROM standin_long) GROUP BY 1, 2""",
    rnd=("r2",),
)
def q_r2(spark, d):
    return metrics.r2(_long(spark, d), (KEY, "model"))


@register(
    "fit_band",
    with_ctes("standin_long")
    + """SELECT series_key, model, r2, CASE WHEN r2 > 0.5 THEN 'good' WHEN r2 < 0 THEN 'bad' WHEN r2 IS NOT NULL THEN 'fair' END AS fit
FROM (SELECT series_key, model, 1 - sum((actual - yhat) * (actual - yhat)) / nullif(sum((actual - m) * (actual - m)), 0) AS r2
      FROM (SELECT *, avg(actual) OVER (PARTITION BY series_key, model) AS m FROM standin_long) GROUP BY 1, 2)""",
    rnd=("r2",),
)
def q_fit_band(spark, d):
    return metrics.r2(_long(spark, d), (KEY, "model")).withColumn("fit", ensemble.fit_band("r2"))


def _scored_clf(spark, d):
    f = customers.customer_features(src.prepared_invoices(spark, d, "nation", fill_zero=True))
    lab = churn.churn_labels(f)
    # Stand-in score against the relative label, so both classes are mixed.
    return churn.standin_probability(lab).select(
        F.lit("standin").alias("model"),
        "customer_no",
        F.col("churn_probability").alias("probability"),
        F.col("is_churned_relative").alias("label"),
    )


@register(
    "class_metrics",
    with_ctes("churn_lab")
    + """SELECT 'standin' AS model, n0 AS n,
       COALESCE(tp / nullif(tp + fp, 0), 0.0) AS precision, COALESCE(tp / nullif(tp + fn, 0), 0.0) AS recall,
       COALESCE(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1
FROM (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) * 1.0 AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) * 1.0 AS fp,
             count(*) FILTER (WHERE p < 0.5 AND y = 1) * 1.0 AS fn, count(*) AS n0
      FROM (SELECT least(1.0, recency / 365.0) AS p, is_churned_relative AS y FROM churn_lab)) t""",
    rnd=("precision", "recall", "f1"),
)
def q_class_metrics(spark, d):
    return metrics.class_metrics(_scored_clf(spark, d), ("model",))


@register(
    "auc_roc",
    with_ctes("churn_lab")
    + """SELECT 'standin' AS model,
       sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc
FROM (SELECT p, pos, neg, COALESCE(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT least(1.0, recency / 365.0) AS p, sum(is_churned_relative) AS pos, sum(1 - is_churned_relative) AS neg
            FROM churn_lab GROUP BY 1))""",
    rnd=("auc",),
)
def q_auc(spark, d):
    return metrics.auc_roc(_scored_clf(spark, d), ("model",))


@register(
    "param_cross",
    """SELECT CAST(cps AS DOUBLE) AS changepoint_prior_scale, CAST(sps AS DOUBLE) AS seasonality_prior_scale, mode AS seasonality_mode,
       CAST(ia * 8 + ib * 2 + ic AS INTEGER) AS param_id, series_key, n_days
FROM (VALUES (0, 0.001), (1, 0.005), (2, 0.01), (3, 0.05), (4, 0.1)) a(ia, cps),
     (VALUES (0, 0.1), (1, 1.0), (2, 5.0), (3, 10.0)) b(ib, sps),
     (VALUES (0, 'additive'), (1, 'multiplicative')) c(ic, mode),
     (SELECT CAST(c.c_nationkey AS VARCHAR) AS series_key, count(DISTINCT CAST(o.o_orderdate AS DATE)) AS n_days
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE (CASE WHEN o.o_orderstatus = 'P' THEN 'CM' ELSE 'IN' END) = 'IN' GROUP BY 1) s""",
    rnd=("changepoint_prior_scale", "seasonality_prior_scale"),
)
def q_param_cross(spark, d):
    from tidecast.operators.grid import DEFAULT_GRID, param_grid

    keys = src.prepared_invoices(spark, d).groupBy(KEY).agg(F.count_distinct("invoice_date").alias("n_days"))
    return param_grid(spark, DEFAULT_GRID).crossJoin(keys)


@register(
    "param_improvement",
    with_ctes("standin_long")
    + """SELECT series_key, model, (sum(yhat) - sum(actual)) / nullif(sum(actual), 0) * 100 AS bias_pct,
       72.0 - (sum(yhat) - sum(actual)) / nullif(sum(actual), 0) * 100 AS bias_improvement
FROM standin_long GROUP BY 1, 2""",
    rnd=("bias_pct", "bias_improvement"),
)
def q_param_impr(spark, d):
    m = _metrics(spark, d).select(KEY, "model", F.col("total_error_pct").alias("bias_pct"))
    return ensemble.param_improvement(m)


@register(
    "weekday_vs_mean",
    with_ctes("daily")
    + """SELECT series_key, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, avg(sales) > avg(avg(sales)) OVER (PARTITION BY series_key) AS above_mean
FROM daily GROUP BY 1, 2""",
)
def q_wd_vs_mean(spark, d):
    return daily.weekday_pattern(_daily(spark, d)).select(KEY, "day_of_week", "above_mean")


@register(
    "union_train_test",
    with_ctes("daily_split")
    + """SELECT series_key, date, sales, role, lag(sales, 7) OVER (PARTITION BY series_key ORDER BY date) AS lag_7 FROM daily_split""",
)
def q_union(spark, d):
    s = _split(spark, d)
    train = s.where(F.col("role") == "train")
    test = s.where(F.col("role") == "test")
    both = train.unionByName(test)
    w = F.lag("sales", 7).over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(KEY).orderBy("date"))
    return both.select(KEY, "date", "sales", "role", w.alias("lag_7"))


@register(
    "match_columns",
    with_ctes("daily")
    + "SELECT customer_count, sales, date, invoice_count, series_key FROM daily",
)
def q_match_cols(spark, d):
    from tidecast.operators.models import match_columns

    dd = _daily(spark, d)
    return match_columns(dd, ["customer_count", "sales", "date", "invoice_count", KEY])


@register(
    "drop_leaky_cols",
    with_ctes("daily") + "SELECT series_key, date, sales FROM daily",
)
def q_drop_leaky(spark, d):
    from tidecast.operators.features import drop_leaky

    return drop_leaky(_daily(spark, d))
