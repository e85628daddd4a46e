"""Forecast and classifier metrics, model ranking and weights.

Every metric is a single grouped aggregate over a long prediction table, so
any number of series, models and folds is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_key"


def forecast_metrics(pred: DataFrame, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """``forecast_metrics``: MAE, RMSE, MAPE (over actual > 0, in %), totals
    and total error % per group of ``keys``."""
    err = F.col("yhat") - F.col("actual")
    ape = F.when(F.col("actual") > 0, F.abs(err) / F.col("actual"))
    return (
        pred.groupBy(*keys)
        .agg(
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            (F.avg(ape) * 100).alias("mape"),
            F.sum("yhat").alias("total_predicted"),
            F.sum("actual").alias("total_actual"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn(
            "total_error_pct",
            F.try_divide(F.col("total_predicted") - F.col("total_actual"), F.col("total_actual")) * 100,
        )
    )


def r2(pred: DataFrame, keys: Sequence[str] = ("model", "fold")) -> DataFrame:
    """``r2``: 1 - SSE / SST per group (SST around the group's own mean)."""
    # var_pop merges partial sums of squares around partial means (no window,
    # no second pass): SST = n * var_pop.
    sse = F.sum((F.col("actual") - F.col("yhat")) ** 2)
    return pred.groupBy(*keys).agg((1 - F.try_divide(sse, F.count("actual") * F.var_pop("actual"))).alias("r2"))


def status_band(col: str = "total_error_pct"):
    """``status_band``: |error| < 15 GOOD, < 30 FAIR, else POOR."""
    a = F.abs(F.col(col))
    return F.when(a < 15, "GOOD").when(a < 30, "FAIR").when(a.isNotNull(), "POOR")


def model_rank(metrics: DataFrame, by: str = "mae", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """``model_rank`` + ``best_model`` / ``worst_model`` flags: rank by the
    metric (model name breaks ties), mark first and last."""
    asc = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), F.col("model"))
    cnt = Window.partitionBy(*keys)
    ranked = metrics.withColumn("rank", F.row_number().over(asc)).withColumn("_n", F.count(F.lit(1)).over(cnt))
    return (
        ranked.withColumn("is_best", F.col("rank") == 1)
        .withColumn("is_worst", F.col("rank") == F.col("_n"))
        .withColumn("status", status_band())
        .drop("_n")
    )


def best_model(metrics: DataFrame, by: str = "mae", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """``best_model`` / ``worst_model``: argmin and argmax of a metric per key,
    the first model by name on ties."""
    asc = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), F.col("model"))
    desc = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col("model"))
    marked = metrics.withColumn("_a", F.row_number().over(asc)).withColumn("_d", F.row_number().over(desc))
    return marked.groupBy(*keys).agg(
        F.max(F.when(F.col("_a") == 1, F.col("model"))).alias("best_model"),
        F.max(F.when(F.col("_a") == 1, F.col(by))).alias(f"best_{by}"),
        F.max(F.when(F.col("_d") == 1, F.col("model"))).alias("worst_model"),
        F.max(F.when(F.col("_d") == 1, F.col(by))).alias(f"worst_{by}"),
    )


def inverse_error_weights(metrics: DataFrame, by: str = "mae", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """``inverse_error_weights``: (1/err) / sum(1/err) per key."""
    w = Window.partitionBy(*keys)
    inv = F.try_divide(F.lit(1.0), F.col(by))
    return metrics.select(*keys, "model", by).withColumn("_inv", inv).withColumn(
        "weight", F.col("_inv") / F.sum("_inv").over(w)
    ).drop("_inv")


def good_bad_models(metrics: DataFrame, lo: float = 15.0, hi: float = 30.0) -> DataFrame:
    """``good_bad_models``: |total error| < lo is good, > hi is bad."""
    a = F.abs(F.col("total_error_pct"))
    return metrics.withColumn(
        "verdict", F.when(a < lo, "good").when(a > hi, "bad").otherwise("neither")
    ).where(F.col("verdict") != "neither")


def daily_errors(pred: DataFrame, metrics: DataFrame, by: str = "mae", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """``daily_errors``: prediction - actual per day for the best and the
    worst model of each key."""
    ranked = model_rank(metrics, by, keys).where(F.col("is_best") | F.col("is_worst"))
    pick = ranked.select(*keys, "model", F.when(F.col("is_best"), "best").otherwise("worst").alias("which"))
    return pred.join(pick, [*keys, "model"]).select(
        *keys, "which", "model", "date", (F.col("yhat") - F.col("actual")).alias("error")
    )


def class_metrics(scored: DataFrame, keys: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    """``class_metrics``: precision, recall and F1 of ``probability >= t``
    against ``label``; an undefined ratio is 0."""
    pred = (F.col("probability") >= threshold).cast("int")
    tp = F.sum(F.when((pred == 1) & (F.col("label") == 1), 1).otherwise(0))
    fp = F.sum(F.when((pred == 1) & (F.col("label") == 0), 1).otherwise(0))
    fn = F.sum(F.when((pred == 0) & (F.col("label") == 1), 1).otherwise(0))
    agg = scored.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count(F.lit(1)).alias("n"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return agg.select(*keys, "n", precision.cast("double").alias("precision"), recall.cast("double").alias("recall"), f1.cast("double").alias("f1"))


def auc_roc(scored: DataFrame, keys: Sequence[str] = ("model",), buckets: int = 256) -> DataFrame:
    """``auc_roc``: exact, tie-aware area under the ROC curve (Mann-Whitney).

    AUC = sum over positives of (negatives scored lower + half the negatives
    scored equal) / (P * N). Rows are reduced to one per distinct score, then
    split into ``buckets`` score ranges at approximate quantiles; negatives
    below a score = the exact total of all lower buckets (a window over at
    most ``buckets`` rows) + a running sum inside its own bucket. No task ever
    holds more than one bucket, and the result is exact whatever the bounds.
    """
    per_score = scored.groupBy(*keys, "probability").agg(
        F.sum(F.col("label")).alias("_pos"), F.sum(1 - F.col("label")).alias("_neg")
    )
    qs = [i / buckets for i in range(1, buckets)]
    # One row per key group; Spark picks the join by its size.
    bounds = per_score.groupBy(*keys).agg(F.percentile_approx("probability", qs, 10000).alias("_bounds"))
    b = per_score.join(bounds, list(keys)).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda x: x < F.col("probability")))
    ).drop("_bounds")
    below = Window.unboundedPreceding
    bucket_neg = b.groupBy(*keys, "_bucket").agg(F.sum("_neg").alias("_bneg"))
    offsets = bucket_neg.withColumn(
        "_off",
        F.coalesce(F.sum("_bneg").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(below, -1)), F.lit(0)),
    ).drop("_bneg")
    inside = b.withColumn(
        "_in",
        F.coalesce(
            F.sum("_neg").over(Window.partitionBy(*keys, "_bucket").orderBy("probability").rowsBetween(below, -1)),
            F.lit(0),
        ),
    )
    joined = inside.join(offsets, [*keys, "_bucket"])
    return joined.groupBy(*keys).agg(
        (
            F.sum(F.col("_pos") * (F.col("_off") + F.col("_in") + 0.5 * F.col("_neg")))
            / (F.sum("_pos") * F.sum("_neg"))
        ).cast("double").alias("auc")
    )
