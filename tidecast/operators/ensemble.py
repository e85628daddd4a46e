"""Blending forecasters: weighted ensemble with intervals, simple average,
model spread, cumulative totals and comparisons with history.

Forecasts live in one long table ``(series_key, model, date, yhat, lower,
upper)``; models are aligned by an equi-join on ``(series_key, date)``,
never by row position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "series_key"

# Default blend weights of the four forecasters, the
# three-model fallback when no regressor forecast exists, and the band used
# for models that have no interval of their own (fraction of yhat).
DEFAULT_WEIGHTS = {"seasonal_arx": 0.35, "boosted_trees": 0.25, "stacking": 0.25, "decompose": 0.15}
FALLBACK_WEIGHTS = {"seasonal_arx": 0.45, "boosted_trees": 0.30, "decompose": 0.25}
DEFAULT_BANDS = {"boosted_trees": (0.7, 1.3), "stacking": (0.8, 1.2)}
STACKED_PRIORITY = ("stacking", "random_forest", "ensemble_avg")


def weights_frame(
    spark: SparkSession, weights: Mapping[str, float], bands: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """``weights_join`` input: one row per model (a handful of rows)."""
    from tidecast.session import literal_frame

    bands = bands or {}
    rows = [(m, float(w), *(bands.get(m, (None, None)))) for m, w in weights.items()]
    return literal_frame(spark, rows, "model string, weight double, band_lo double, band_hi double")


def weights_for(long: DataFrame, stacked: str = "stacking") -> DataFrame:
    """Default blend weights, or the three-model ones where no regressor
    forecast is among the models of ``long`` (a handful of names)."""
    present = {r["model"] for r in long.select("model").distinct().collect()}
    weights = DEFAULT_WEIGHTS if stacked in present else FALLBACK_WEIGHTS
    return weights_frame(long.sparkSession, weights, DEFAULT_BANDS)


def pick_stacked(long: DataFrame, priority: Sequence[str] = STACKED_PRIORITY, as_model: str = "stacking") -> DataFrame:
    """``sklearn_fallback``: per series keep the regressor forecast of the
    first model in ``priority`` that exists, relabelled ``as_model``."""
    pri = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("model"))
    cand = long.where(pri > 0).withColumn("_pri", pri)
    best = cand.groupBy(KEY).agg(F.min("_pri").alias("_pri"))
    return cand.join(best, [KEY, "_pri"]).drop("_pri").withColumn("model", F.lit(as_model))


def weighted_ensemble(long: DataFrame, weights: DataFrame, floor: bool = True) -> DataFrame:
    """``weighted_ensemble`` + ``ensemble_interval`` + ``scan_optional_source``.

    Per series and date: ensemble = sum(w * yhat) / sum(w) over the models
    present (a missing forecaster is tolerated: the weights of the others
    are renormalised); bounds = sum(w * coalesce(own bound, yhat * band))
    with the same normalisation. Ensemble and lower bound are floored at 0,
    the upper bound is not.

    ``weights`` has one row per model, so it is broadcast (size fixed by the
    number of models, not by the data).
    """
    j = long.join(F.broadcast(weights), "model")
    lo = F.coalesce(F.col("lower"), F.col("yhat") * F.col("band_lo"))
    hi = F.coalesce(F.col("upper"), F.col("yhat") * F.col("band_hi"))
    agg = j.groupBy(KEY, "date").agg(
        F.sum(F.col("weight") * F.col("yhat")).alias("_s"),
        F.sum(F.col("weight") * lo).alias("_lo"),
        F.sum(F.col("weight") * hi).alias("_hi"),
        F.sum("weight").alias("_w"),
        F.count(F.lit(1)).alias("n_models"),
    )
    ens = F.col("_s") / F.col("_w")
    lower = F.col("_lo") / F.col("_w")
    if floor:
        ens, lower = F.greatest(ens, F.lit(0.0)), F.greatest(lower, F.lit(0.0))
    return agg.select(
        KEY,
        "date",
        ens.alias("ensemble"),
        lower.alias("ensemble_lower"),
        (F.col("_hi") / F.col("_w")).alias("ensemble_upper"),
        "n_models",
        F.date_format("date", "EEEE").alias("day_of_week"),
    )


def ensemble_wide(long: DataFrame, weights: DataFrame, models: Sequence[str]) -> DataFrame:
    """The blended forecast next to each (floored) model column."""
    ens = weighted_ensemble(long, weights)
    wide = (
        long.groupBy(KEY, "date")
        .pivot("model", list(models))
        .agg(F.first(F.greatest(F.col("yhat"), F.lit(0.0))))
    )
    return ens.join(wide, [KEY, "date"], "left")


def ensemble_avg(long: DataFrame) -> DataFrame:
    """``ensemble_avg``: unweighted mean over models per series and date."""
    return long.groupBy(KEY, "date").agg(F.avg("yhat").alias("ensemble_avg"), F.count(F.lit(1)).alias("n_models"))


def model_spread(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``model_spread``: per date the min, max, mean and sample std across
    models; per series the mean std and mean coefficient of variation."""
    per_date = long.groupBy(KEY, "date").agg(
        F.min("yhat").alias("min_pred"),
        F.max("yhat").alias("max_pred"),
        F.avg("yhat").alias("mean_pred"),
        F.stddev_samp("yhat").alias("std_pred"),
    )
    cv = F.try_divide(F.col("std_pred"), F.col("mean_pred"))
    per_key = per_date.groupBy(KEY).agg(F.avg("std_pred").alias("mean_std"), F.avg(cv).alias("mean_cv"))
    return per_date, per_key.withColumn("consensus", consensus_band("mean_cv"))


def consensus_band(col: str = "mean_cv"):
    """``consensus_band``: mean cv < .3 Strong, < .5 Moderate, else Weak."""
    c = F.col(col)
    return F.when(c < 0.3, "Strong").when(c < 0.5, "Moderate").when(c.isNotNull(), "Weak")


def fit_band(col: str = "r2"):
    """``fit_band``: R2 > .5 good, < 0 bad, else fair."""
    c = F.col(col)
    return F.when(c > 0.5, "good").when(c < 0, "bad").when(c.isNotNull(), "fair")


def cumulative(fc: DataFrame, cols: Sequence[str] = ("yhat", "lower", "upper"), keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """``cumulative_forecast``: running sums in date order."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return fc.withColumns({f"cum_{c}": F.sum(c).over(w) for c in cols})


def forecast_totals(fc: DataFrame, value: str = "yhat", keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """``forecast_totals``: total, mean, min and max over the horizon."""
    return fc.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.avg(value).alias("daily_avg"),
        F.min(value).alias("min_day"),
        F.max(value).alias("max_day"),
        F.count(F.lit(1)).alias("days"),
    )


def vs_history(fc: DataFrame, daily: DataFrame, value: str = "yhat", recent: int = 30, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """``vs_history``: forecast total against (history daily mean x horizon)
    and against the sum of the last ``recent`` actual rows, in %."""
    totals = fc.groupBy(*keys).agg(F.sum(value).alias("forecast_total"), F.count(F.lit(1)).alias("horizon"))
    w = Window.partitionBy(KEY).orderBy(F.col("date").desc())
    hist = (
        daily.withColumn("_rn", F.row_number().over(w))
        .groupBy(KEY)
        .agg(
            F.avg("sales").alias("hist_daily_avg"),
            F.sum(F.when(F.col("_rn") <= recent, F.col("sales"))).alias("recent_actual"),
        )
    )
    j = totals.join(hist, KEY)
    est = F.col("hist_daily_avg") * F.col("horizon")
    return j.select(
        *keys,
        "forecast_total",
        "hist_daily_avg",
        est.alias("hist_est"),
        "recent_actual",
        ((F.try_divide(F.col("forecast_total"), est) - 1) * 100).alias("vs_hist_pct"),
        ((F.try_divide(F.col("forecast_total"), F.col("recent_actual")) - 1) * 100).alias("vs_recent_pct"),
    )


def clip_floor(df: DataFrame, cols: Sequence[str] = ("yhat", "lower")) -> DataFrame:
    """``clip_floor``: predictions (and lower bounds) floored at 0."""
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in cols})


def param_improvement(results: DataFrame, baseline_bias: float = 72.0) -> DataFrame:
    """``param_improvement``: percentage points of bias removed against a
    fixed baseline bias % (baseline - bias)."""
    return results.withColumn("bias_improvement", F.lit(float(baseline_bias)) - F.col("bias_pct"))
