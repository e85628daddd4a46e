"""End-to-end forecast: fit the four forecasters on all history, forecast
the horizon, blend them into the weighted ensemble with intervals.

Forecasters (model ids of the long table):
``decompose`` (trend + seasonality + holidays, tuned parameters),
``seasonal_arx`` ((1,1,1)(1,1,1,7) with 24 calendar regressors + trend),
``boosted_trees`` (recursive, 37 features) and ``stacking`` (random forest
+ gradient boosting -> ridge, recursive on the 61 features, which also
feeds every regressor's recursion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import arx, daily, decompose, ensemble, features, grid, models, recursive
from tidecast.sources.invoices import prepared_invoices

KEY = "series_key"


def tuned_decomposition(d: DataFrame, future: DataFrame, params: DataFrame, test_days: int = 30) -> DataFrame:
    """Decomposition forecasts of ``future`` with each series' best
    parameter set on its hold-out, refitted on all of its history."""
    best = decompose.best_params(decompose.grid_search(daily.holdout_split(d, test_days), params))
    fits = decompose.decompose_frames(d, future, params, keep="future")
    return fits.join(best.select(KEY, "param_id"), [KEY, "param_id"])


def forecast_all(
    spark: SparkSession,
    sf_dir: str,
    series: str = "nation",
    horizon: int = 30,
    sizes: tuple[int, int, int] = (500, 200, 200),
    decompose_params: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Returns (long forecasts of every model, ensemble table)."""
    n_boost, n_rf, n_gb = sizes
    d = daily.gap_fill(daily.daily_sales(prepared_invoices(spark, sf_dir, series))).select(KEY, "date", "sales").persist()
    fut = daily.future_dates(d, horizon).drop("step")
    out = []

    dec = tuned_decomposition(d, fut, grid.param_grid(spark, decompose_params or grid.DEFAULT_GRID))
    out.append(dec.select(KEY, F.lit("decompose").alias("model"), "date", F.greatest("yhat", F.lit(0.0)).alias("yhat"),
                          F.greatest("yhat_lower", F.lit(0.0)).alias("lower"), F.col("yhat_upper").alias("upper")))

    ax = arx.seasonal_arx(d, fut, (1, 1, 1), (1, 1, 1, 7), "full").where(F.col("role") == "future")
    out.append(ax.select(KEY, F.lit("seasonal_arx").alias("model"), "date", "yhat", "lower", "upper"))

    xm = features.drop_incomplete(features.xgb_features(d)).persist()
    xcols = features.feature_names(xm)
    boost = models.fit_model(models.boosted_trees_reg(n_boost, 6, 0.05, 0.8, 0.8, 3), xm, xcols)
    fb = recursive.recursive_forecast(d, {"boosted_trees": boost}, xcols, horizon)

    fm = features.full_features(d).fillna(0.0, subset=["wow_pct_change", "rolling_cv_7", "rolling_cv_14"])
    fcols = features.feature_names(fm)
    fm = features.drop_incomplete(fm, fcols).persist()
    bases, meta = models.stacking_fit([models.random_forest_reg(n_rf, 10, 2), models.gbt_reg(n_gb, 5, 0.05, 0.8)], models.ridge(1.0, scaler=None), fm, fcols)

    stack = models.FittedStack(bases, meta, models.ModelSpec("stacking", "stack"))
    fs = recursive.recursive_forecast(d, {"stacking": stack}, fcols, horizon)
    for f in (fb, fs):
        out.append(f.select(KEY, "model", "date", "yhat", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))

    long = out[0]
    for o in out[1:]:
        long = long.unionByName(o)
    long = long.persist()
    ens = ensemble.ensemble_wide(long, ensemble.weights_for(long), list(ensemble.DEFAULT_WEIGHTS))
    return long, ens
