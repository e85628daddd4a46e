"""Hold-out backtest of every forecaster on one common split.

``backtest_report`` is the SQL-expressible slice (seasonal naive and the
stand-ins); ``full_backtest`` adds the fitted forecasters:

* decomposition (changepoint scale .1, multiplicative, holidays),
* seasonal ARX (1,0,1)(0,1,1,7) with weekday dummies,
* boosted trees (200 x depth 6, lr .05) on the 22 validation features,
* stacking (random forest 100 x 8 + gradient boosting 100 x 5 -> ridge).

``mode='one_step'`` builds the tree models' lag features from the real
hold-out values (each day is predicted from actual history up to the day
before); ``mode='multi_step'`` forecasts the hold-out blind, feeding each
prediction back as the next lag. Both are reported side by side when asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import arx, baselines, daily, decompose, features, grid, metrics, models, recursive
from tidecast.sources.invoices import prepared_invoices

KEY = "series_key"


def backtest_predictions(spark: SparkSession, sf_dir: str, series: str = "nation", test_days: int = 30) -> DataFrame:
    d = daily.gap_fill(daily.daily_sales(prepared_invoices(spark, sf_dir, series)))
    split = daily.holdout_split(d, test_days)
    return baselines.seasonal_naive(split).unionByName(baselines.standin_forecasts(split))


def backtest_report(spark: SparkSession, sf_dir: str, series: str = "nation", test_days: int = 30) -> DataFrame:
    pred = backtest_predictions(spark, sf_dir, series, test_days)
    return metrics.model_rank(metrics.forecast_metrics(pred))


def _long(df: DataFrame, model: str, yhat: str = "yhat", lower: str | None = None, upper: str | None = None) -> DataFrame:
    return df.select(
        KEY,
        F.lit(model).alias("model"),
        "date",
        F.col("actual").cast("double").alias("actual"),
        F.greatest(F.col(yhat), F.lit(0.0)).alias("yhat"),
        (F.greatest(F.col(lower), F.lit(0.0)) if lower else F.lit(None).cast("double")).alias("lower"),
        (F.col(upper) if upper else F.lit(None).cast("double")).alias("upper"),
    )


def full_backtest(
    spark: SparkSession,
    sf_dir: str,
    series: str = "nation",
    test_days: int = 30,
    mode: str = "one_step",
    sizes: tuple[int, int, int] = (200, 100, 100),
) -> tuple[DataFrame, DataFrame]:
    """Predictions (long table) and ranked metrics of all forecasters.
    ``sizes``: boosted iterations, forest trees, gradient-boosting iterations."""
    n_boost, n_rf, n_gb = sizes
    d = daily.gap_fill(daily.daily_sales(prepared_invoices(spark, sf_dir, series))).select(KEY, "date", "sales").persist()
    split = daily.holdout_split(d, test_days).persist()
    train = split.where(F.col("role") == "train").select(KEY, "date", "sales")
    test = split.where(F.col("role") == "test").select(KEY, "date", F.col("sales").alias("actual"))

    preds = [baselines.seasonal_naive(split)]

    params = grid.param_grid(spark, {"changepoint_prior_scale": [0.1], "seasonality_prior_scale": [10.0], "seasonality_mode": ["multiplicative"]})
    dec = decompose.decompose_frames(train, test, params).where(F.col("role") == "future")
    preds.append(_long(dec.drop("actual").join(test, [KEY, "date"]), "decompose", "yhat", "yhat_lower", "yhat_upper"))

    ax = arx.seasonal_arx(train, test, (1, 0, 1), (0, 1, 1, 7), "weekday").where(F.col("role") == "future")
    preds.append(_long(ax.drop("actual").join(test, [KEY, "date"]), "seasonal_arx", "yhat", "lower", "upper"))

    boost = models.boosted_trees_reg(n_boost, 6, 0.05, 1.0, 1.0, 1)
    boost.name = "boosted_trees"
    rf = models.random_forest_reg(n_rf, 8, 1)
    gb = models.gbt_reg(n_gb, 5, 0.1, 1.0)

    feats_all = features.validation_features(split.select(KEY, "date", "sales", "role"))
    cols = features.feature_names(feats_all)
    feats_all = features.drop_incomplete(feats_all, cols).persist()
    ftrain = feats_all.where(F.col("role") == "train")
    fitted_boost = models.fit_model(boost, ftrain, cols)
    bases, meta = models.stacking_fit([rf, gb], models.ridge(1.0, scaler=None), ftrain, cols, "sales", 3)

    if mode == "one_step":
        ftest = feats_all.where(F.col("role") == "test")
        preds.append(models.predict_long(fitted_boost, ftest))
        st = models.stacking_predict(bases, meta, ftest).withColumn("actual", F.col("sales"))
        preds.append(_long(st, "stacking"))
    else:
        stack = models.FittedStack(bases, meta, models.ModelSpec("stacking", "stack"))
        fc = recursive.recursive_forecast(train, {"boosted_trees": fitted_boost, "stacking": stack}, cols, test_days, driver="stacking")
        got = fc.join(test, [KEY, "date"]).withColumn("lower", F.lit(None).cast("double")).withColumn("upper", F.lit(None).cast("double"))
        preds.append(got.select(KEY, "model", "date", "actual", "yhat", "lower", "upper"))

    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    met = metrics.model_rank(metrics.forecast_metrics(pred))
    return pred, met
