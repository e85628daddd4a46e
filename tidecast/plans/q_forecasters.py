"""Registered queries: recursive, decomposition, seasonal ARX forecasters,
grid search, stationarity test, holidays and the full backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.operators import arx, daily, decompose, features, grid, models, recursive
from tidecast.plans.checks import register
from tidecast.sources import invoices as src

KEY = "series_key"


def _daily(spark, d, series="nation"):
    dd = daily.gap_fill(daily.daily_sales(src.prepared_invoices(spark, d, series)))
    return dd.select(KEY, "date", "sales")


@register("recursive_forecast")
def q_recursive(spark, d):
    dd = _daily(spark, d).persist()
    m = features.drop_incomplete(features.xgb_features(dd)).persist()
    cols = features.feature_names(m)
    fitted = models.fit_model(models.boosted_trees_reg(), m, cols)
    return recursive.recursive_forecast(dd, {"boosted_trees": fitted}, cols, 30)


def _one_params(spark, cps=0.05, sps=1.0, mode="multiplicative"):
    return grid.param_grid(spark, {"changepoint_prior_scale": [cps], "seasonality_prior_scale": [sps], "seasonality_mode": [mode]})


@register("decompose_forecast")
def q_decompose(spark, d):
    return decompose.decompose_forecast(_daily(spark, d), _one_params(spark), 90)


def _grid_results(spark, d):
    split = daily.holdout_split(_daily(spark, d), 30)
    return decompose.grid_search(split, grid.param_grid(spark, grid.DEFAULT_GRID))


@register("tuned_forecast")
def q_tuned(spark, d):
    from tidecast.plans.forecast import tuned_decomposition

    dd = _daily(spark, d)
    return tuned_decomposition(dd, daily.future_dates(dd, 30).drop("step"), grid.param_grid(spark, grid.DEFAULT_GRID))


@register("grid_search")
def q_grid(spark, d):
    return _grid_results(spark, d)


@register("top_param_sets")
def q_top_params(spark, d):
    return grid.top_param_sets(_grid_results(spark, d), "mae", 10)


@register("seasonal_arx")
def q_arx(spark, d):
    dd = _daily(spark, d)
    return arx.seasonal_arx(dd, daily.future_dates(dd, 30).drop("step"), (1, 1, 1), (1, 1, 1, 7), "full")


@register("seasonal_arx_interval")
def q_arx_interval(spark, d):
    dd = _daily(spark, d)
    out = arx.seasonal_arx(dd, daily.future_dates(dd, 30).drop("step"), (1, 1, 1), (1, 1, 1, 7), "full")
    return out.where(F.col("role") == "future").select(KEY, "date", "yhat", "lower", "upper")


@register("info_criteria")
def q_info(spark, d):
    dd = _daily(spark, d)
    out = arx.seasonal_arx(dd, daily.future_dates(dd, 30).drop("step"), (1, 1, 1), (1, 1, 1, 7), "full")
    return out.groupBy(KEY).agg(F.first("aic").alias("aic"), F.first("bic").alias("bic"), F.first("n_obs").alias("n_obs"), F.first("status").alias("status"))


@register("residual_bounds")
def q_resid(spark, d):
    dd = _daily(spark, d)
    out = arx.seasonal_arx(dd, daily.future_dates(dd, 30).drop("step"), (1, 1, 1), (1, 1, 1, 7), "full")
    return out.where(F.col("role") == "train").select(KEY, "date", "actual", "fitted", "resid", "resid_lower", "resid_upper")


@register("stationarity_test")
def q_adf(spark, d):
    return arx.stationarity_test(_daily(spark, d))


def _sql_holidays() -> str:
    years = """(SELECT CAST(range AS INTEGER) AS year FROM range(
        (SELECT CAST(min(year(o_orderdate)) AS BIGINT) FROM orders), (SELECT CAST(max(year(o_orderdate)) AS BIGINT) + 1 FROM orders)))"""
    parts = []
    for name, m, dd in calendar.FIXED_HOLIDAYS:
        cond = f" WHERE year >= {calendar.JUNETEENTH_FROM}" if name.startswith("Juneteenth") else ""
        parts.append(f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS holiday, year, make_date(year, {m}, {dd}) AS date FROM {years}{cond}")
    for name, m, wd, nth in calendar.FLOATING_HOLIDAYS:
        first = f"make_date(year, {m}, 1)"
        if nth > 0:
            expr = f"CAST({first} + INTERVAL (CAST((({wd} - (isodow({first}) - 1) + 7) % 7) + {(nth - 1) * 7} AS INTEGER)) DAY AS DATE)"
        else:
            last = f"last_day({first})"
            expr = f"CAST({last} - INTERVAL (CAST((((isodow({last}) - 1) - {wd} + 7) % 7) AS INTEGER)) DAY AS DATE)"
        parts.append(f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS holiday, year, {expr} AS date FROM {years}")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT holiday, year, date,
       CASE WHEN isodow(date) = 6 THEN CAST(date - INTERVAL 1 DAY AS DATE)
            WHEN isodow(date) = 7 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE date END AS observed
FROM ({body})"""


@register("holiday_flags", _sql_holidays())
def q_holidays(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    return calendar.us_holidays(spark, int(o["a"]), int(o["b"]))


@register("backtest")
def q_backtest(spark, d):
    from tidecast.plans.backtest import full_backtest

    return full_backtest(spark, d, series="nation", mode="one_step")[1]


@register("backtest_multi_step")
def q_backtest_multi(spark, d):
    from tidecast.plans.backtest import full_backtest

    return full_backtest(spark, d, series="nation", mode="multi_step")[1]
