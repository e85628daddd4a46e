"""Trend + seasonality + holiday decomposition forecaster and its grid search.

Model (per series and parameter set), on time t scaled to [0, 1] over the
training span and y scaled by its largest absolute value:

    trend(t)    = k + m t + sum_j d_j max(0, t - c_j)      25 hinges over the first 80 %
    yearly(t)   = Fourier terms of order 10, period 365.25 days
    weekly(t)   = Fourier terms of order 3, period 7 days
    holidays(t) = one indicator per US federal holiday (observed date)

    additive:        y = trend + yearly + weekly + holidays
    multiplicative:  y = trend * (1 + yearly + weekly + holidays)

A Gaussian prior of scale s on a coefficient is the same as multiplying its
column by s under one shared unit ridge penalty, so the changepoint prior
scale multiplies the hinge columns and the seasonality prior scale the
Fourier columns; one closed-form ridge solve per fit. The multiplicative
form fits the trend first, then the seasonal part on y / trend - 1. The 95 %
interval is yhat +- 1.96 * the training residual standard deviation.

Every (series, parameter set) is one group of ``applyInPandas``: its rows
are one series' daily history (bounded by the calendar, not by the data),
and groups run in parallel across the cluster. The parameter grid is a
cross join, so a 40-point search over 1000 series is one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import calendar

KEY = "series_key"

# Model structure (hinge count and range, Fourier orders and
# periods, slope and holiday prior scales, interval z for 95 %).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
SLOPE_SCALE = 5.0
HOLIDAY_SCALE = 10.0
NOISE_STEPS = 6
Z95 = 1.959963984540054

HOLIDAY_NAMES = tuple(h[0] for h in calendar.FIXED_HOLIDAYS) + tuple(h[0] for h in calendar.FLOATING_HOLIDAYS)

OUT_SCHEMA = (
    "series_key string, param_id int, date date, role string, actual double, "
    "yhat double, yhat_lower double, yhat_upper double, trend double, weekly double, yearly double, holidays double, status string"
)


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    x = 2 * np.pi * days[:, None] * np.arange(1, order + 1)[None, :] / period
    return np.hstack([np.sin(x), np.cos(x)])


def _solve(gram: np.ndarray, rhs: np.ndarray, scale: np.ndarray, free: int, yy: float, n: int) -> np.ndarray:
    """Posterior mode on columns scaled by ``scale`` (prior scales), from a
    precomputed Gram matrix: (D G D + v P) b = D X'y with the residual
    variance v as the penalty's weight (except on the first ``free``
    columns), found by a few fixed-point steps. Returns coefficients for the
    scaled columns."""
    g, r = gram * np.outer(scale, scale), rhs * scale
    v = max(yy / max(n, 1), 1e-12)
    for _ in range(NOISE_STEPS):
        pen = np.full(len(scale), v)
        pen[:free] = 1e-9
        b = np.linalg.solve(g + np.diag(pen), r)
        v = max(float(yy - 2 * b @ r + b @ g @ b) / max(n, 1), 1e-12)
    return b


class Design:
    """Per-series design matrices, built once and reused by every parameter
    set (only the column scales change between sets)."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        self.pdf = pdf
        self.train = pdf["role"].eq("train").to_numpy()
        dates = pd.to_datetime(pdf["date"])
        days = (dates - dates[self.train].min()).dt.days.to_numpy(dtype=float)
        t = days / max(days[self.train].max(), 1.0)
        y = pdf["actual"].to_numpy(dtype=float)
        self.yscale = max(np.nanmax(np.abs(y[self.train])) if self.train.any() else 1.0, 1e-9)
        self.ys = y / self.yscale
        cps_t = np.linspace(0, CHANGEPOINT_RANGE, N_CHANGEPOINTS + 1)[1:]
        self.trend_x = np.hstack([np.ones((len(t), 1)), t[:, None] * SLOPE_SCALE, np.maximum(0.0, t[:, None] - cps_t[None, :])])
        abs_days = (dates - pd.Timestamp("1970-01-01")).dt.days.to_numpy(dtype=float)
        yearly = _fourier(abs_days, YEARLY_PERIOD, YEARLY_ORDER)
        weekly = _fourier(abs_days, WEEKLY_PERIOD, WEEKLY_ORDER)
        hol = pdf["holiday"].fillna("").to_numpy()
        hol_x = np.column_stack([(hol == h).astype(float) for h in HOLIDAY_NAMES]) * HOLIDAY_SCALE
        self.seas_x = np.hstack([yearly, weekly, hol_x])
        self.ny, self.nw, self.nt = yearly.shape[1], weekly.shape[1], self.trend_x.shape[1]
        self.x = np.hstack([self.trend_x, self.seas_x])
        tr = self.train
        self.gram_all = self.x[tr].T @ self.x[tr]
        self.rhs_all = self.x[tr].T @ self.ys[tr]
        self.gram_trend = self.trend_x[tr].T @ self.trend_x[tr]
        self.rhs_trend = self.trend_x[tr].T @ self.ys[tr]

    def scales(self, cps: float, sps: float) -> tuple[np.ndarray, np.ndarray]:
        trend = np.ones(self.nt)
        trend[2:] = cps
        seas = np.concatenate([np.full(self.ny + self.nw, sps), np.ones(self.seas_x.shape[1] - self.ny - self.nw)])
        return trend, seas


def fit_decomposition(pdf: pd.DataFrame, cps: float, sps: float, mode: str, design: Design | None = None) -> pd.DataFrame:
    """Fit on ``role == 'train'`` rows, predict every row of one group."""
    dz = design or Design(pdf)
    tr, ys = dz.train, dz.ys
    tscale, sscale = dz.scales(cps, sps)
    ny, nw, nt = dz.ny, dz.nw, dz.nt
    yy, n = float(ys[tr] @ ys[tr]), int(tr.sum())
    status = "ok"
    try:
        if mode == "additive":
            scale = np.concatenate([tscale, sscale])
            beta = _solve(dz.gram_all, dz.rhs_all, scale, 1, yy, n)
            parts = dz.x * (beta * scale)
            trend = parts[:, :nt].sum(1)
            yearly = parts[:, nt : nt + ny].sum(1)
            weekly = parts[:, nt + ny : nt + ny + nw].sum(1)
            holidays = parts[:, nt + ny + nw :].sum(1)
            yhat = trend + yearly + weekly + holidays
        else:
            tb = _solve(dz.gram_trend, dz.rhs_trend, tscale, 1, yy, n)
            trend = dz.trend_x @ (tb * tscale)
            nz = np.abs(trend) > 1e-9
            ok = tr & nz
            ratio = np.where(nz, ys / np.where(nz, trend, 1.0) - 1, 0.0)
            sx = dz.seas_x[ok]
            sb = _solve(sx.T @ sx, sx.T @ ratio[ok], sscale, 0, float(ratio[ok] @ ratio[ok]), int(ok.sum())) if ok.any() else np.zeros(dz.seas_x.shape[1])
            parts = dz.seas_x * (sb * sscale)
            yearly, weekly, holidays = parts[:, :ny].sum(1), parts[:, ny : ny + nw].sum(1), parts[:, ny + nw :].sum(1)
            yhat = trend * (1 + yearly + weekly + holidays)
            yearly, weekly, holidays = yearly * trend, weekly * trend, holidays * trend
    except np.linalg.LinAlgError:
        status = "fallback_mean"
        m = np.nanmean(ys[tr]) if tr.any() else 0.0
        trend = np.full(len(ys), m)
        yearly = weekly = holidays = np.zeros(len(ys))
        yhat = trend.copy()

    resid = ys[tr] - yhat[tr]
    sigma = float(np.std(resid, ddof=1)) if tr.sum() > 1 else 0.0
    k = dz.yscale
    p = dz.pdf
    return pd.DataFrame(
        {
            KEY: p[KEY],
            "param_id": p["param_id"] if "param_id" in p else 0,
            "date": p["date"],
            "role": p["role"],
            "actual": p["actual"],
            "yhat": np.maximum(yhat * k, 0.0),
            "yhat_lower": np.maximum((yhat - Z95 * sigma) * k, 0.0),
            "yhat_upper": (yhat + Z95 * sigma) * k,
            "trend": trend * k,
            "weekly": weekly * k,
            "yearly": yearly * k,
            "holidays": holidays * k,
            "status": status,
        }
    )


def _grid_fn(param_rows: list[dict], keep: str | None):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        dz = Design(pdf)
        outs = []
        for prm in param_rows:
            out = fit_decomposition(pdf, prm["changepoint_prior_scale"], prm["seasonality_prior_scale"], prm["seasonality_mode"], dz)
            out["param_id"] = prm["param_id"]
            outs.append(out if keep is None else out[out["role"] == keep])
        return pd.concat(outs, ignore_index=True)

    return fn


def with_holidays(frame: DataFrame) -> DataFrame:
    """Attach the observed US holiday name (or NULL) to each date.

    The calendar is generated lazily for the years present (11 rows per
    year; one year's neighbours included so observed dates that cross a
    year boundary are kept); its size is bounded by the year span, so
    broadcasting it is safe at any data size.
    """
    years = frame.select(F.explode(F.array(F.year("date") - 1, F.year("date"), F.year("date") + 1)).alias("year")).distinct()
    hol = calendar.holidays_for_years(years).groupBy(F.col("observed").alias("date")).agg(F.min("holiday").alias("holiday"))
    return frame.join(F.broadcast(hol), "date", "left")


def decompose_frames(history: DataFrame, future: DataFrame, params: DataFrame, value: str = "sales", keep: str | None = None) -> DataFrame:
    """Fit every (series, parameter set) on ``history`` and predict the rows
    of ``history`` and ``future`` (``series_key, date``); ``keep='future'``
    returns the future rows only.

    One group per series: its history is shuffled once and every parameter
    set is fitted inside that task (the grid is a user-sized literal table,
    read once on the driver and shipped with the function), so a 40-point
    grid does not multiply the shuffled data by 40.
    """
    h = history.select(KEY, "date", F.col(value).cast("double").alias("actual"), F.lit("train").alias("role"))
    f = future.select(KEY, "date", F.lit(None).cast("double").alias("actual"), F.lit("future").alias("role"))
    frame = with_holidays(h.unionByName(f))
    param_rows = [r.asDict() for r in params.collect()]  # the grid itself: a few dozen rows
    return frame.groupBy(KEY).applyInPandas(_grid_fn(param_rows, keep), OUT_SCHEMA)


def decompose_forecast(daily: DataFrame, params: DataFrame, horizon: int = 90, value: str = "sales") -> DataFrame:
    """``decompose_forecast``: fit on all history, forecast ``horizon`` days."""
    from tidecast.operators.daily import future_dates

    return decompose_frames(daily, future_dates(daily, horizon), params, value)


def grid_search(split: DataFrame, params: DataFrame, value: str = "sales") -> DataFrame:
    """``grid_search``: fit every parameter set on train rows, score the test
    rows (predictions floored at 0): mae, rmse, mape, bias %, totals. A set
    whose fit fails falls back to the train mean and is marked in
    ``status``."""
    train = split.where(F.col("role") == "train").select(KEY, "date", value)
    test = split.where(F.col("role") == "test").select(KEY, "date", F.col(value).alias("_actual"))
    pred = decompose_frames(train, test, params, value, keep="future")
    scored = pred.drop("actual").join(test, [KEY, "date"]).withColumn("_p", F.greatest(F.col("yhat"), F.lit(0.0)))
    err = F.col("_p") - F.col("_actual")
    res = scored.groupBy(KEY, "param_id").agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(F.col("_actual") > 0, F.abs(err) / F.col("_actual"))) * 100).alias("mape"),
        F.sum("_p").alias("total_predicted"),
        F.sum("_actual").alias("total_actual"),
        F.max("status").alias("status"),
    ).withColumn("bias_pct", F.try_divide(F.col("total_predicted") - F.col("total_actual"), F.col("total_actual")) * 100)
    return res.join(F.broadcast(params), "param_id")


def best_params(results: DataFrame) -> DataFrame:
    """Best (lowest MAE, then lowest id) parameter set per series."""
    return results.groupBy(KEY).agg(F.min_by("param_id", F.struct("mae", "param_id")).alias("param_id"), F.min("mae").alias("mae"))
