"""Seasonal ARIMA with calendar regressors, and the ADF stationarity test.

Estimator: regression with seasonal ARIMA errors, fitted per series by the
Hannan-Rissanen two-stage method (not maximum likelihood):

1. difference y and the regressors by (1 - B)^d (1 - B^s)^D;
2. a long autoregression on the differenced series gives residual
   estimates e_hat;
3. one least-squares fit of w_t on the differenced regressors, the AR lags
   of w and the MA lags of e_hat (all lags of the products of the plain and
   seasonal polynomials), with a small ridge on standardised columns because
   calendar regressors are collinear, so forecasts scale with the units;
4. forecasts run the fitted ARMA forward (future shocks 0) and integrate
   back; the 95 % band is +-1.96 sigma sqrt(sum psi_j^2) from the psi
   weights of the full integrated model.

AIC / BIC come from the Gaussian log-likelihood of the stage-2 residuals.
Each series is one ``applyInPandas`` group (its daily history, bounded by
the calendar), so thousands of series fit in parallel; a failed fit falls
back to the training mean and says so in ``status``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import calendar

KEY = "series_key"
Z95 = 1.959963984540054
#: Largest modulus of a root of the fitted AR recursion.
MAX_ROOT = 0.995

ARX_SCHEMA = (
    "series_key string, date date, role string, actual double, yhat double, lower double, upper double, "
    "fitted double, resid double, resid_lower double, resid_upper double, aic double, bic double, n_obs int, status string"
)


def exog_columns(kind: str = "full", date: str = "date") -> dict:
    """Regressors: ``full`` = 24 calendar dummies + trend index (added in
    the group, it depends on row position); ``weekday`` = 6 weekday dummies."""
    return calendar.dummy_columns(date, full=(kind == "full"))


def _diff(x: np.ndarray, d: int, dd: int, s: int) -> np.ndarray:
    for _ in range(d):
        x = x[1:] - x[:-1]
    for _ in range(dd):
        x = x[s:] - x[:-s]
    return x


def _lags(p: int, big_p: int, s: int) -> list[int]:
    """Lags of the product of a polynomial with lags 1..p and a seasonal one
    with lags s..big_p*s, each lag once."""
    return sorted({i + j * s for i in range(p + 1) for j in range(big_p + 1)} - {0})


def _stabilising(ar: dict[int, float]) -> np.ndarray:
    """Factors for the AR coefficients that bring the recursion's largest
    root back to MAX_ROOT (each is its lag's power of one shrinkage); ones
    for a stationary fit."""
    if not ar:
        return np.ones(0)
    poly = np.zeros(max(ar) + 1)
    poly[0] = 1.0
    for lag, c in ar.items():
        poly[lag] = -c
    largest = float(np.abs(np.roots(poly)).max(initial=0.0))
    shrink = min(1.0, MAX_ROOT / largest) if largest > 0 else 1.0
    return np.array([shrink**lag for lag in ar])


def _difference_polynomial(d: int, dd: int, s: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^dd by power of B."""
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    seasonal = np.zeros(s + 1)
    seasonal[0], seasonal[s] = 1.0, -1.0
    for _ in range(dd):
        out = np.convolve(out, seasonal)
    return out


def _poly_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)


def _psi(ar: dict[int, float], ma: dict[int, float], d: int, dd: int, s: int, h: int) -> np.ndarray:
    """psi weights of y: theta(B) / (phi(B) (1-B)^d (1-B^s)^D), first h terms."""
    size = h + 1
    phi = np.zeros(size)
    phi[0] = 1.0
    for lag, c in ar.items():
        if lag < size:
            phi[lag] -= c
    for _ in range(d):
        phi = _poly_mul(phi, np.array([1.0, -1.0]))[:size]
    for _ in range(dd):
        seas = np.zeros(s + 1)
        seas[0], seas[s] = 1.0, -1.0
        phi = _poly_mul(phi, seas)[:size]
    phi = np.concatenate([phi, np.zeros(size - len(phi))])
    theta = np.zeros(size)
    theta[0] = 1.0
    for lag, c in ma.items():
        if lag < size:
            theta[lag] += c
    psi = np.zeros(size)
    for j in range(size):
        acc = theta[j]
        for i in range(1, j + 1):
            acc -= phi[i] * psi[j - i] if i < len(phi) else 0.0
        psi[j] = acc
    return psi[:h]


def fit_arx(pdf: pd.DataFrame, order=(1, 1, 1), seasonal_order=(1, 1, 1, 7), exog: list[str] | None = None, ridge: float = 1e-6,
            long_ar: int | None = None) -> pd.DataFrame:
    pdf = pdf.sort_values("date").reset_index(drop=True)
    train = pdf["role"].eq("train").to_numpy()
    p, d, q = order
    big_p, dd, big_q, s = seasonal_order
    y = pdf["actual"].to_numpy(dtype=float)
    n_tr = int(train.sum())
    x_all = pdf[exog].to_numpy(dtype=float) if exog else np.zeros((len(pdf), 0))
    yt = y[:n_tr]
    ar_lags, ma_lags = _lags(p, big_p, s), _lags(q, big_q, s)
    status = "ok"
    try:
        w = _diff(yt, d, dd, s)
        xw = _diff(x_all[:n_tr], d, dd, s) if x_all.shape[1] else np.zeros((len(w), 0))
        # Stage 1: long autoregression for shock estimates.
        # Its order is a parameter; short series allow a quarter of their rows.
        m = min(long_ar if long_ar is not None else max(2 * s + 2, 20), max(len(w) // 4, 1))
        rows = np.arange(m, len(w))
        z1 = np.column_stack([np.ones(len(rows))] + [w[rows - k] for k in range(1, m + 1)] + ([xw[rows]] if xw.shape[1] else []))
        b1 = np.linalg.lstsq(z1, w[rows], rcond=None)[0]
        e = np.zeros(len(w))
        e[rows] = w[rows] - z1 @ b1
        # Stage 2: ARMA lags of w and e_hat plus regressors.
        start = m + max(ar_lags + ma_lags + [0])
        rows2 = np.arange(start, len(w))
        cols = [w[rows2 - k] for k in ar_lags] + [e[rows2 - k] for k in ma_lags]
        z2 = np.column_stack([np.ones(len(rows2))] + cols + ([xw[rows2]] if xw.shape[1] else []))
        # Each column is penalised by its own size: no unit of one column
        # (sales against 0/1 flags) decides how much another is shrunk.
        size = np.sqrt((z2**2).sum(axis=0))
        # Shocks far below the series (a perfect long autoregression leaves
        # rounding errors) count by the series' size: they explain nothing.
        shocks = slice(1 + len(ar_lags), 1 + len(ar_lags) + len(ma_lags))
        size[shocks] = np.maximum(size[shocks], 0.01 * np.sqrt((w[rows2] ** 2).sum()))
        size[size == 0] = 1.0
        zs = z2 / size
        b2 = np.linalg.solve(zs.T @ zs + ridge * np.eye(zs.shape[1]), zs.T @ w[rows2]) / size
        b2[1 : 1 + len(ar_lags)] *= _stabilising(dict(zip(ar_lags, b2[1 : 1 + len(ar_lags)])))
        b2[0] += float(np.mean(w[rows2] - z2 @ b2))
        resid2 = w[rows2] - z2 @ b2
        c0 = b2[0]
        ar = dict(zip(ar_lags, b2[1 : 1 + len(ar_lags)]))
        ma = dict(zip(ma_lags, b2[1 + len(ar_lags) : 1 + len(ar_lags) + len(ma_lags)]))
        beta = b2[1 + len(ar_lags) + len(ma_lags) :]
        sigma2 = float(np.mean(resid2**2))
        n_eff = len(resid2)
        k = z2.shape[1] + 1
        ll = -0.5 * n_eff * (math.log(2 * math.pi * max(sigma2, 1e-300)) + 1)
        aic, bic = 2 * k - 2 * ll, k * math.log(n_eff) - 2 * ll

        # In-sample one-step fit on the differenced scale, integrated.
        e_full = np.zeros(len(w))
        e_full[rows2] = resid2
        # Forecast: run the ARMA forward on w, then integrate y.
        h = len(pdf) - n_tr
        xf = x_all
        # Difference the regressors over the joined train+future rows.
        xw_all = _diff(xf, d, dd, s) if xf.shape[1] else np.zeros((len(xf) - d - dd * s, 0))
        w_ext = list(w)
        e_ext = list(e_full)
        for i in range(h):
            t = len(w_ext)
            val = c0
            for lag, c in ar.items():
                val += c * w_ext[t - lag]
            for lag, c in ma.items():
                val += c * e_ext[t - lag]
            if xw_all.shape[1]:
                val += float(xw_all[t] @ beta)
            w_ext.append(val)
            e_ext.append(0.0)
        # Integrate: undo seasonal then regular differencing.
        y_ext = list(yt)
        undo = [(lag, c) for lag, c in enumerate(_difference_polynomial(d, dd, s)) if c]
        for i in range(h):
            t = n_tr + i
            wv = w_ext[len(w) + i]
            # y_t = w_t - sum of the differencing polynomial's other terms.
            y_ext.append(wv - sum(c * y_ext[t - lag] for lag, c in undo if lag))
        fc = np.array(y_ext[n_tr:])
        psi = _psi(ar, ma, d, dd, s, max(h, 1))
        se = np.sqrt(sigma2 * np.cumsum(psi**2))[:h]
        fitted = np.full(n_tr, np.nan)
        off = d + dd * s
        fitted[off + rows2] = yt[off + rows2] - resid2
        resid_full = yt - fitted
        rs = float(np.nanstd(resid_full, ddof=1)) if np.isfinite(resid_full).sum() > 1 else 0.0
    except (np.linalg.LinAlgError, ValueError, IndexError):
        status = "fallback_mean"
        h = len(pdf) - n_tr
        fc = np.full(h, float(np.nanmean(yt)) if n_tr else 0.0)
        se = np.full(h, np.nan)
        fitted = np.full(n_tr, np.nan)
        resid_full = np.full(n_tr, np.nan)
        rs = float("nan")
        aic = bic = float("nan")
        n_eff = 0

    yhat = np.concatenate([fitted, fc])
    lower = np.concatenate([np.full(n_tr, np.nan), fc - Z95 * se])
    upper = np.concatenate([np.full(n_tr, np.nan), fc + Z95 * se])
    resid = np.concatenate([resid_full, np.full(len(fc), np.nan)])
    return pd.DataFrame(
        {
            KEY: pdf[KEY],
            "date": pdf["date"],
            "role": pdf["role"],
            "actual": pdf["actual"],
            "yhat": np.maximum(yhat, 0.0),
            "lower": np.maximum(lower, 0.0),
            "upper": upper,
            "fitted": np.concatenate([fitted, np.full(len(fc), np.nan)]),
            "resid": resid,
            "resid_lower": np.where(np.isfinite(resid), -2 * rs, np.nan),
            "resid_upper": np.where(np.isfinite(resid), 2 * rs, np.nan),
            "aic": aic,
            "bic": bic,
            "n_obs": n_eff,
            "status": status,
        }
    )


def seasonal_arx(
    history: DataFrame,
    future: DataFrame,
    order=(1, 1, 1),
    seasonal_order=(1, 1, 1, 7),
    exog: str = "full",
    value: str = "sales",
) -> DataFrame:
    """``seasonal_arx`` (+ ``seasonal_arx_interval``, ``info_criteria``,
    ``residual_bounds``): fit on ``history``, forecast the ``future`` dates
    of each series. Regressors are calendar columns built in Spark; the
    trend index (``full``) is the row number in date order."""
    h = history.select(KEY, "date", F.col(value).cast("double").alias("actual"), F.lit("train").alias("role"))
    f = future.select(KEY, "date", F.lit(None).cast("double").alias("actual"), F.lit("future").alias("role"))
    cols = exog_columns(exog)
    frame = h.unionByName(f).withColumns(cols)
    names = list(cols)
    if exog == "full":
        from pyspark.sql import Window

        frame = frame.withColumn("trend", (F.row_number().over(Window.partitionBy(KEY).orderBy("date")) - 1).cast("double"))
        names.append("trend")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_arx(pdf, order, seasonal_order, names)

    return frame.groupBy(KEY).applyInPandas(fn, ARX_SCHEMA)


# MacKinnon (2010) response-surface coefficients of the ADF
# critical values, constant-only regression, one variable:
# level -> (beta_inf, beta_1, beta_2, beta_3), c(n) = b_inf + b1/n + b2/n^2 + b3/n^3.
ADF_CRIT = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}

# MacKinnon (1994) approximate asymptotic p-value of the ADF
# statistic, constant-only regression, one variable: bounds of the table,
# the switch point, and polynomial coefficients (lowest power first) of the
# normal quantile for small and large statistics.
ADF_P_MAX, ADF_P_MIN, ADF_P_STAR = 2.74, -18.83, -1.61
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

ADF_SCHEMA = (
    "series_key string, adf_stat double, p_value double, used_lag int, n_obs int, "
    "crit_1 double, crit_5 double, crit_10 double, is_stationary boolean, status string"
)


def adf_p_value(stat: float) -> float:
    """Approximate p-value of an ADF statistic (constant, no trend)."""
    if not math.isfinite(stat):
        return float("nan")
    if stat > ADF_P_MAX:
        return 1.0
    if stat < ADF_P_MIN:
        return 0.0
    coef = ADF_P_SMALL if stat <= ADF_P_STAR else ADF_P_LARGE
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def adf_test(pdf: pd.DataFrame, value: str = "sales", max_lag: int | None = None) -> pd.DataFrame:
    """Augmented Dickey-Fuller with constant, lag length by AIC."""
    y = pdf.sort_values("date")[value].to_numpy(dtype=float)
    y = y[np.isfinite(y)]
    n = len(y)
    maxlag = int(math.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag
    maxlag = max(0, min(maxlag, n // 2 - 2))
    dy = np.diff(y)
    # Three observations cannot fit a constant and a slope with an error left.
    if n < 5:
        return _adf_row(pdf, float("nan"), float("nan"), 0, max(n - 1, 0), {}, "too_short")

    def design(lag: int, start: int):
        rows = np.arange(start, len(dy))
        cols = [np.ones(len(rows)), y[rows]] + [dy[rows - i] for i in range(1, lag + 1)]
        return np.column_stack(cols), dy[rows]

    best, best_aic = 0, np.inf
    for lag in range(maxlag + 1):
        x, t = design(lag, maxlag)
        b, *_ = np.linalg.lstsq(x, t, rcond=None)
        r = t - x @ b
        nn = len(t)
        aic = nn * math.log(max(float(r @ r) / nn, 1e-300)) + 2 * x.shape[1]
        if aic < best_aic:
            best, best_aic = lag, aic
    x, t = design(best, best)
    b, *_ = np.linalg.lstsq(x, t, rcond=None)
    r = t - x @ b
    nn, k = x.shape
    s2 = float(r @ r) / (nn - k)
    cov = s2 * np.linalg.pinv(x.T @ x)
    stat = float(b[1] / math.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
    crit = {lv: c[0] + c[1] / nn + c[2] / nn**2 + c[3] / nn**3 for lv, c in ADF_CRIT.items()}
    pval = adf_p_value(stat)
    return _adf_row(pdf, stat, pval, best, nn, crit, "ok")


def _adf_row(pdf: pd.DataFrame, stat: float, pval: float, lag: int, n_obs: int, crit: dict, status: str) -> pd.DataFrame:
    levels = {f"crit_{lv[:-1]}": [crit.get(lv, float("nan"))] for lv in ADF_CRIT}
    row = {KEY: [pdf[KEY].iloc[0]], "adf_stat": [stat], "p_value": [pval], "used_lag": [lag], "n_obs": [n_obs], **levels}
    return pd.DataFrame({**row, "is_stationary": [bool(pval < 0.05)], "status": [status]})


def stationarity_test(daily: DataFrame, value: str = "sales") -> DataFrame:
    """``stationarity_test``: ADF per series (one group per series)."""
    return daily.select(KEY, "date", value).groupBy(KEY).applyInPandas(lambda p: adf_test(p, value), ADF_SCHEMA)
