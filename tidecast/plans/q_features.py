"""Registered queries: calendar columns and leak-safe window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.operators import daily, features
from tidecast.plans import sql_oracle as S
from tidecast.plans.checks import register
from tidecast.plans.sql_oracle import with_ctes
from tidecast.sources import invoices as src

BASE = ("series_key", "date", "sales")


def _daily(spark, d, series="nation"):
    return daily.gap_fill(daily.daily_sales(src.prepared_invoices(spark, d, series))).select(*BASE)


def _q(cols):
    return with_ctes("daily") + S.sql_select(cols)


@register("calendar_parts", _q(S.SQL_PARTS))
def q_parts(spark, d):
    return _daily(spark, d).withColumns(calendar.part_columns())


@register("calendar_flags", _q(S.SQL_FLAGS))
def q_flags(spark, d):
    return _daily(spark, d).withColumns(calendar.flag_columns())


_CYC = S.sql_cyclical(True)


@register("cyclical_encoding", _q(_CYC), rnd=tuple(_CYC))
def q_cyclical(spark, d):
    return _daily(spark, d).withColumns(calendar.cyclical_columns())


def _sql_dummies():
    cols = {name: f"CAST(isodow(date) - 1 = {i} AS INTEGER)" for i, name in enumerate(calendar.SHORT_DAYS)}
    cols["is_weekend"] = "CAST(isodow(date) >= 6 AS INTEGER)"
    for m in range(1, 12):
        cols[f"month_{m}"] = f"CAST(month(date) = {m} AS INTEGER)"
    for q in (1, 2, 3):
        cols[f"Q{q}"] = f"CAST(quarter(date) = {q} AS INTEGER)"
    cols["month_start"] = "CAST(day(date) = 1 AS INTEGER)"
    cols["month_end"] = "CAST(last_day(date) = date AS INTEGER)"
    cols["trend"] = f"CAST(row_number() OVER ({S.W_KEY}) - 1 AS INTEGER)"
    return cols


@register("calendar_dummies", _q(_sql_dummies()))
def q_dummies(spark, d):
    df = _daily(spark, d)
    return df.withColumns(calendar.dummy_columns()).withColumn("trend", features.trend_index())


@register("day_name", _q({"day_name": "dayname(date)", "day_short": "strftime(date, '%a')"}))
def q_day_name(spark, d):
    return _daily(spark, d).withColumns(
        {"day_name": calendar.day_name("date"), "day_short": calendar.day_name("date", short=True)}
    )


@register(
    "log_sqrt_abs",
    _q({"log1p_sales": "ln(1 + sales)", "sqrt_sales": "sqrt(sales)", "abs_change": f"abs(sales - lag(sales, 1) OVER ({S.W_KEY}))"}),
    rnd=("log1p_sales", "sqrt_sales"),
)
def q_log(spark, d):
    w = features._ordered()
    return _daily(spark, d).withColumns(
        {
            "log1p_sales": F.log1p("sales"),
            "sqrt_sales": F.sqrt("sales"),
            "abs_change": F.abs(F.col("sales") - F.lag("sales", 1).over(w)),
        }
    )


@register("lag_features", _q(S.sql_lags(features.SK_LAGS)))
def q_lags(spark, d):
    return _daily(spark, d).withColumns(features.lag_columns("sales", features.SK_LAGS))


_RM = S.sql_rolling((7, 14, 21, 28), ("mean",))


@register("rolling_mean", _q(_RM), rnd=tuple(_RM))
def q_rmean(spark, d):
    return _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14, 21, 28), ("mean",)))


_RS = S.sql_rolling((7, 14, 21, 28), ("std",))


@register("rolling_std", _q(_RS), rnd=tuple(_RS))
def q_rstd(spark, d):
    return _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14, 21, 28), ("std",)))


@register("rolling_min_max", _q(S.sql_rolling((7, 14, 21, 28), ("min", "max"))))
def q_rminmax(spark, d):
    return _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14, 21, 28), ("min", "max")))


@register("rolling_median", _q(S.sql_rolling((7, 14, 21, 28), ("median",))))
def q_rmedian(spark, d):
    return _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14, 21, 28), ("median",)))


_EX = S.sql_expanding(("mean", "std"))


@register("expanding_stats", _q(_EX), rnd=tuple(_EX))
def q_expanding(spark, d):
    return _daily(spark, d).withColumns(features.expanding_columns("sales", ("mean", "std")))


_SD = {name: f"lag(sales, {n}) OVER ({S.W_KEY})" for n, name in ((7, "same_day_last_week"), (14, "same_day_2_weeks_ago"), (21, "same_day_3_weeks_ago"), (28, "same_day_4_weeks_ago"))}


@register("same_day_prior_weeks", _q(_SD))
def q_same_day(spark, d):
    w = features._ordered()
    return _daily(spark, d).withColumns({name: F.lag("sales", int(e.split(", ")[1].split(")")[0])).over(w) for name, e in _SD.items()})


@register("wow_change", _q({"wow_change": S.SQL_WOW["wow_change"]}))
def q_wow(spark, d):
    return _daily(spark, d).withColumn("wow_change", features.wow_columns()["wow_change"])


@register("wow_pct_change", _q({"wow_pct_change": S.SQL_WOW["wow_pct_change"]}), rnd=("wow_pct_change",))
def q_wow_pct(spark, d):
    return _daily(spark, d).withColumn("wow_pct_change", features.wow_columns()["wow_pct_change"])


_RR_SQL = (
    with_ctes("daily")
    + "SELECT series_key, date, sales, rolling_max_7 - rolling_min_7 AS rolling_range_7, rolling_max_14 - rolling_min_14 AS rolling_range_14,"
    " rolling_std_7 / nullif(rolling_mean_7, 0) AS rolling_cv_7, rolling_std_14 / nullif(rolling_mean_14, 0) AS rolling_cv_14 FROM (\n"
    + S.sql_select(S.sql_rolling((7, 14), ("mean", "std", "min", "max")))
    + "\n)"
)


@register("rolling_range_cv", _RR_SQL, rnd=("rolling_cv_7", "rolling_cv_14"))
def q_range_cv(spark, d):
    df = _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14), ("mean", "std", "min", "max")))
    return df.withColumns(features.derived_rolling((7, 14))).select(
        *BASE, "rolling_range_7", "rolling_range_14", "rolling_cv_7", "rolling_cv_14"
    )


@register(
    "days_since_start",
    _q({"days_since_start": S.SQL_DAYS_SINCE_START, "trend_index": f"CAST(row_number() OVER ({S.W_KEY}) - 1 AS INTEGER)"}),
)
def q_days(spark, d):
    return _daily(spark, d).withColumns({"days_since_start": features.days_since_start(), "trend_index": features.trend_index()})


_FULL_RND = tuple(
    list(_CYC) + list(_RM) + list(_RS) + list(_EX) + ["wow_pct_change", "rolling_cv_7", "rolling_cv_14"]
)


@register("full_features", with_ctes("daily") + S.sql_full_features(), rnd=_FULL_RND)
def q_full(spark, d):
    return features.full_features(_daily(spark, d))


@register(
    "drop_incomplete",
    with_ctes("daily") + "SELECT * FROM (" + S.sql_full_features() + ") WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ["lag_28", "rolling_mean_28", "rolling_std_28", "rolling_median_28", "expanding_std", "wow_pct_change", "rolling_cv_7", "rolling_cv_14"]),
    rnd=_FULL_RND,
)
def q_drop_incomplete(spark, d):
    return features.drop_incomplete(features.full_features(_daily(spark, d)))


_RANGE_SQL = (
    with_ctes("daily")
    + "SELECT series_key, date, sales, rolling_max_7 - rolling_min_7 AS rolling_range_7, rolling_max_14 - rolling_min_14 AS rolling_range_14 FROM (\n"
    + S.sql_select(S.sql_rolling((7, 14), ("min", "max")))
    + "\n)"
)


@register("rolling_range", _RANGE_SQL)
def q_range(spark, d):
    df = _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14), ("min", "max")))
    return df.withColumns({f"rolling_range_{w}": F.col(f"rolling_max_{w}") - F.col(f"rolling_min_{w}") for w in (7, 14)}).select(
        *BASE, "rolling_range_7", "rolling_range_14"
    )


_CV_SQL = (
    with_ctes("daily")
    + "SELECT series_key, date, sales, rolling_std_7 / nullif(rolling_mean_7, 0) AS rolling_cv_7, rolling_std_14 / nullif(rolling_mean_14, 0) AS rolling_cv_14 FROM (\n"
    + S.sql_select(S.sql_rolling((7, 14), ("mean", "std")))
    + "\n)"
)


@register("rolling_cv", _CV_SQL, rnd=("rolling_cv_7", "rolling_cv_14"))
def q_cv(spark, d):
    df = _daily(spark, d).withColumns(features.rolling_columns("sales", (7, 14), ("mean", "std", "min", "max")))
    return df.withColumns(features.derived_rolling((7, 14))).select(*BASE, "rolling_cv_7", "rolling_cv_14")


@register("trend_index", _q({"trend_index": f"CAST(row_number() OVER ({S.W_KEY}) - 1 AS INTEGER)"}))
def q_trend_index(spark, d):
    return _daily(spark, d).withColumn("trend_index", features.trend_index())
