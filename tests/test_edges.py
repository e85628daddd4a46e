"""Hand-made frames for the edge cases of the blueprint (no fixture tables)."""

import datetime as dt

import pytest
from pyspark.sql import Row

from tidecast.operators import churn, customers, daily, ensemble, features, splits
from tidecast.sources import invoices as src

D0 = dt.date(2024, 1, 1)


def _series(spark, values, key="A", start=D0):
    rows = [(key, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, date date, sales double")


def test_gap_fill_fills_missing_week(spark):
    rows = [("A", D0 + dt.timedelta(days=i), 100.0 * (1 + (D0 + dt.timedelta(days=i)).weekday())) for i in range(120) if not 50 <= i < 57]
    df = spark.createDataFrame(rows, "series_key string, date date, sales double")
    filled = daily.gap_fill(df).orderBy("date").collect()
    assert len(filled) == 120
    assert [r.sales for r in filled[50:57]] == [0.0] * 7


def test_wow_pct_change_null_eight_days_after_zero(spark):
    vals = [10.0] * 40
    vals[20] = 0.0
    df = _series(spark, vals).withColumns(features.wow_columns())
    rows = df.orderBy("date").collect()
    assert rows[28].wow_pct_change is None
    assert rows[27].wow_pct_change == pytest.approx(0.0)


def test_rolling_28_null_until_row_29(spark):
    df = _series(spark, range(1, 30)).withColumns(features.rolling_columns("sales", (28,), ("mean",)))
    rows = df.orderBy("date").collect()
    assert all(r.rolling_mean_28 is None for r in rows[:28])
    assert rows[28].rolling_mean_28 == pytest.approx(sum(range(1, 29)) / 28)


def test_leak_free_features(spark):
    base = [float(10 + (i % 7) * 3) for i in range(80)]
    changed = list(base)
    changed[50] = 9999.0
    cols = None
    out = []
    for vals in (base, changed):
        f = features.full_features(_series(spark, vals))
        cols = features.feature_names(f)
        out.append({r.date: r for r in f.collect()})
    t = D0 + dt.timedelta(days=50)
    for day in out[0]:
        if day <= t:
            for c in cols:
                assert out[0][day][c] == out[1][day][c], (day, c)


def _inv(spark, rows):
    return spark.createDataFrame(
        [Row(invoice_number=str(i), invoice_date=d, customer_no=c, customer_name=n, amount=a, invoice_type="IN", series_key="ALL")
         for i, (c, n, d, a) in enumerate(rows)],
        "invoice_number string, invoice_date date, customer_no string, customer_name string, amount decimal(18,2), invoice_type string, series_key string",
    )


def test_customer_edge_cases(spark):
    from decimal import Decimal

    ref = dt.date(2024, 12, 31)
    rows = [
        ("one", "Olga", dt.date(2024, 6, 1), Decimal("100.00")),
        ("same", "Sam", dt.date(2024, 7, 1), Decimal("10.00")),
        ("same", "Sam", dt.date(2024, 7, 1), Decimal("30.00")),
        ("quarter", "Quinn", dt.date(2024, 4, 2), Decimal("5.00")),
        ("quarter", "Quinn", dt.date(2024, 5, 2), Decimal("5.00")),
        ("quarter", "Quinn", dt.date(2024, 6, 2), Decimal("5.00")),
        ("edge", "Eve", ref - dt.timedelta(days=180), Decimal("1.00")),
        ("edge", "Eve", ref - dt.timedelta(days=365), Decimal("2.00")),
    ]
    f = {r.customer_no: r for r in customers.customer_features(_inv(spark, rows), ref).collect()}
    one = f["one"]
    assert one.avg_gap == one.customer_tenure == one.min_gap == one.median_gap
    assert one.gap_std == 0.0 and one.gap_cv == 0.0
    same = f["same"]
    assert same.avg_gap == 0.0 and same.gap_cv == 0.0
    assert same.recency_gap_ratio == same.recency
    assert f["quarter"].seasonality_cv is None
    assert f["quarter"].peak_quarter == 2
    edge = f["edge"]
    assert edge.recent_orders == 1 and edge.prior_orders == 1
    assert edge.order_trend == 0.0


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.5, 0.7, 1.0, 0.31)], "p double")
    got = {r.p: r.band for r in df.select("p", churn.risk_bucket("p").alias("band")).collect()}
    assert got == {0.0: None, 0.3: "Low", 0.5: "Medium", 0.7: "High", 1.0: "Critical", 0.31: "Medium"}


def test_amount_coercion_two_modes(spark):
    df = spark.createDataFrame([("12.5",), ("x",), (None,)], "amount string")
    a = [r[0] for r in df.select(src.coerce_amount("amount")).collect()]
    z = [r[0] for r in df.select(src.coerce_amount("amount", fill_zero=True)).collect()]
    assert [None if v is None else float(v) for v in a] == [12.5, None, None]
    assert [float(v) for v in z] == [12.5, 0.0, 0.0]


@pytest.mark.parametrize("n", [60, 61, 65])
def test_time_series_fold_sizes(spark, n):
    df = _series(spark, range(n))
    f = splits.time_series_folds(df, 5)
    ts = n // 6
    sizes = {r.fold: r["count"] for r in f.where("role = 'test'").groupBy("fold").count().collect()}
    assert sizes == {k: ts for k in range(1, 6)}
    first_train = f.where("fold = 1 and role = 'train'").count()
    assert first_train == n - 5 * ts


def test_ensemble_joins_on_date_not_position(spark):
    rows = [("A", "m1", D0 + dt.timedelta(days=i), 10.0, None, None) for i in range(5)]
    rows += [("A", "m2", D0 + dt.timedelta(days=i + 2), 20.0, None, None) for i in range(5)]
    long = spark.createDataFrame(rows, "series_key string, model string, date date, yhat double, lower double, upper double")
    w = ensemble.weights_frame(spark, {"m1": 0.5, "m2": 0.5}, {"m1": (0.8, 1.2), "m2": (0.8, 1.2)})
    got = {r.date: r.ensemble for r in ensemble.weighted_ensemble(long, w).collect()}
    assert got[D0] == 10.0
    assert got[D0 + dt.timedelta(days=3)] == 15.0
    assert got[D0 + dt.timedelta(days=6)] == 20.0


def test_published_arithmetic(spark):
    # Ensemble row: .15*117978.30 + .25*147691.22 + .25*154263.61 + .35*162357.02
    rows = [("ALL", m, D0, v, None, None) for m, v in (("decompose", 117978.30), ("boosted_trees", 147691.22), ("stacking", 154263.61), ("seasonal_arx", 162357.02))]
    long = spark.createDataFrame(rows, "series_key string, model string, date date, yhat double, lower double, upper double")
    w = ensemble.weights_frame(spark, ensemble.DEFAULT_WEIGHTS, ensemble.DEFAULT_BANDS)
    e = ensemble.weighted_ensemble(long, w).first().ensemble
    assert e == pytest.approx(150010.41, abs=0.01)


def _arx_frame(y, n_train, start="2022-01-03"):
    import numpy as np
    import pandas as pd

    dates = pd.date_range(start, periods=len(y))
    x = {f"wd{i}": (dates.weekday == i).astype(float) for i in range(6)}
    x |= {f"m{m}": (dates.month == m).astype(float) for m in range(1, 12)} | {"month_end": dates.is_month_end.astype(float)}
    known = [*y[:n_train], *[np.nan] * (len(y) - n_train)]
    role = ["train"] * n_train + ["future"] * (len(y) - n_train)
    return pd.DataFrame({"series_key": "A", "date": dates.date, "role": role, "actual": known, **x}), list(x)


def test_arx_forecasts_scale_with_units_and_keep_flag_effects():
    import numpy as np
    import pandas as pd

    from tidecast.operators.arx import fit_arx

    dates = pd.date_range("2022-01-03", periods=760)
    y = 100_000 + np.random.default_rng(0).normal(0, 4000, 760) + 60_000 * dates.is_month_end
    got = []
    for unit in (1.0, 1e-5):
        frame, names = _arx_frame(y * unit, 745)
        got.append(fit_arx(frame, (1, 1, 1), (1, 1, 1, 7), names)["yhat"].to_numpy()[745:] / unit)
    assert np.allclose(got[0], got[1], rtol=1e-6)
    last = np.asarray(dates.is_month_end)[745:]
    assert abs(got[0][last][0] - 160_000) < 10_000 and abs(got[0][~last] - 100_000).max() < 15_000


def test_arx_uses_all_orders_and_differences():
    import numpy as np

    from tidecast.operators.arx import _lags, fit_arx

    assert _lags(3, 2, 7) == [1, 2, 3, 7, 8, 9, 10, 14, 15, 16, 17] and _lags(0, 1, 7) == [7]
    y = np.cumsum(np.cumsum(np.full(300, 0.5))) + 10
    frame, _ = _arx_frame(y, 290)
    out = fit_arx(frame, (1, 2, 1), (0, 0, 0, 7), [])
    assert np.allclose(out["yhat"].to_numpy()[290:], y[290:], rtol=1e-3)


def test_adf_returns_a_row_for_short_series(spark):
    import datetime as dt

    from tidecast.operators.arx import stationarity_test

    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i * i % 7)) for k, n in (("a", 1), ("b", 3), ("c", 60)) for i in range(n)]
    got = {r.series_key: r.status for r in stationarity_test(spark.createDataFrame(rows, "series_key string, date date, sales double")).collect()}
    assert got == {"a": "too_short", "b": "too_short", "c": "ok"}


def test_recursion_keeps_history_of_short_series(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from tidecast.operators.recursive import recursive_forecast

    class Sum:
        def transform(self, df, out):
            return df.withColumn(out, F.col("lag_1") + F.col("lag_3"))

    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i + 1)) for i in range(10)]
    daily = spark.createDataFrame(rows, "series_key string, date date, sales double")
    got = [r.yhat for r in recursive_forecast(daily, {"m": Sum()}, ["lag_1", "lag_3"], 4).orderBy("step").collect()]
    assert got == [18.0, 27.0, 37.0, 55.0]


def test_grid_scales_matter_for_a_level_shift():
    import numpy as np
    import pandas as pd

    from tidecast.operators.decompose import fit_decomposition

    dates = pd.date_range("2022-01-03", periods=430)
    y = np.where(np.arange(430) < 200, 50_000.0, 90_000.0) + np.random.default_rng(1).normal(0, 1000, 430)
    frame = pd.DataFrame({"series_key": "A", "date": dates.date, "role": ["train"] * 400 + ["future"] * 30, "actual": [*y[:400], *[np.nan] * 30], "holiday": None})
    errors = [abs(fit_decomposition(frame, s, 1.0, "additive")["yhat"].to_numpy()[400:] - y[400:]).mean() for s in (0.0001, 0.1)]
    assert errors[1] < errors[0]
    out = fit_decomposition(frame.assign(actual=frame["actual"] * 0 + 1.0), 0.05, 1.0, "additive")
    assert (out["yhat"] >= 0).all() and (out["yhat_lower"] >= 0).all()


def test_stream_replay_of_an_epoch_counts_once(spark, tmp_path):
    from tidecast.sources.invoices import RAW_INVOICE_SCHEMA
    from tidecast.streaming.daily_refresh import refresh_batch

    names = RAW_INVOICE_SCHEMA.names
    row = {"invoice_number": "1", "invoice_date": "2024-01-02", "customer_no": "7", "amount": "10.00", "invoice_type": "IN"}
    batch = spark.createDataFrame([tuple(row.get(n) for n in names) + ("ALL",)], ", ".join(f"{n} string" for n in [*names, "series_key"]))
    for _ in range(2):
        refresh_batch(batch, f"{tmp_path}/store", f"{tmp_path}/daily", 3)
    got = spark.read.parquet(f"{tmp_path}/daily").collect()
    assert [(float(r.sales), r.invoice_count) for r in got] == [(10.0, 1)]
