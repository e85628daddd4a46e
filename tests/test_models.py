"""Fitted forecasters and classifiers: shapes, finiteness, and skill on a
planted weekly pattern (they must beat the training mean)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidecast.operators import arx, decompose, features, grid, metrics, models, recursive
from tidecast.operators.daily import holdout_split

D0 = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for key, scale in (("A", 1.0), ("B", 2.0)):
        for i in range(420):
            d = D0 + dt.timedelta(days=i)
            rows.append((key, d, scale * (100.0 * (1 + d.weekday())) + (i % 5)))
    return spark.createDataFrame(rows, "series_key string, date date, sales double").persist()


def _mae_vs_mean(pred, split):
    train_mean = {r.series_key: r.m for r in split.where("role = 'train'").groupBy("series_key").agg(F.avg("sales").alias("m")).collect()}
    p = pred.collect()
    mae = sum(abs(r.yhat - r.actual) for r in p) / len(p)
    base = sum(abs(train_mean[r.series_key] - r.actual) for r in p) / len(p)
    return mae, base


def test_linear_and_trees_beat_mean(spark, planted):
    split = holdout_split(planted, 30)
    f = features.validation_features(split)
    cols = features.feature_names(f)
    f = features.drop_incomplete(f, cols).persist()
    train, test = f.where("role = 'train'"), f.where("role = 'test'")
    for spec in (models.ridge(1.0), models.random_forest_reg(20, 6, 1), models.gbt_reg(20, 4, 0.3, 1.0)):
        pred = models.predict_long(models.fit_model(spec, train, cols), test)
        mae, base = _mae_vs_mean(pred, split)
        assert mae < base, spec.name


def test_recursive_matches_window_features_and_runs(spark, planted):
    hist = planted.where(F.col("date") < D0 + dt.timedelta(days=300))
    full = features.full_features(planted)
    cols = features.feature_names(full)
    st = recursive.initial_state(hist).withColumn("date", F.date_add("last_date", 1))
    st = st.withColumns({c: recursive.state_features("date")[c] for c in cols})
    a = {r.series_key: r for r in st.collect()}
    b = {r.series_key: r for r in full.where(F.col("date") == D0 + dt.timedelta(days=300)).collect()}
    for k in a:
        for c in cols:
            if b[k][c] is None:
                continue
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-9), c
    m = features.drop_incomplete(features.xgb_features(hist))
    xcols = features.feature_names(m)
    fm = models.fit_model(models.ridge(1.0), m, xcols)
    rows = recursive.recursive_forecast(hist, {"ridge": fm}, xcols, 4).collect()
    steps = recursive.stepwise_forecast(hist, {"ridge": fm}, xcols, 4, checkpoint_every=2).collect()
    by_step = {(r.series_key, r.date, r.step): r.yhat for r in steps}
    assert {(r.series_key, r.date, r.step): pytest.approx(r.yhat, rel=1e-7) for r in rows} == by_step
    assert len(rows) == 8 and all(math.isfinite(r.yhat) and r.yhat >= 0 for r in rows)


def test_decomposition_and_arx_beat_mean(spark, planted):
    split = holdout_split(planted, 30)
    train = split.where("role = 'train'").select("series_key", "date", "sales")
    test = split.where("role = 'test'").select("series_key", "date", F.col("sales").alias("actual"))
    params = grid.param_grid(spark, {"changepoint_prior_scale": [0.05], "seasonality_prior_scale": [10.0], "seasonality_mode": ["additive"]})
    dec = decompose.decompose_frames(train, test, params).where("role = 'future'").drop("actual").join(test, ["series_key", "date"])
    mae, base = _mae_vs_mean(dec, split)
    assert mae < base
    ax = arx.seasonal_arx(train, test, (1, 0, 1), (0, 1, 1, 7), "weekday").where("role = 'future'").drop("actual").join(test, ["series_key", "date"])
    mae2, base2 = _mae_vs_mean(ax, split)
    assert mae2 < base2
    assert ax.where("lower <= yhat and yhat <= upper").count() == ax.count()


def test_grid_search_40_sets(spark, planted):
    split = holdout_split(planted.where("series_key = 'A'"), 30)
    res = decompose.grid_search(split, grid.param_grid(spark, grid.DEFAULT_GRID))
    assert res.count() == 40
    best = decompose.best_params(res).first()
    assert best.mae == res.agg(F.min("mae")).first()[0]


def test_adf_flags_stationary_noise(spark):
    import random

    rnd = random.Random(1)
    rows = [("N", D0 + dt.timedelta(days=i), rnd.gauss(0, 1)) for i in range(300)]
    walk, acc = [], 0.0
    for i in range(300):
        acc += rnd.gauss(0, 1)
        walk.append(("W", D0 + dt.timedelta(days=i), acc))
    df = spark.createDataFrame(rows + walk, "series_key string, date date, sales double")
    got = {r.series_key: r.is_stationary for r in arx.stationarity_test(df).collect()}
    assert got == {"N": True, "W": False}


def test_classifier_and_auc(spark):
    rows = [(str(i), float(i % 10), float((i * 7) % 13), 1 if i % 10 >= 6 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_no string, x1 double, x2 double, churn_label int").withColumn("weight", F.lit(1.0))
    fm = models.fit_model(models.logistic(1.0), df, ["x1", "x2"], "churn_label")
    scored = fm.transform(df, out="probability").select(F.lit("lr").alias("model"), "probability", F.col("churn_label").alias("label"))
    auc = metrics.auc_roc(scored).first().auc
    assert auc > 0.95


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_churn_matrix_is_a_scan_in_few_tasks(spark, sf_small):
    """Later plans must not carry the features' plan nor a cache's partitions."""
    from tidecast.plans import q_models

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        m = q_models._churn_matrix(spark, sf_small)
        assert "InMemoryRelation" not in _plan(m) and "Join" not in _plan(m)
        assert m.rdd.getNumPartitions() < 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_churn_run_fits_and_scores_each_model_once(spark, sf_small, monkeypatch):
    from tidecast.operators import models, trees
    from tidecast.plans import churn

    fitted, fit, drawn, transform = [], trees.fit, [], trees.Fitted.transform
    monkeypatch.setattr(trees, "fit", lambda data, jobs, *a: fitted.extend(jobs) or fit(data, jobs, *a))
    monkeypatch.setattr(trees.Fitted, "transform", lambda self, df, out="yhat": drawn.append(self.job) or transform(self, df, out))
    specs = [models.logistic(1.0), models.random_forest_clf(3, 3), models.boosted_trees_clf(3, 3)]
    got = churn.run_churn(spark, sf_small, specs=specs, folds=0)
    # A forest and a booster on all rows once and on three unions of folds.
    whole = [j for j in fitted if j.parts in (-1, 0b111)]
    assert len(fitted) == 8 and len(whole) == 2
    # All customers by both, and each of three blocks by the models that left it out.
    assert len(drawn) == 2 + 6
    rows = got.comparison.collect()
    assert {r["model"] for r in rows} == {"logistic", "random_forest", "boosted_trees", "stacking"}
    assert all(r["test_auc"] is not None for r in rows)
    assert got.scored.count() == got.features.count()


def test_stack_takes_known_predictions(spark):
    import random

    from tidecast.operators import models

    rng = random.Random(3)
    rows = [(str(i), x, rng.random(), int(x + 0.3 * rng.random() > 0.6)) for i in range(90) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "customer_no string, a double, b double, y int")
    specs, meta = [models.logistic(1.0, balanced=False), models.random_forest_clf(4, 3, False)], models.logistic(1.0, balanced=False, scaler=None)
    full = models.fit_models(specs, df, ["a", "b"], "y")
    one = models.FittedStack(*models.stacking_fit(specs, meta, df, ["a", "b"], "y", 3, "customer_no", full), meta)
    two = models.FittedStack(*models.stacking_fit(specs, meta, df, ["a", "b"], "y", 3, "customer_no"), meta)
    scored = df
    for m in full:
        scored = m.transform(scored, f"_p_{m.spec.name}")
    known = {s.name: f"_p_{s.name}" for s in specs}
    a = {r["customer_no"]: r["p"] for r in one.transform(scored, "p", known).collect()}
    b = {r["customer_no"]: r["p"] for r in two.transform(df, "p").collect()}
    assert len(a) == 90 and all(abs(a[k] - b[k]) < 1e-6 for k in b)
