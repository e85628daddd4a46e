"""Registered queries: forecasters and churn classifiers.

These are statistical fits, checked rows-only (no SQL twin): each query
trains on the given tables' training rows and returns predictions or
scores for the held-out rows. Ensembles have the library's default sizes,
which are the reference's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import churn, customers, daily, features, models, splits
from tidecast.plans.checks import register
from tidecast.plans.sql_oracle import with_ctes
from tidecast.session import stored
from tidecast.sources import invoices as src

KEY = "series_key"


def _matrix(spark, d, series="nation"):
    """Full 61-feature matrix with train / test role (30-day hold-out)."""
    dd = daily.gap_fill(daily.daily_sales(src.prepared_invoices(spark, d, series)))
    feats = features.full_features(daily.holdout_split(dd, 30))
    cols = features.feature_names(feats)
    # q9: a missing ratio (zero sales 8 days earlier) is imputed as 0 so those
    # rows are kept; other rows with missing windows (the first 28 days) drop.
    feats = feats.fillna(0.0, subset=["wow_pct_change", "rolling_cv_7", "rolling_cv_14"])
    # The matrix feeds several passes (scaler, label stats, fit, predict):
    # store it once instead of re-running the windows for each pass.
    return stored(features.drop_incomplete(feats, cols), "matrix"), cols


def _fit_predict(spark, d, spec):
    m, cols = _matrix(spark, d)
    train, test = m.where("role = 'train'"), m.where("role = 'test'")
    fitted = models.fit_model(spec, train, cols, "sales")
    return models.predict_long(fitted, test, "sales")


for _name, _spec in (
    ("ridge", lambda: models.ridge(1.0)),
    ("lasso", lambda: models.lasso(100.0)),
    ("elastic_net", lambda: models.elastic_net(100.0, 0.5)),
    ("random_forest_reg", lambda: models.random_forest_reg()),
    ("gbt_reg", lambda: models.gbt_reg()),
    ("boosted_trees_reg", lambda: models.boosted_trees_reg()),
    ("kernel_reg", lambda: models.kernel_reg(256)),
):
    register(_name)(lambda spark, d, _s=_spec: _fit_predict(spark, d, _s()))


@register("stacking_reg")
def q_stacking(spark, d):
    m, cols = _matrix(spark, d)
    train, test = m.where("role = 'train'"), m.where("role = 'test'")
    bases, meta = models.stacking_fit([models.random_forest_reg(), models.gbt_reg()], models.ridge(1.0, scaler=None), train, cols, "sales", 3)
    p = models.stacking_predict(bases, meta, test)
    return p.select(KEY, F.lit("stacking").alias("model"), "date", F.col("sales").alias("actual"),
                    F.greatest(F.col("yhat"), F.lit(0.0)).alias("yhat"))


@register("voting_reg")
def q_voting(spark, d):
    m, cols = _matrix(spark, d)
    train, test = m.where("role = 'train'"), m.where("role = 'test'")
    long = None
    for fitted in models.fit_models([models.ridge(1.0), models.random_forest_reg(), models.gbt_reg()], train, cols):
        p = models.predict_long(fitted, test)
        long = p if long is None else long.unionByName(p)
    return models.voting(long)


@register("cross_validate")
def q_cv(spark, d):
    """Every regressor and the mean of three on five time-series folds."""
    m, cols = _matrix(spark, d)
    parted = stored(splits.time_series_parts(m.where("role = 'train'").drop("role"), 5), "parts")
    specs = [models.ridge(1.0), models.lasso(100.0), models.elastic_net(100.0, 0.5), models.kernel_reg(256),
             models.random_forest_reg(), models.gbt_reg(), models.boosted_trees_reg()]
    per_fold = models.cross_validate(
        specs, parted, cols, "sales", "part", splits.time_series_train(5),
        vote=("ridge", "random_forest", "gradient_boosting"),
    )
    return models.cv_summary(per_fold)


def _forest_importance(spark, d):
    m, cols = _matrix(spark, d)
    fitted = models.fit_model(models.random_forest_reg(), m.where("role = 'train'"), cols)
    return models.feature_importance(fitted, spark)


register("feature_importance")(_forest_importance)
register("top_features")(lambda spark, d: models.top_features(_forest_importance(spark, d), 10))


# ------------------------------------------------------------------ churn
def _churn_matrix(spark, d):
    f = customers.customer_features(src.prepared_invoices(spark, d, "nation", fill_zero=True))
    lab = churn.churn_labels(f)
    x = customers.impute_zero(lab)
    return stored(splits.stratified_split(x, "churn_label", 0.2, 42), "customers")


def _train_test(m, weights="balanced"):
    """Training rows with class weights from them alone, and test rows."""
    return churn.class_weights(m.where("role = 'train'"), "churn_label", weights), m.where("role = 'test'")


def _clf(spark, d, spec, weights="balanced"):
    train, test = _train_test(_churn_matrix(spark, d), weights)
    fitted = models.fit_model(spec, train, list(customers.CHURN_FEATURES), "churn_label")
    return fitted.transform(test, out="probability").select(
        F.lit(spec.name).alias("model"), "customer_no", "probability", F.col("churn_label").alias("label")
    )


register("logistic")(lambda spark, d: _clf(spark, d, models.logistic(1.0)))
register("random_forest_clf")(lambda spark, d: _clf(spark, d, models.random_forest_clf()))
register("gbt_clf")(lambda spark, d: _clf(spark, d, models.gbt_clf()))
register("boosted_trees_clf")(lambda spark, d: _clf(spark, d, models.boosted_trees_clf(), "positive"))


@register("stacking_clf")
def q_stacking_clf(spark, d):
    m = _churn_matrix(spark, d)
    train, test = _train_test(m)
    cols = list(customers.CHURN_FEATURES)
    bases, meta = models.stacking_fit(
        [models.logistic(1.0), models.random_forest_clf(), models.boosted_trees_clf()],
        models.logistic(1.0, balanced=False, scaler=None), train, cols, "churn_label", 3, order="customer_no",
    )
    p = models.stacking_predict(bases, meta, test, out="probability")
    return p.select(F.lit("stacking").alias("model"), "customer_no", "probability", F.col("churn_label").alias("label"))


@register("cross_validate_clf")
def q_cv_clf(spark, d):
    """Every classifier on five stratified folds of the training customers."""
    from tidecast.plans.churn import default_classifiers

    train, _ = _train_test(_churn_matrix(spark, d))
    folded = stored(splits.stratified_folds(train, "churn_label", 5, 42), "folds")
    folds = [([p for p in range(5) if p != k], k) for k in range(5)]
    per_fold = models.cross_validate(default_classifiers(), folded, list(customers.CHURN_FEATURES), "churn_label", "fold", folds, "clf")
    return models.cv_summary(per_fold, ("auc", "f1", "precision", "recall"))


def _churn(spark, d, folds=0):
    from tidecast.plans.churn import run_churn

    return run_churn(spark, d, folds=folds)


@register("score_customers")
def q_score(spark, d):
    """Every customer's probability by the model with the best test AUC."""
    return _churn(spark, d).scored.select("customer_no", "churn_probability", "risk_category", "revenue_at_risk")


@register("churn_comparison")
def q_churn_comparison(spark, d):
    """Five-fold stratified cross-validation and test scores of every model."""
    return _churn(spark, d, folds=5).comparison


register("churn_interventions")(lambda spark, d: _churn(spark, d).interventions)


def _labelled(spark, d):
    f = customers.customer_features(src.prepared_invoices(spark, d, "nation", fill_zero=True))
    return churn.churn_labels(f).select("customer_no", "churn_label")


def _sql_ranked(seed):
    return f"""
SELECT customer_no, churn_label, count(*) OVER (PARTITION BY churn_label) AS n,
       row_number() OVER (PARTITION BY churn_label ORDER BY ('0x' || md5(customer_no || ':{seed}')[1:13])::BIGINT, customer_no) AS nth
FROM churn_lab"""


@register(
    "stratified_split",
    with_ctes("churn_lab") + f"SELECT customer_no, churn_label, CASE WHEN nth <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS role FROM ({_sql_ranked(42)})",
)
def q_strat_split(spark, d):
    return splits.stratified_split(_labelled(spark, d), "churn_label", 0.2, 42).select("customer_no", "churn_label", "role")


@register(
    "stratified_folds",
    with_ctes("churn_lab") + f"SELECT customer_no, churn_label, CAST((nth - 1) % 5 AS INTEGER) AS fold FROM ({_sql_ranked(43)})",
)
def q_strat_folds(spark, d):
    return splits.stratified_folds(_labelled(spark, d), "churn_label", 5, 42).select("customer_no", "churn_label", "fold")


@register(
    "scale_features",
    with_ctes("custfeat")
    + """SELECT customer_no, (recency - m_r) / CASE WHEN s_r = 0 THEN 1 ELSE s_r END AS recency,
       (monetary - m_m) / CASE WHEN s_m = 0 THEN 1 ELSE s_m END AS monetary
FROM custfeat, (SELECT quantile_cont(recency, 0.5) AS m_r, quantile_cont(recency, 0.75) - quantile_cont(recency, 0.25) AS s_r,
                       quantile_cont(monetary, 0.5) AS m_m, quantile_cont(monetary, 0.75) - quantile_cont(monetary, 0.25) AS s_m FROM custfeat)""",
    rnd=("recency", "monetary"),
)
def q_scale(spark, d):
    f = customers.customer_features(src.prepared_invoices(spark, d, "nation", fill_zero=True)).select("customer_no", "recency", "monetary")
    return models.ColumnScaler.fit(f, ["recency", "monetary"], "robust").transform(f)
