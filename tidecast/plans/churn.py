"""End-to-end churn analysis: features -> labels -> classifiers (stratified
CV and hold-out) -> best model by test AUC -> scores for every customer ->
risk bands, interventions and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import churn, customers, metrics, models, splits
from tidecast.session import stored
from tidecast.sources.invoices import prepared_invoices


@dataclass
class ChurnResult:
    features: DataFrame
    comparison: DataFrame
    importance: DataFrame
    scored: DataFrame
    interventions: DataFrame
    risk_summary: DataFrame
    exec_summary: DataFrame


#: Blocks of the stack's out-of-fold predictions.
STACK_FOLDS = 3


def default_classifiers(trees: int = 200, iters: int = 200) -> list[models.ModelSpec]:
    return [
        models.logistic(1.0),
        models.random_forest_clf(trees, 10),
        models.gbt_clf(iters, 5, 0.05),
        models.boosted_trees_clf(iters, 5, 0.05, 3.0),
    ]


def run_churn(
    spark: SparkSession,
    sf_dir: str,
    churn_days: int = 90,
    specs: list[models.ModelSpec] | None = None,
    folds: int = 5,
    seed: int = 42,
) -> ChurnResult:
    """``folds=0`` leaves cross-validation out: its columns are NULL, and the
    best model, chosen by test AUC, is the same."""
    feat = customers.customer_features(prepared_invoices(spark, sf_dir, "nation", fill_zero=True))
    lab = churn.churn_labels(feat, churn_days)
    x = customers.impute_zero(lab)
    x = stored(splits.stratified_split(x, "churn_label", 0.2, seed), "customers")
    cols = list(customers.CHURN_FEATURES)
    train = x.where("role = 'train'")
    specs = specs or default_classifiers()

    # Folds of the cross-validation and of the stack are columns; a row's part
    # is its pair of them, so the models of all folds and the full ones are
    # fitted together.
    cvd = splits.stratified_folds(train, "churn_label", folds, seed) if folds else train
    weighted = models.with_stack_fold(churn.class_weights(cvd, "churn_label", "balanced"), STACK_FOLDS, "customer_no")
    together = folds * STACK_FOLDS <= models.MAX_PARTS
    number = F.col("fold") if folds and together else F.lit(0)
    weighted = stored(weighted.withColumn("_part", number * STACK_FOLDS + F.col("_fold")), "train")
    pairs = [(k, q) for k in range(folds if folds and together else 1) for q in range(STACK_FOLDS)]
    base_specs = [s for s in specs if s.name in ("logistic", "random_forest", "boosted_trees")]
    stacked, every = len(base_specs) >= 2, [s.name for s in specs]
    wanted = [(lambda k, q: True, every)]
    wanted += [(lambda k, q, f=f: q != f, [s.name for s in base_specs]) for f in range(STACK_FOLDS if stacked else 0)]
    wanted += [(lambda k, q, f=f: k != f, every) for f in range(folds if together else 0)]
    unions = [[k * STACK_FOLDS + q for k, q in pairs if inside(k, q)] for inside, _ in wanted]
    fits = models.fit_parts(specs, weighted, cols, "churn_label", unions, "_part", [names for _, names in wanted])
    if folds:
        held = [([p for p in range(folds) if p != k], k) for k in range(folds)]
        known = fits[-folds:] if together else None
        cv = models.cross_validate(specs, weighted, cols, "churn_label", "fold", held, "clf", fitted=known)
        cv_sum = cv.groupBy("model").agg(
            F.avg("auc").alias("cv_auc"), F.stddev_pop("auc").alias("cv_auc_std"), F.avg("f1").alias("cv_f1")
        )
    fitted: dict = dict(zip(every, fits[0]))
    # Stacking (logistic + random forest + boosted trees -> logistic):
    # scored on the test rows only; its CV AUC is NULL rather than a copy of
    # the test score (q6).
    if stacked:
        meta_spec, at = models.logistic(1.0, balanced=False, scaler=None), [every.index(s.name) for s in base_specs]
        by_fold = [[f[i] for i in at] for f in fits[1 : 1 + STACK_FOLDS]]
        meta = models.stack_meta(by_fold, weighted, base_specs, meta_spec, "churn_label")
        fitted["stacking"] = models.FittedStack([fits[0][i] for i in at], meta, models.ModelSpec("stacking", "stack", kind="clf"))
    # All customers are scored once by every model; test rows rank the models.
    everyone = x
    for name, m in fitted.items():
        # The stack's bases are among the models before it.
        done = {"known": {b.spec.name: f"_p_{b.spec.name}" for b in m.bases}} if isinstance(m, models.FittedStack) else {}
        everyone = m.transform(everyone, f"_p_{name}", **done)
    everyone = stored(everyone, "scored")
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias("probability")) for n in fitted])
    tested = everyone.where("role = 'test'").select(F.col("churn_label").alias("label"), F.inline(each))
    test_scores = metrics.auc_roc(tested).join(metrics.class_metrics(tested), "model").select(
        "model", F.col("auc").alias("test_auc"), F.col("f1").alias("test_f1"),
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
    )
    if folds:
        comparison = cv_sum.join(test_scores, "model", "right").persist()
    else:
        nothing = F.lit(None).cast("double")
        comparison = test_scores.select("model", *[nothing.alias(c) for c in ("cv_auc", "cv_auc_std", "cv_f1")], *test_scores.columns[1:]).persist()
    best = comparison.orderBy(F.col("test_auc").desc(), F.col("model")).first()["model"]  # the winner's name
    probabilities = everyone.withColumn("churn_probability", F.col(f"_p_{best}")).drop(*[f"_p_{n}" for n in fitted])
    scored = churn.score_columns(probabilities)
    # Importances are the forest's where there is one, whichever model wins.
    explained = fitted.get("random_forest") or next(iter(fitted.values()))
    inter = churn.interventions(scored).orderBy(F.col("revenue_at_risk").desc(), "customer_no")
    return ChurnResult(
        features=feat,
        comparison=comparison,
        importance=models.feature_importance(explained, spark),
        scored=scored,
        interventions=inter,
        risk_summary=churn.risk_summary(scored),
        exec_summary=churn.exec_summary(scored),
    )
