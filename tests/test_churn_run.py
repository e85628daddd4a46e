"""The churn run: cross-validation in the comparison, models of all folds fitted together."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecast.operators import churn, customers, models, splits, trees
from tidecast.plans import churn as plan

SMALL = [models.logistic(1.0), models.random_forest_clf(4, 3), models.gbt_clf(4, 2, 0.3), models.boosted_trees_clf(4, 2, 0.3)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of 150 customers, some quiet for long, some of no customer."""
    path, rng = str(tmp_path_factory.mktemp("churn")), np.random.default_rng(11)
    orders, day = [], dt.datetime(2024, 1, 1)
    for c in range(150):
        last = int(rng.integers(200, 700))
        for d in rng.integers(0, last, int(rng.integers(1, 12))).tolist():
            orders.append((len(orders), c, "OFP"[len(orders) % 3], float(np.round(rng.uniform(10, 9000), 2)), day + dt.timedelta(days=d)))
    orders += [(len(orders), None, "O", 5.0, day), (len(orders) + 1, 1, "F", None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    people = [(c, f"n{c}", c % 5, "A") for c in range(160)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return path


def test_comparison_has_five_folds_of_every_model(spark, tables, monkeypatch):
    monkeypatch.setattr(plan, "default_classifiers", lambda: SMALL)
    got = {r.model: r for r in entry.queries()["churn_comparison"](spark, tables).collect()}
    assert set(got) == {"logistic", "random_forest", "gradient_boosting", "boosted_trees", "stacking"}
    # The folds fitted on their own, not together with the stack's and the full models.
    from tidecast.plans.q_models import _churn_matrix

    train = churn.class_weights(_churn_matrix(spark, tables).where("role = 'train'"))
    folded = splits.stratified_folds(train, "churn_label", 5, 42).persist()
    folds = [([p for p in range(5) if p != k], k) for k in range(5)]
    each = models.cross_validate(SMALL, folded, list(customers.CHURN_FEATURES), "churn_label", "fold", folds, "clf")
    want = {r.model: r for r in each.groupBy("model").agg(F.avg("auc").alias("a"), F.stddev_pop("auc").alias("s"), F.avg("f1").alias("f"), F.count("*").alias("n")).collect()}
    for name, w in want.items():
        assert w.n == 5 and np.allclose([got[name].cv_auc, got[name].cv_auc_std, got[name].cv_f1], [w.a, w.s, w.f], atol=1e-9), name
    assert got["stacking"].cv_auc is None and got["stacking"].test_auc is not None


def test_models_of_all_folds_are_fitted_in_one_go(spark, tables, monkeypatch):
    fits, fit = [], trees.fit
    monkeypatch.setattr(trees, "fit", lambda data, jobs, *more: fits.append(len(jobs)) or fit(data, jobs, *more))
    plan.run_churn(spark, tables, specs=SMALL, folds=5)
    # Three tree models on all rows and on five folds, two of them on three blocks of the stack.
    assert fits == [3 + 2 * 3 + 3 * 5]


def test_stack_equals_its_blocks_fitted_on_their_own(spark, tables):
    got = {f: plan.run_churn(spark, tables, specs=SMALL, folds=f) for f in (0, 2)}
    a, b = ({r.customer_no: r.churn_probability for r in got[f].scored.collect()} for f in (0, 2))
    assert len(a) == len(b) > 100 and all(abs(a[c] - b[c]) < 1e-9 for c in a)
    x = customers.impute_zero(got[0].features)
    train = churn.class_weights(splits.stratified_split(churn.churn_labels(x)).where("role = 'train'"))
    cols = list(customers.CHURN_FEATURES)
    meta = models.logistic(1.0, balanced=False, scaler=None)
    bases, top = models.stacking_fit([SMALL[0], SMALL[1], SMALL[3]], meta, train, cols, "churn_label", 3, order="customer_no")
    test = splits.stratified_split(churn.churn_labels(x)).where("role = 'test'")
    from tidecast.operators import metrics

    p = models.stacking_predict(bases, top, test, out="probability").select(F.lit("stacking").alias("model"), "probability", F.col("churn_label").alias("label"))
    want = metrics.auc_roc(p).first()["auc"]
    assert abs(got[0].comparison.where("model = 'stacking'").first()["test_auc"] - want) < 1e-9
