"""End-to-end plans on the smallest fixture, with small ensembles."""

import math


def test_forecast_plan(spark, sf_small):
    from tidecast.plans.forecast import forecast_all

    long, ens = forecast_all(spark, sf_small, series="all", horizon=14, sizes=(5, 5, 5))
    counts = {r.model: r["count"] for r in long.groupBy("model").count().collect()}
    assert counts == {"decompose": 14, "seasonal_arx": 14, "boosted_trees": 14, "stacking": 14}
    rows = ens.collect()
    assert len(rows) == 14
    assert all(r.n_models == 4 and r.ensemble >= 0 and r.ensemble_lower >= 0 and math.isfinite(r.ensemble_upper) for r in rows)


def test_churn_plan(spark, sf_small):
    from tidecast.plans.churn import default_classifiers, run_churn

    r = run_churn(spark, sf_small, specs=default_classifiers(5, 5), folds=3)
    comp = {row.model: row for row in r.comparison.collect()}
    assert set(comp) == {"logistic", "random_forest", "gradient_boosting", "boosted_trees", "stacking"}
    assert comp["stacking"].cv_auc is None
    n = r.scored.count()
    assert n == r.features.count() and n > 0
    assert r.interventions.where("churn_probability <= 0.3").count() == 0
