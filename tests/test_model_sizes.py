"""Registered model queries fit ensembles of the reference's sizes.

Every query's tree jobs are recorded where they reach the trainer. Classifier
queries and a forest run to their last row here; the larger regressors are
stopped there (their fits take about a minute each; the trainer itself is
tested in ``test_trees``)."""

import pytest

import __spark_entry__ as entry
from tidecast.operators import trees

FOREST, BOOST, GBT = ("forest", 200, 10), ("boost", 500, 6), ("boost", 200, 5)
BACKTEST = {("boost", 200, 6), ("forest", 100, 8), ("boost", 100, 5)}
SIZES = {
    "random_forest_reg": {FOREST},
    "gbt_reg": {GBT},
    "boosted_trees_reg": {BOOST},
    "stacking_reg": {FOREST, GBT},
    "voting_reg": {FOREST, GBT},
    "cross_validate": {FOREST, GBT, BOOST},
    "feature_importance": {FOREST},
    "top_features": {FOREST},
    "recursive_forecast": {BOOST},
    "random_forest_clf": {FOREST},
    "gbt_clf": {GBT},
    "boosted_trees_clf": {GBT},
    "stacking_clf": {FOREST, GBT},
    "score_customers": {FOREST, GBT},
    "backtest": BACKTEST,
    "backtest_multi_step": BACKTEST,
}
WHOLE = ("random_forest_clf", "gbt_clf", "boosted_trees_clf")


class Stopped(Exception):
    pass


@pytest.mark.parametrize("name", sorted(SIZES))
def test_registered_models_have_full_sizes(spark, sf_small, monkeypatch, name):
    seen, fit = set(), trees.fit

    def recorded(data, jobs, *args):
        seen.update((j.kind, j.trees, j.depth) for j in jobs)
        if name not in WHOLE:
            if seen != SIZES[name] and name.startswith("backtest"):
                return [trees.Fitted(j, data.cols, data.edges, 0.0, []) for j in jobs]
            raise Stopped
        return fit(data, jobs, *args)

    monkeypatch.setattr(trees, "fit", recorded)
    if name in WHOLE:
        rows = entry.queries()[name](spark, sf_small).collect()
        assert rows and all(0.0 <= r["probability"] <= 1.0 for r in rows)
    else:
        with pytest.raises(Stopped):
            entry.queries()[name](spark, sf_small)
    assert seen == SIZES[name]
