"""Cross-validation's work by fold: rows that a tree grows on, one scoring pass."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import linear, models, splits, trees
from tidecast.operators.metrics import forecast_metrics

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def parted(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        a, b = float(np.round(rng.normal(), 3)), float(i % 7)
        rows.append((str(i % 2), dt.date(2024, 1, 1) + dt.timedelta(days=i // 2), None if i % 50 == 49 else a, b, 5 * a + b + float(rng.normal()), (i // 2) // 20))
    return spark.createDataFrame(rows, "series_key string, date date, a double, b double, sales double, part int").persist()


SPECS = [models.ridge(1.0), models.kernel_reg(16), models.random_forest_reg(3, 3), models.gbt_reg(3, 2)]
FOLDS = splits.time_series_train(5)


def test_folds_are_scored_in_one_pass_as_by_the_models(spark, parted, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "stored", lambda df, name: seen.setdefault(name, df))
    vote = ("ridge", "random_forest", "gradient_boosting")
    got = {(r.model, r.fold): r for r in models.cross_validate(SPECS, parted, COLS, "sales", "part", FOLDS, vote=vote).collect()}
    plan = seen["predicted"]._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == len(FOLDS)
    fits = models.fit_parts(SPECS, parted, COLS, "sales", [tuple(t) for t, _ in FOLDS], "part")
    for (_, test), fitted, fold in zip(FOLDS, fits, range(1, 6)):
        by_name = {m.spec.name: m for m in fitted}
        by_name["voting"] = models.FittedVote([by_name[n] for n in vote], models.ModelSpec("voting", "vote"))
        for name, m in by_name.items():
            p = m.transform(parted.where(F.col("part") == test), "yhat").select(F.lit(1).alias("k"), F.col("sales").alias("actual"), "yhat")
            want = forecast_metrics(p, ("k",)).first()
            assert np.isclose(got[name, fold].mae, want.mae, rtol=1e-9) and np.isclose(got[name, fold].rmse, want.rmse, rtol=1e-9), name
    rows = {(r.model, r.fold): r.n for r in seen["predicted"].where("p is null").groupBy("model", "fold").agg(F.count("*").alias("n")).collect()}
    # A missing feature leaves the linear model and the mean with it without a prediction.
    assert rows and {m for m, _ in rows} == {"ridge", "voting"} and seen["predicted"].where("isnan(p)").count() == 0


@pytest.mark.parametrize("kind", ["boost", "forest"])
def test_a_job_grows_on_the_rows_of_its_parts(monkeypatch, kind):
    rng = np.random.default_rng(5)
    n = 600
    rows = trees.Rows(rng.integers(0, 64, (3, n)).astype(np.uint8), rng.normal(size=n), np.ones(n), (np.arange(n) % 6).astype(np.uint8), rng.integers(0, 1 << 60, n).astype(np.uint64))
    widths, grow = set(), trees.grow
    monkeypatch.setattr(trees, "grow", lambda job, unit, bins, *more: widths.add(bins.shape[1]) or grow(job, unit, bins, *more))
    job = trees.Job(kind, 4, 3, rate=0.5, rows=0.8, parts=0b11, min_rows=2)
    got = trees._grow_here(job, 0.0, 8.0, rows, range(4))
    assert widths == {200}
    alone = trees._grow_here(trees.replace(job, parts=-1), 0.0, 8.0, rows.take(np.flatnonzero(rows.part < 2)), range(4))
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for a, b in zip(got, alone) for f in ("feature", "bin", "left", "value"))


def test_splits_of_many_nodes_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(6)
    h = np.stack([rng.integers(-90, 90, (9, 2, trees.BINS)), *[rng.integers(1, 9, (9, 2, trees.BINS))] * 2]).astype(float)
    whole = trees.best_splits(h, 1.0, 1.0, 1)
    monkeypatch.setattr(trees, "_SEARCH_CELLS", 4 * trees.BINS)
    for a, b in zip(whole, trees.best_splits(h, 1.0, 1.0, 1)):
        assert np.array_equal(a, b)


def test_columns_of_a_block_are_expanded_once_for_all_folds(spark, parted, tmp_path):
    log = str(tmp_path / "calls")

    def expand(x):
        with open(log, "a") as f:
            f.write("x")
        return np.column_stack([x, x * x])

    frame = parted.na.drop().coalesce(1)
    args = (frame, [F.col(c) for c in COLS], "sales", [linear.tube_terms(0.1, 1.0)], 1.0)
    calls = {}
    for unions in ([(0, 1)], [(0, 1), (0, 1, 2), (0, 1, 2, 3)]):
        open(log, "w").close()
        found = linear.newton_parts(*args, unions, None, F.col("part"), 1, 1e-6, expand, 4)
        calls[len(unions)] = len(open(log).read())
        assert all(np.isfinite(w).all() for w, *_ in found)
    # Blocks of parts 0 and 1, then of parts 0 to 3: once each, not once a union.
    assert calls == {1: 2, 3: 4}
