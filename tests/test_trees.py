"""Histogram trees and exact quantiles against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators import trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 1500
    x = np.round(rng.normal(size=(n, 4)) * [1, 10, 100, 1], 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = np.round(3 * x[:, 0] - 0.2 * x[:, 1] + (x[:, 3] == 1) * 4 + rng.normal(size=n), 3)
    rows = [(i, *map(float, r), float(t), int(t > 0), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, label int, part int").persist()
    return df, x, y


COLS = ["a", "b", "c", "d"]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400) * 1e6, rng.normal(size=300) * 1e-6, [0.0, -0.0, 5.0, 5.0, -1e300, 1e300]])
    rows = [(float(v), float(i % 7), None) for i, v in enumerate(x)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "u double, v double, w double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    u, v, w = exact_quantiles(df, ["u", "v", "w"], probs)
    assert np.allclose(u, np.quantile(x, probs), rtol=1e-12) and v == np.quantile(np.arange(len(x)) % 7, probs).tolist()
    assert w == [None] * len(probs)


def brute_tree(bins, g, h, c, depth, lam, min_rows):
    """Nested (feature, bin, left, right) or a leaf value, by trying every cut."""
    leaf = -g.sum() / (h.sum() + lam)
    best = (1e-9, None)
    for f in range(len(bins)):
        for b in range(trees.BINS - 1):
            left = bins[f] <= b
            if c[left].sum() < min_rows or c[~left].sum() < min_rows or not depth:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + lam) + g[~left].sum() ** 2 / (h[~left].sum() + lam) - g.sum() ** 2 / (h.sum() + lam)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, b, left))
    if best[1] is None:
        return leaf
    f, b, left = best[1]
    return (f, b, *[brute_tree(bins[:, m], g[m], h[m], c[m], depth - 1, lam, min_rows) for m in (left, ~left)])


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    left = tree.left[node]
    return (int(tree.feature[node]), int(tree.bin[node]), nested(tree, left), nested(tree, left + 1))


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-4


def test_small_tree_equals_brute_force(table):
    df, _, _ = table
    data = trees.bin_rows(df, COLS, "y", ["id"])
    rows = trees.Rows.of([r.asDict() for r in data.df.collect()], 4)
    job = trees.Job("boost", 1, 3, rate=1.0, lam=1.0, min_rows=5)
    got = trees.fit(data, [job])[0]
    want = brute_tree(rows.bins, got.base - rows.y, np.ones(len(rows.y)), np.ones(len(rows.y)), 3, 1.0, 5)
    assert same(nested(got.trees[0]), want)


JOBS = [
    trees.Job("forest", 5, 4, min_rows=2),
    trees.Job("boost", 23, 3, rate=0.3, rows=0.8, cols=0.75, lam=1.0, min_rows=3),
    trees.Job("boost", 4, 2, rate=0.5, parts=0b101),
]


def test_distributed_equals_local_in_any_partitioning(table):
    df, _, _ = table
    got = []
    for frame, local in ((df.repartition(1), 1 << 30), (df.repartition(7), 1 << 30), (df.repartition(3), 0)):
        data = trees.bin_rows(frame, COLS, "y", ["id"], part=F.col("part"))
        got.append([[t for f in trees.fit(data, JOBS, local) for t in f.trees]][0])
    for a, b, c in zip(*got):
        for other in (b, c):
            for name in ("feature", "bin", "left", "value"):
                assert np.array_equal(getattr(a, name), getattr(other, name)), name


def test_boosting_forests_and_parts_learn(table):
    df, x, y = table
    data = trees.bin_rows(df, COLS, "y", ["id"], part=F.col("part"))
    full, held = trees.fit(data, [trees.Job("boost", 150, 3, rate=0.1), trees.Job("forest", 40, 8, parts=0b011)])
    assert np.mean((full.predict(x) - y) ** 2) < 0.1 * y.var()
    out = np.arange(len(y)) % 3 == 2
    assert np.mean((held.predict(x)[out] - y[out]) ** 2) < 0.25 * y.var()
    scored = full.transform(df, "p").select("id", "p").toPandas().sort_values("id")["p"].to_numpy()
    assert np.allclose(scored, full.predict(x))
    names = [n for n, v in sorted(full.importance(), key=lambda p: -p[1])]
    assert names[0] == "a" and names[-1] == "c" and abs(sum(v for _, v in full.importance()) - 1) < 1e-9


def test_logistic_boosting_and_weights(table):
    df, x, y = table
    data = trees.bin_rows(df, COLS, "label", ["id"], weight=F.when(F.col("label") == 1, 2.0).otherwise(0.5))
    plain, heavy, weighted = trees.fit(data, [
        trees.Job("boost", 40, 3, rate=0.2, lam=1.0, loss="logistic"),
        trees.Job("boost", 40, 3, rate=0.2, lam=1.0, loss="logistic", pos_weight=5.0),
        trees.Job("forest", 30, 6, loss="logistic", weighted=True),
    ])
    p, label = plain.predict(x), y > 0
    assert ((p > 0.5) == label).mean() > 0.9 and heavy.predict(x).mean() > p.mean()
    assert ((weighted.predict(x) > 0.5) == label).mean() > 0.85


def test_missing_values_constant_columns_and_few_rows(spark):
    df = spark.createDataFrame([(i, float(i) if i % 2 else None, 1.0, float(i % 2)) for i in range(9)], "id long, a double, b double, y double")
    data = trees.bin_rows(df, ["a", "b"], "y", ["id"])
    got = trees.fit(data, [trees.Job("boost", 3, 2, rate=1.0)])[0]
    assert np.allclose(got.predict(np.array([[np.nan, 1.0], [5.0, 1.0]])), [0.0, 1.0], atol=1e-5)
