"""Linear fits reproduce the documented least-squares
objectives (intercept unpenalised), checked against numpy solutions."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidecast.operators import linear, models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n, k = 400, 5
    x = rng.normal(size=(n, k)) * [1, 2, 3, 0.5, 1]
    y = x @ [3, -2, 1, 0.5, 4] + 10 + rng.normal(size=n) * 5
    df = spark.createDataFrame(
        [tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], ", ".join(f"x{i} double" for i in range(k)) + ", y double"
    )
    return x, y, df, [f"x{i}" for i in range(k)]


def _coef(spec, df, cols):
    spec.scaler = None
    return models.fit_model(spec, df, cols, "y").coefficients


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_matches_closed_form(data, alpha):
    x, y, df, cols = data
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(_coef(models.ridge(alpha), df, cols), w, rtol=1e-6)


def test_lasso_matches_coordinate_descent(data):
    x, y, df, cols = data
    alpha = 2.0
    xc, yc = x - x.mean(0), y - y.mean()
    n = len(y)
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            z = xc[:, j] @ xc[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / z
    assert np.allclose(_coef(models.lasso(alpha), df, cols), w, rtol=1e-3, atol=1e-3)


def test_elastic_net_matches_coordinate_descent(data):
    x, y, df, cols = data
    alpha, mix = 4.0, 0.5
    xc, yc = x - x.mean(0), y - y.mean()
    n = len(y)
    l1, l2 = alpha * mix, alpha * (1 - mix)
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            z = xc[:, j] @ xc[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (z + l2)
    assert np.allclose(_coef(models.elastic_net(alpha, mix), df, cols), w, rtol=1e-3, atol=1e-3)


def test_logistic_matches_newton(spark):
    from tidecast.operators import churn

    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.5] - 1.0)))
    y = (rng.uniform(size=n) < p).astype(int)
    df = spark.createDataFrame([tuple(map(float, r)) + (int(t),) for r, t in zip(x, y)], "x0 double, x1 double, x2 double, churn_label int")
    df = churn.class_weights(df, "churn_label", "balanced")
    wts = np.where(y == 1, n / (2.0 * y.sum()), n / (2.0 * (n - y.sum())))
    # Newton on: sum_i w_i logloss_i + (1 / 2C) ||beta||^2, intercept free (C = 1).
    xa = np.hstack([np.ones((n, 1)), x])
    b = np.zeros(4)
    reg = np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-(xa @ b)))
        g = xa.T @ (wts * (mu - y)) + reg @ b
        h = xa.T @ (xa * (wts * mu * (1 - mu))[:, None]) + reg
        b -= np.linalg.solve(h, g)
    spec = models.logistic(1.0)
    spec.scaler = None
    m = models.fit_model(spec, df, ["x0", "x1", "x2"], "churn_label")
    assert np.allclose(m.coefficients, b[1:], rtol=1e-7)
    assert abs(m.intercept - b[0]) < 1e-7


def test_logistic_takes_few_passes_and_ends_at_a_flat_point(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([tuple(map(float, r)) + (int(t),) for r, t in zip(x, y)], "x0 double, x1 double, x2 double, x3 double, y int").repartition(3)
    columns = [F.col(f"x{i}") for i in range(4)]
    w, b, passes = linear.newton(df, columns, "y", linear.logistic_terms, 1.0)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) + w
    assert np.abs(slope).max() < 1e-6 and passes < 10


def test_gram_parts_add_up_and_solutions_are_optimal(data):
    x, y, df, cols = data
    parts = df.withColumn("part", F.pmod(F.xxhash64("y"), F.lit(3)).cast("int")).repartition(5)
    grams = linear.gram(parts, [F.col(c) for c in cols], "y", part=F.col("part"))
    z = np.column_stack([x, y, np.ones(len(y))])
    assert set(grams) == {0, 1, 2} and np.allclose(sum(grams.values()), z.T @ z)
    w, b = linear.solve_ridge(sum(grams.values()), 7.0)
    assert np.allclose(x.T @ (y - x @ w - b), 7.0 * w) and abs((y - x @ w - b).sum()) < 1e-6
    # KKT: the slope of the smooth part is -l1 sign(w), or at most l1 where w is zero.
    for l1, l2 in ((2.0, 0.0), (4.0, 1.5), (11.0, 0.0)):
        w, b = linear.solve_elastic(sum(grams.values()), l1, l2)
        slope = -x.T @ (y - x @ w - b) / len(y) + l2 * w
        assert np.allclose(slope[w != 0], -l1 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope[w == 0]) <= l1 + 1e-6).all()


def test_kernel_loss_is_optimal_and_depends_on_c_and_epsilon(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = np.sin(2 * x[:, 0]) * 10 + x[:, 1] + rng.normal(size=400) * 0.3
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], "x0 double, x1 double, y double").persist()
    got = {}
    for c, eps in ((1000.0, 0.1), (0.1, 0.1), (1000.0, 3.0)):
        m = models.fit_model(models.kernel_reg(64, c, eps, gamma=0.5), df, ["x0", "x1"], "y")
        got[c, eps] = np.array([r["p"] for r in m.transform(df, "p").orderBy("x0").select("p").collect()])
        if (c, eps) == (1000.0, 0.1):
            fine = m
    order = np.argsort(x[:, 0])
    assert np.abs(got[1000.0, 0.1] - y[order]).mean() < 1.0
    assert np.abs(got[0.1, 0.1] - got[1000.0, 0.1]).mean() > 0.05 and np.abs(got[1000.0, 3.0] - got[1000.0, 0.1]).mean() > 0.05
    # The smoothed objective does not fall in random directions.
    z = np.array([r["z"] for r in df.select(models._random_features(fine.spec, models._scaled(fine.scaler, fine.features)).alias("z")).collect()])
    terms = linear.tube_terms(0.1, models.kernel_width(fine.spec, y.std()))

    def objective(w, b):
        return terms(z @ w + b, y)[0].sum() + (w @ w) / 2000

    best = objective(fine.coefficients, fine.intercept)
    for _ in range(30):
        d = rng.normal(size=64) * 0.05
        assert objective(fine.coefficients + d, fine.intercept) > best - 5e-3 * abs(best)
