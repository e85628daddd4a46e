"""Forecasting regressors and churn classifiers.

Models are *pooled*: one fit over the rows of every series (features are
per-series lags and calendar columns), which is how a global forecaster
scales to many keys; with a single series it is the per-series model.

Penalties follow the least-squares forms the blueprint documents (``n`` rows,
intercept free):

* ridge ``||y - Xw||^2 + a||w||^2``
* lasso ``(1/2n)||y - Xw||^2 + a||w||_1``
* elastic net (a, mix): l1 = a*mix, l2 = a*(1-mix), ``+ (l2/2)||w||^2``
* logistic ``C``: ``sum_i weight_i logloss_i + (1/2C)||w||^2``
* kernel: ``||w||^2 / 2 + C sum_i max(0, |r_i| - eps)`` on random features

Linear fits come from one Gram table or a few Newton passes (``linear``), tree
ensembles from histograms of binned rows (``trees``). :func:`fit_parts` fits
any number of models on any unions of row parts (folds) together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators import linear, trees
from tidecast.session import stored

KEY = "series_key"
SEED = 42
ALL = -1
#: Row parts that fits can be unions of.
MAX_PARTS = 63


def match_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``match_columns``: the columns the model was trained on, in order."""
    return df.select(*cols)


# ---------------------------------------------------------------- scaling
@dataclass
class ColumnScaler:
    """``scale_features``: fitted per-column centre and scale.

    ``kind='robust'``: (x - median) / IQR with an IQR of 0 replaced by 1;
    ``kind='standard'``: (x - mean) / std_pop with 0 replaced by 1. The
    parameters are two numbers per column (bounded by the feature count),
    fitted on training rows only and applied as plain column arithmetic.
    """

    cols: list[str]
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], kind: str = "robust") -> "ColumnScaler":
        """Quantiles are exact (``functions.quantiles``), for any row count."""
        cols = list(cols)
        if kind == "robust":
            found = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
            pairs = [(q[1], None if q[0] is None else q[2] - q[0]) for q in found]
        elif kind == "standard":
            x = [F.col(c).cast("double") for c in cols]
            row = df.agg(*[f(v) for v in x for f in (F.avg, F.stddev_pop)]).first()
            pairs = [(row[2 * i], row[2 * i + 1]) for i in range(len(cols))]
        else:
            raise ValueError(kind)
        centre = {c: float(m or 0.0) for c, (m, _) in zip(cols, pairs)}
        scale = {c: float(s) if s not in (None, 0) and not math.isnan(s) else 1.0 for c, (_, s) in zip(cols, pairs)}
        return cls(cols, centre, scale)

    def columns(self) -> list[Column]:
        return [(F.col(c).cast("double") - self.centre[c]) / self.scale[c] for c in self.cols]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scaled values, in place or (with ``prefix``) as new columns."""
        return df.withColumns({prefix + c: (F.col(c).cast("double") - self.centre[c]) / self.scale[c] for c in self.cols})


# ---------------------------------------------------------------- specs
@dataclass
class ModelSpec:
    """A named model: a tree job, or a linear method with its parameters."""

    name: str
    method: str  # 'tree' | 'ridge' | 'elastic' | 'logistic' | 'kernel'
    scaler: str | None = None  # 'robust' | 'standard' | None
    kind: str = "reg"  # 'reg' | 'clf'
    tree: trees.Job | None = None
    params: dict = field(default_factory=dict)


def ridge(alpha: float = 1.0, scaler: str | None = "robust") -> ModelSpec:
    """``scaler=None`` is the meta learner of a stack: base predictions share
    one unit already."""
    return ModelSpec("ridge", "ridge", scaler, params={"alpha": alpha})


def lasso(alpha: float = 100.0, max_iter: int = 5000) -> ModelSpec:
    return ModelSpec("lasso", "elastic", "robust", params={"l1": alpha, "l2": 0.0, "max_iter": max_iter})


def elastic_net(alpha: float = 100.0, mix: float = 0.5) -> ModelSpec:
    return ModelSpec("elastic_net", "elastic", "robust", params={"l1": alpha * mix, "l2": alpha * (1 - mix), "max_iter": 5000})


def random_forest_reg(trees_: int = 200, depth: int = 10, min_leaf: int = 2) -> ModelSpec:
    return ModelSpec("random_forest", "tree", tree=trees.Job("forest", trees_, depth, min_rows=min_leaf, seed=SEED))


def gbt_reg(trees_: int = 200, depth: int = 5, lr: float = 0.05, subsample: float = 0.8) -> ModelSpec:
    return ModelSpec("gradient_boosting", "tree", tree=trees.Job("boost", trees_, depth, rate=lr, rows=subsample, seed=SEED))


def boosted_trees_reg(trees_: int = 500, depth: int = 6, lr: float = 0.05, row: float = 0.8, col: float = 0.8, min_child: int = 3) -> ModelSpec:
    """The boosted-tree forecaster: row and column samples per tree, a smallest
    leaf, and a penalty of one on leaf values."""
    return ModelSpec("boosted_trees", "tree", tree=trees.Job("boost", trees_, depth, rate=lr, rows=row, cols=col, min_rows=min_child, lam=1.0, seed=SEED))


def kernel_reg(features: int = 256, c: float = 1000.0, epsilon: float = 0.1, gamma: float | None = None, seed: int = SEED) -> ModelSpec:
    """``kernel_reg``: support-vector regression with an RBF kernel on seeded
    random Fourier features: the epsilon-insensitive loss, its corner rounded
    over ``smooth``, weighted ``c`` against the squared norm, by Newton."""
    return ModelSpec("kernel", "kernel", "standard", params={"features": features, "c": c, "epsilon": epsilon, "gamma": gamma, "seed": seed})


def logistic(c: float = 1.0, balanced: bool = True, max_iter: int = 100, scaler: str | None = "standard") -> ModelSpec:
    return ModelSpec("logistic", "logistic", scaler, "clf", params={"c": c, "balanced": balanced, "max_iter": max_iter})


def random_forest_clf(trees_: int = 200, depth: int = 10, balanced: bool = True) -> ModelSpec:
    return ModelSpec("random_forest", "tree", None, "clf", trees.Job("forest", trees_, depth, loss="logistic", weighted=balanced, seed=SEED))


def gbt_clf(trees_: int = 200, depth: int = 5, lr: float = 0.05) -> ModelSpec:
    return ModelSpec("gradient_boosting", "tree", None, "clf", trees.Job("boost", trees_, depth, rate=lr, loss="logistic", seed=SEED))


def boosted_trees_clf(trees_: int = 200, depth: int = 5, lr: float = 0.05, pos_weight: float = 3.0) -> ModelSpec:
    """Boosted trees with positives weighted ``pos_weight``, whatever class
    weights the training rows carry for other models."""
    return ModelSpec("boosted_trees", "tree", None, "clf", trees.Job("boost", trees_, depth, rate=lr, lam=1.0, loss="logistic", pos_weight=pos_weight, seed=SEED))


# ---------------------------------------------------------------- fitting
@dataclass
class FittedModel:
    """A fitted spec; linear ones have coefficients of the (scaled) columns."""

    spec: ModelSpec
    features: list[str]
    label: str
    scaler: ColumnScaler | None = None
    coefficients: np.ndarray | None = None
    intercept: float = 0.0
    trees: trees.Fitted | None = None

    def transform(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        """Adds the prediction (or positive-class probability) as ``out``;
        the input columns are left unchanged."""
        if self.trees is not None:
            return self.trees.transform(df, out)
        if self.spec.method == "kernel":
            z = _random_features(self.spec, _scaled(self.scaler, self.features), self.coefficients)
            return df.withColumn(out, z + self.intercept)
        # A sum by pairs: 61 terms in a row would nest 61 levels deep.
        terms = [c * float(w) for c, w in zip(_scaled(self.scaler, self.features), self.coefficients)]
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        margin = (terms[0] if terms else F.lit(0.0)) + float(self.intercept)
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-margin)) if self.spec.kind == "clf" else margin)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """The model as a function of a matrix of its features."""
        if self.trees is not None:
            state = self.trees.state()
            return lambda x: trees.predicted(state, x)
        w, b, clf = self.coefficients, self.intercept, self.spec.kind == "clf"
        centre, scale = ([s[c] for c in self.features] if (s := getattr(self.scaler, n, None)) else d for n, d in (("centre", 0.0), ("scale", 1.0)))
        draw = _random_draw(self.spec, len(self.features)) if self.spec.method == "kernel" else None

        def score(x: np.ndarray) -> np.ndarray:
            z = (x - np.asarray(centre)) / np.asarray(scale)
            margin = (draw(np.where(np.isnan(z), 0.0, z)) if draw else z) @ w + b
            return 1.0 / (1.0 + np.exp(-margin)) if clf else margin

        return score

    def importance(self) -> list[tuple[str, float]]:
        """Trees: gains that sum to one; linear: absolute coefficients."""
        if self.trees is not None:
            return self.trees.importance()
        names = [f"rff_{i}" for i in range(len(self.coefficients))] if self.spec.method == "kernel" else self.features
        return list(zip(names, np.abs(self.coefficients).tolist()))


def _scaled(scaler: ColumnScaler | None, features: Sequence[str]) -> list[Column]:
    return scaler.columns() if scaler else [F.col(c).cast("double") for c in features]


def _random_features(spec: ModelSpec, columns: Sequence[Column], beta: np.ndarray | None = None) -> Column:
    """Random Fourier features ``cos(X W' + b) * sqrt(2/d)`` as an array or,
    with ``beta``, their product with it: a dense matrix product per Arrow
    batch; the seeded ``W`` and ``b`` are a few kB and travel along."""
    draw = _random_draw(spec, len(columns))

    @F.pandas_udf("array<double>" if beta is None else "double")
    def features(x: pd.DataFrame) -> pd.Series:
        z = draw(x.to_numpy(dtype=float, na_value=0.0))
        return pd.Series(list(z) if beta is None else z @ beta)

    return features(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


def _random_draw(spec: ModelSpec, k: int) -> Callable[[np.ndarray], np.ndarray]:
    d, gamma = spec.params["features"], spec.params["gamma"]
    gamma = gamma if gamma is not None else 1.0 / max(k, 1)
    rng = np.random.default_rng(spec.params["seed"])
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(d, k))
    b = rng.uniform(0, 2 * math.pi, size=d)
    return lambda x: np.cos(x @ w.T + b) * math.sqrt(2.0 / d)


def _row_ids(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Columns that name a row for bagging: draws are a hash of them."""
    for ids in ((KEY, "date"), ("customer_no",)):
        if all(c in df.columns for c in ids):
            return list(ids)
    return list(features)


def fit_parts(
    specs: Sequence[ModelSpec], df: DataFrame, features: Sequence[str], label: str, unions: Sequence[Sequence[int]], part: str | None = None,
    wanted: Sequence[Sequence[str]] | None = None,
) -> list[list[FittedModel]]:
    """Every spec fitted on every union of row parts (0 to 62, column
    ``part``): ``[union][spec]``. All tree models grow in the same passes over
    one set of binned rows; Gram tables are added up by part once per scaler.
    Scalers and bin cuts are those of all rows of ``df``. ``wanted`` names the
    specs of each union, where not all are: the others' places hold None."""
    features = list(features)
    fits = [{i for i, s in enumerate(specs) if wanted is None or s.name in wanted[u]} for u in range(len(unions))]
    weight = F.col("weight") if "weight" in df.columns else None
    at = F.col(part) if part else None
    out: list[list[FittedModel | None]] = [[None] * len(specs) for _ in unions]
    scalers = {k: ColumnScaler.fit(df, features, k) for k in dict.fromkeys(s.scaler for s in specs) if k}
    grams: dict[str | None, dict[int, np.ndarray]] = {}
    jobs = [(u, i) for u in range(len(unions)) for i, s in enumerate(specs) if s.method == "tree" and i in fits[u]]
    if jobs:
        data = trees.bin_rows(df, features, label, _row_ids(df, features), weight, at)
        fitted = trees.fit(data, [trees.on_parts(specs[i].tree, unions[u]) if part else specs[i].tree for u, i in jobs])
        for (u, i), f in zip(jobs, fitted):
            out[u][i] = FittedModel(specs[i], features, label, trees=f)
    for i, s in enumerate(specs):
        if s.method == "tree":
            continue
        scaler = scalers.get(s.scaler)
        columns = _scaled(scaler, features)
        of = [u for u in range(len(unions)) if i in fits[u]]
        mine = [unions[u] for u in of]
        if s.method in ("ridge", "elastic"):
            if s.scaler not in grams:
                grams[s.scaler] = linear.gram(df, columns, label, part=at)
            found = []
            for parts in mine:
                table = sum(g for p, g in grams[s.scaler].items() if not part or p in parts)
                if s.method == "ridge":
                    found.append(linear.solve_ridge(table, s.params["alpha"]))
                else:
                    found.append(linear.solve_elastic(table, s.params["l1"], s.params["l2"], s.params["max_iter"]))
        elif s.method == "logistic":
            balance = weight if s.params["balanced"] else None
            found = linear.newton_parts(df, columns, label, [linear.logistic_terms], 1.0 / s.params["c"], mine, balance, at, s.params["max_iter"])
        else:
            found = _fit_kernel(s, df, columns, label, mine, at)
        for u, (w, b, *_) in zip(of, found):
            out[u][i] = FittedModel(s, features, label, scaler, w, b)
    return out


#: The kernel model's loss has its corner rounded over this many epsilons or
#: this share of the label's spread, whichever is more; Newton passes for each
#: width on the way there.
KERNEL_SMOOTH, KERNEL_SHARE, KERNEL_PASSES = 2.0, 0.01, 12


def kernel_width(spec: ModelSpec, spread: float) -> float:
    return max(KERNEL_SMOOTH * spec.params["epsilon"], KERNEL_SHARE * spread)


def _fit_kernel(spec: ModelSpec, df: DataFrame, columns: list[Column], label: str, unions, part: Column | None) -> list[tuple]:
    """Newton from wide to narrow corners: each starts where the last ended."""
    c, eps, d = spec.params["c"], spec.params["epsilon"], spec.params["features"]
    spread = df.agg(F.stddev_pop(F.col(label).cast("double"))).first()[0] or 1.0
    last = kernel_width(spec, float(spread))
    widths = [max(float(spread), last)]
    while widths[-1] > last:
        widths.append(max(widths[-1] / 8, last))
    terms = [linear.tube_terms(eps, w) for w in widths]
    draw = _random_draw(spec, len(columns))
    return linear.newton_parts(df, columns, label, terms, 1.0 / c, unions, None, part, KERNEL_PASSES, 1e-6, draw, d)


def fit_model(spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str = "sales") -> FittedModel:
    """Fit one spec on all rows of ``train``."""
    return fit_parts([spec], train, features, label, [()])[0][0]


def fit_models(specs: Sequence[ModelSpec], train: DataFrame, features: Sequence[str], label: str = "sales") -> list[FittedModel]:
    """Fit several specs on the same rows, tree models together."""
    return fit_parts(specs, train, features, label, [()])[0]


def predict_long(fitted: FittedModel, df: DataFrame, label: str = "sales", floor: bool = True) -> DataFrame:
    """Predictions as the long table ``(series_key, model, date, actual,
    yhat, lower, upper)``; regressors are floored at 0."""
    p = fitted.transform(df)
    yhat = F.greatest(F.col("yhat"), F.lit(0.0)) if floor else F.col("yhat")
    return p.select(
        KEY, F.lit(fitted.spec.name).alias("model"), "date", F.col(label).cast("double").alias("actual"), yhat.alias("yhat"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )


def feature_importance(fitted: FittedModel, spark=None) -> DataFrame:
    """``feature_importance``: one row per input feature."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    # One row a feature.
    return spark.createDataFrame(
        [(fitted.spec.name, f, v) for f, v in fitted.importance()], "model string, feature string, importance double"
    )


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """``top_features``: importance descending, first k (a top-k)."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


# ---------------------------------------------------------------- ensembles of models
def voting(long: DataFrame, members: Sequence[str] = ("ridge", "random_forest", "gradient_boosting"), name: str = "voting") -> DataFrame:
    """``voting_reg``: mean of the members' predictions per series and date."""
    return (
        long.where(F.col("model").isin(*members))
        .groupBy(KEY, "date")
        .agg(F.first("actual").alias("actual"), F.avg("yhat").alias("yhat"))
        .select(KEY, F.lit(name).alias("model"), "date", "actual", "yhat",
                F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    )


def stacking_fit(
    bases: Sequence[ModelSpec],
    meta: ModelSpec,
    train: DataFrame,
    features: Sequence[str],
    label: str = "sales",
    folds: int = 3,
    order: str = "date",
    full: Sequence[FittedModel] | None = None,
) -> tuple[list[FittedModel], FittedModel]:
    """``stacking_reg`` / ``stacking_clf``: out-of-fold base predictions
    from ``folds`` blocks train the meta model; the bases are also fitted on
    all rows. Fold and full fits are unions of the same parts, so all of them
    grow in the same passes. ``full`` are the bases where they have been fitted
    on all rows of ``train`` before.

    Blocks are contiguous in ``order`` within each series (``ntile`` over a
    window partitioned by series); without a series column they are seeded
    hashes of ``order``.
    """
    tr = stored(with_stack_fold(train, folds, order), "stack")
    unions = [[p for p in range(folds) if p != k] for k in range(folds)]
    fits = fit_parts(bases, tr, features, label, unions if full else [*unions, list(range(folds))], "_fold")
    return list(full or fits[-1]), stack_meta(fits[:folds], tr, bases, meta, label)


def stack_meta(by_fold: Sequence[Sequence[FittedModel]], tr: DataFrame, bases: Sequence[ModelSpec], meta: ModelSpec, label: str) -> FittedModel:
    """The meta model of a stack, from its bases' out-of-fold predictions."""
    names = [f"_base_{b.name}" for b in bases]
    # A meta model may take several passes over the predictions.
    kept = [c for c in (KEY, "date", "customer_no", "weight", label) if c in tr.columns]
    oof = stored(out_of_fold(by_fold, tr, bases).select(*kept, *names), "out-of-fold")
    return fit_model(meta, oof, names, label)


def with_stack_fold(train: DataFrame, folds: int, order: str) -> DataFrame:
    from pyspark.sql import Window

    if KEY in train.columns:
        return train.withColumn("_fold", F.ntile(folds).over(Window.partitionBy(KEY).orderBy(order)) - 1)
    # Rows without a series (customers): no global sort puts every row in one task.
    h = F.xxhash64(F.col(order).cast("string"), F.lit(SEED))
    return train.withColumn("_fold", F.pmod(h, F.lit(folds)).cast("int"))


def out_of_fold(by_fold: Sequence[Sequence[FittedModel]], tr: DataFrame, bases: Sequence[ModelSpec]) -> DataFrame:
    """Rows of each fold with the predictions of the models that did not see it."""
    oof = None
    for k, fitted in enumerate(by_fold):
        block = tr.where(F.col("_fold") == k)
        for m, b in zip(fitted, bases):
            block = m.transform(block, out=f"_base_{b.name}")
        oof = block if oof is None else oof.unionByName(block)
    return oof


def stacking_predict(bases: Sequence[FittedModel], meta: FittedModel, df: DataFrame, out: str = "yhat") -> DataFrame:
    x = df
    for b in bases:
        x = b.transform(x, out=f"_base_{b.spec.name}")
    return meta.transform(x, out=out)


@dataclass
class FittedStack:
    """A stack as one model."""

    bases: list[FittedModel]
    meta: FittedModel
    spec: ModelSpec

    def transform(self, df: DataFrame, out: str = "yhat", known: dict[str, str] | None = None) -> DataFrame:
        """``known``: columns of ``df`` that hold a base's predictions."""
        got, known = df, known or {}
        for name, column in known.items():
            got = got.withColumn(f"_base_{name}", F.col(column))
        for b in self.bases:
            if b.spec.name not in known:
                got = b.transform(got, out=f"_base_{b.spec.name}")
        return self.meta.transform(got, out=out).drop(*[f"_base_{b.spec.name}" for b in self.bases])

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        bases, meta = [b.scorer() for b in self.bases], self.meta.scorer()
        return lambda x: meta(np.column_stack([b(x) for b in bases]))


@dataclass
class FittedVote:
    """The mean of fitted regressors as one model."""

    members: list[FittedModel]
    spec: ModelSpec

    def transform(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        names = [f"_vote_{i}" for i in range(len(self.members))]
        for n, m in zip(names, self.members):
            df = m.transform(df, n)
        return df.withColumn(out, sum(F.col(n) for n in names) / len(names)).drop(*names)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        members = [m.scorer() for m in self.members]
        return lambda x: sum(m(x) for m in members) / len(members)


# ---------------------------------------------------------------- cross-validation
def cross_validate(
    specs: Sequence[ModelSpec], df: DataFrame, features: Sequence[str], label: str, part: str, folds: Sequence[tuple[Sequence[int], int]],
    metric: str = "reg", vote: Sequence[str] = (), stack: tuple[Sequence[str], ModelSpec] | None = None,
    fitted: Sequence[Sequence[FittedModel]] | None = None,
) -> DataFrame:
    """``cross_validate``: fit every spec on the train parts of every fold,
    score its test part; per-(model, fold) metrics, summed up by
    :func:`cv_summary` (mean and population std).

    ``df`` has each row once, with its ``part``; ``folds`` are (train parts,
    test part), see ``time_series_parts``. ``vote`` names the members of a
    mean model. ``stack`` names base models and gives the meta model of a
    stack whose out-of-fold rows are, in each fold, those of its train parts
    predicted without them. ``fitted`` are the specs where they have been fitted
    on each fold's train parts before.
    """
    from tidecast.operators.metrics import auc_roc, class_metrics, forecast_metrics, r2

    unions = [tuple(sorted(train)) for train, _ in folds]
    by_union = dict(zip(unions, fitted or fit_parts(specs, df, features, label, unions, part)))
    names = [s.name for s in specs]
    inner: dict[tuple, list] = {}
    if stack:
        base_specs = [specs[names.index(n)] for n in stack[0]]
        left_out = sorted({tuple(p for p in u if p != q) for u in unions for q in u if len(u) > 1})
        inner = dict(zip(left_out, fit_parts(base_specs, df, features, label, left_out, part)))
    predicted = []
    for k, (train, test) in enumerate(folds):
        union = tuple(sorted(train))
        models: dict[str, object] = dict(zip(names, by_union[union]))
        if vote:
            models["voting"] = FittedVote([models[n] for n in vote], ModelSpec("voting", "vote"))
        if stack and len(union) > 1:
            base = [names.index(n) for n in stack[0]]
            oof = None
            for q in union:
                block = df.where(F.col(part) == q)
                for m, i in zip(inner[tuple(p for p in union if p != q)], base):
                    block = m.transform(block, f"_base_{names[i]}")
                oof = block if oof is None else oof.unionByName(block)
            meta = fit_model(stack[1], stored(oof, "out-of-fold"), [f"_base_{names[i]}" for i in base], label)
            models["stacking"] = FittedStack([by_union[union][i] for i in base], meta, ModelSpec("stacking", "stack"))
        predicted.append(_predictions(models, df.where(F.col(part) == test), features, label, k + 1))
    p = predicted[0]
    for more in predicted[1:]:
        p = p.unionByName(more)
    # All predictions are scored in one aggregate by model and fold.
    by = ("model", "fold")
    p = stored(p, "predicted")
    if metric == "reg":
        p = p.withColumnRenamed("p", "yhat")
        return forecast_metrics(p, by).join(r2(p, by), list(by)).select(*by, "mae", "rmse", "r2")
    p = p.select(*by, F.col("p").alias("probability"), F.col("actual").cast("int").alias("label"))
    return auc_roc(p, by).join(class_metrics(p, by), list(by)).select(*by, "auc", "f1", "precision", "recall")


def _predictions(models: dict[str, object], rows: DataFrame, features: Sequence[str], label: str, fold: int) -> DataFrame:
    """``(fold, actual, model, p)`` of every row and model. All models score a
    batch as one matrix: a column each, stacked over 61 features, cost the
    driver more time to plan than the tasks to score."""
    scorers = {n: m.scorer() for n, m in models.items()}
    x = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("actual"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[: len(features)]
            m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            # Missing features leave a linear model's prediction missing, not NaN.
            missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
            for name, scorer in scorers.items():
                p = np.asarray(scorer(m), float)
                arrays = [pa.array(np.full(len(p), fold), pa.int32()), b.column("actual"), pa.array([name] * len(p)), pa.array(p, mask=missing & np.isnan(p))]
                yield pa.RecordBatch.from_arrays(arrays, names=["fold", "actual", "model", "p"])

    return x.mapInArrow(score, "fold int, actual double, model string, p double")


def cv_summary(per_fold: DataFrame, cols: Sequence[str] = ("mae", "rmse", "r2")) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_std")]
    return per_fold.groupBy("model").agg(*aggs)
