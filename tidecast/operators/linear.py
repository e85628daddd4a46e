"""Linear models from mergeable sums.

``gram`` adds up, per part of the rows, the products of all (scaled) columns,
the label and a one: a small table that merges by addition, so any union of
parts (all folds but one, all rows) is a sum of its tables. Ridge is solved in
closed form on it, lasso and elastic net by coordinate descent on it: one pass
over the rows for any number of penalties and folds.

``newton`` fits losses that are no square (logistic; a smoothed
epsilon-insensitive loss): each step is one pass that adds up gradient and
Hessian, a few steps in all, halved where the objective would rise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a packed block.
BLOCK_ROWS = 4096
#: Rows times columns that are worth a task of their own in a Newton pass.
_TASK_CELLS = 1 << 19
_BLOCK = "part int, n int, x binary, y binary, w binary"


def _blocks(df: DataFrame, columns: Sequence[Column], label: str, weight: Column | None, part: Column | None) -> DataFrame:
    """Rows as blocks of doubles, each of one part: passes read bytes."""
    k = len(columns)
    rows = df.select(
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        F.col(label).cast("double").alias("y"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        (part if part is not None else F.lit(0)).cast("int").alias("part"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:-1]]
            x = np.nan_to_num(np.column_stack(flat[:k]) if k else np.zeros((batch.num_rows, 0)), nan=0.0)
            parts = batch.columns[-1].to_numpy(zero_copy_only=False)
            for p in np.unique(parts).tolist():
                at = np.flatnonzero(parts == p)
                for i in range(0, len(at), BLOCK_ROWS):
                    r = at[i : i + BLOCK_ROWS]
                    data = [pa.array([v[r].tobytes()], pa.binary()) for v in (x, flat[k], flat[k + 1])]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(r)], pa.int32()), *data], names=["part", "n", "x", "y", "w"])

    return rows.mapInArrow(pack, _BLOCK)


def _added(blocks: DataFrame, k: int, add: Callable[..., None], zeros: Callable[[], np.ndarray], keys: Callable[[int], Sequence[int]]) -> dict[int, np.ndarray]:
    """Sums of what ``add(key, sums, x, y, w)`` adds up for each of ``keys`` of
    a block's part, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n, *data in zip(*[c.to_pylist() for c in batch.columns]):
                x, y, w = (np.frombuffer(d, float) for d in data)
                x = x.reshape(n, k)
                for key in keys(part):
                    add(key, sums.setdefault(key, zeros()), x, y, w)
        for key, s in sums.items():
            flat = s.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), key), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["key", "i", "v"])

    out: dict[int, np.ndarray] = {}
    merged = blocks.mapInArrow(run, "key int, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v")).toArrow()  # a row a sum
    keys_, at, values = (merged.column(i).to_numpy() for i in range(3))
    for key in np.unique(keys_).tolist():
        m = keys_ == key
        out.setdefault(key, zeros()).ravel()[at[m]] = values[m]
    return out


# ---------------------------------------------------------------- squares
def gram(df: DataFrame, columns: Sequence[Column], label: str, weight: Column | None = None, part: Column | None = None) -> dict[int, np.ndarray]:
    """By part the weighted products of (columns, label, 1) with themselves."""
    k = len(columns)

    def add(_: int, sums: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        z = np.column_stack([x, y, np.ones(len(y))])
        sums += (z * w[:, None]).T @ z

    return _added(_blocks(df, columns, label, weight, part), k, add, lambda: np.zeros((k + 2, k + 2)), lambda p: [p])


def centred(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """X'X and X'y of centred columns, rows, column means and label mean."""
    n, mean = table[-1, -1], table[-1, :-1] / table[-1, -1]
    s = table[:-1, :-1] - n * np.outer(mean, mean)
    return s[:-1, :-1], s[:-1, -1], n, mean[:-1], mean[-1]


def solve_ridge(table: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """min ||y - Xw - b||^2 + alpha ||w||^2."""
    xx, xy, _, mx, my = centred(table)
    w = np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0]
    return w, float(my - mx @ w)


def solve_elastic(table: np.ndarray, l1: float, l2: float = 0.0, max_iter: int = 5000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """min (1/2n) ||y - Xw - b||^2 + l1 |w|_1 + (l2/2) ||w||^2 by coordinate
    descent; stops when no coefficient moves by more than ``tol`` of the
    largest effect."""
    xx, xy, n, mx, my = centred(table)
    a, b = xx / n, xy / n
    pull = np.zeros(len(b))  # a @ w
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    # Plain floats: thousands of rounds of single numbers.
    ws, bs, diag, scales, across = [0.0] * len(b), b.tolist(), np.diag(a).tolist(), scale.tolist(), np.ascontiguousarray(a.T)
    live = [j for j, s in enumerate(scales) if s != 0]
    for _ in range(max_iter):
        moved = 0.0
        for j in live:
            rho = bs[j] - pull.item(j) + diag[j] * ws[j]
            over = abs(rho) - l1
            new = math.copysign(over, rho) / (diag[j] + l2) if over > 0 else 0.0
            if new != ws[j]:
                pull += across[j] * (new - ws[j])
                moved = max(moved, abs(new - ws[j]) * scales[j])
                ws[j] = new
        if moved <= tol * max(1.0, np.abs(np.array(ws) * scale).max()):
            break
    w = np.array(ws)
    return w, float(my - mx @ w)


# ---------------------------------------------------------------- Newton
Terms = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def logistic_terms(margin: np.ndarray, y: np.ndarray):
    """Loss, its first and second derivative in the margin, by row."""
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
    return np.logaddexp(0.0, margin) - y * margin, p - y, p * (1.0 - p)


def tube_terms(epsilon: float, smooth: float) -> Terms:
    """The epsilon-insensitive loss max(0, |r| - epsilon), its corner rounded
    over ``smooth``: quadratic there, linear beyond."""

    def terms(margin: np.ndarray, y: np.ndarray):
        r = margin - y
        out = np.maximum(np.abs(r) - epsilon, 0.0)
        inner = out < smooth
        loss = np.where(inner, out * out / (2 * smooth), out - smooth / 2)
        return loss, np.sign(r) * np.minimum(out / smooth, 1.0), np.where((out > 0) & inner, 1.0 / smooth, 0.0)

    return terms


@dataclass
class _Descent:
    """Where the Newton steps of one model are."""

    beta: np.ndarray
    state: tuple | None = None  # value, slope, curve, rows at beta
    step: np.ndarray | None = None
    size: float = 1.0
    passes: int = 0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.beta if self.step is None else self.beta - self.size * self.step

    def take(self, got: tuple, tol: float, max_iter: int) -> None:
        self.passes += 1
        if self.state is not None:
            value, slope = self.state[:2]
            if got[0] > value - 1e-4 * self.size * (slope @ self.step):
                self.size /= 2
                self.done = self.size < 1e-6 or self.passes >= max_iter
                return
            self.beta = self.trial()
            self.done = value - got[0] <= 1e-13 * abs(value)
        self.state, self.size = got, 1.0
        _, slope, curve, rows = got
        # A whisper of damping keeps the step finite where no row has curvature.
        damp = 1e-12 * max(np.trace(curve) / len(slope), 1e-12) * np.eye(len(slope))
        self.step = np.linalg.lstsq(curve + damp, slope, rcond=None)[0]
        self.done |= self.passes >= max_iter or np.abs(slope).max() <= tol * max(rows, 1.0)


def newton_parts(
    df: DataFrame, columns: Sequence[Column], label: str, terms: Sequence[Terms], penalty: float, unions: Sequence[Sequence[int]], weight: Column | None = None,
    part: Column | None = None, max_iter: int = 100, tol: float = 1e-9, expand: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None,
) -> list[tuple[np.ndarray, float, int]]:
    """min sum_i w_i loss(z_i b + b0, y_i) + (penalty/2) ||b||^2, b0 free, on
    every union of parts (an empty one: all rows); coefficients, intercept and
    passes of each. All models take their steps in the same passes. ``expand``
    makes ``z`` (``width`` columns) from the columns. Of several ``terms`` each
    starts where the one before ended."""
    k = len(columns)
    d = width or k
    kept = _blocks(df, columns, label, weight, part).persist()
    # Few rows in few tasks: a pass costs what its tasks cost to start.
    cells = (kept.agg(F.sum("n")).first()[0] or 0) * (d + 1)
    blocks = kept.coalesce(max(1, -(-cells // _TASK_CELLS)))
    ridge = np.append(np.full(d, penalty), 0.0)
    runs = [_Descent(np.zeros(d + 1)) for _ in unions]
    for loss_terms in terms:
        runs = [_Descent(r.beta, passes=r.passes) for r in runs]
        limit = [r.passes + max_iter for r in runs]
        while any(not r.done for r in runs):
            trials = {u: r.trial() for u, r in enumerate(runs) if not r.done}

            # Every union that holds a block's part reads the same columns of it.
            latest: list = [None, None]

            def add(u: int, s: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, trials=trials, latest=latest) -> None:
                if latest[0] is not x:
                    latest[:] = x, np.column_stack([expand(x) if expand else x, np.ones(len(y))])
                z = latest[1]
                loss, first, second = loss_terms(z @ trials[u], y)
                # Rows without curvature (outside a tube's corner) add nothing.
                curve = w * second
                bent = np.flatnonzero(curve)
                zb, curve = (z[bent], curve[bent]) if len(bent) < len(y) else (z, curve)
                s[:-2] += (zb * curve[:, None]).T @ zb
                s[-2] += z.T @ (w * first)
                s[-1, 0] += (w * loss).sum()
                s[-1, 1] += w.sum()

            held = {u: set(unions[u]) for u in trials}
            sums = _added(blocks, k, add, lambda: np.zeros((d + 3, d + 1)), lambda p, held=held: [u for u, ps in held.items() if not ps or p in ps])
            for u, b in trials.items():
                got = sums.get(u, np.zeros((d + 3, d + 1)))
                runs[u].take((got[-1, 0] + (ridge * b * b).sum() / 2, got[-2] + ridge * b, got[:-2] + np.diag(ridge), got[-1, 1]), tol, limit[u])
    kept.unpersist()
    return [(r.beta[:-1], float(r.beta[-1]), r.passes) for r in runs]


def newton(df: DataFrame, columns: Sequence[Column], label: str, terms: Terms, penalty: float, **options) -> tuple[np.ndarray, float, int]:
    """``newton_parts`` for one loss on all rows."""
    return newton_parts(df, columns, label, [terms], penalty, [()], **options)[0]
