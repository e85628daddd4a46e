"""Exact quantiles of many columns at once, by digits of the sorted order.

A double's bits, with the sign handled, order like the number itself. Each
pass counts the rows per next digit under the prefixes that hold a wanted
rank, so after the last digit the value at every rank is known: no sort, no
value list in one task, results that do not depend on the partitioning. A pass
sends the driver at most ranks x 2^BITS counts a column, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 11
_SIGN = np.uint64(1 << 63)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 as 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _SIGN, keys & ~_SIGN, ~keys).astype(np.uint64).view(np.float64)


def _counts(df: DataFrame, shift: int, width: int, prefixes: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
    """Per column, of each wanted prefix, rows per value of the next digit."""
    top = shift + width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[int, int]] = [{} for _ in prefixes]
        for batch in batches:
            for at, (column, wanted) in enumerate(zip(batch.columns, prefixes)):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64)
                keys = _ordered(x[~np.isnan(x)])
                if top < 64:
                    keys = keys[np.isin(keys >> np.uint64(top), wanted)]
                digits, n = np.unique(keys >> np.uint64(shift), return_counts=True)
                for k, c in zip(digits.tolist(), n.tolist()):
                    sums[at][k] = sums[at].get(k, 0) + c
        rows = [(i, k - (1 << 63), c) for i, s in enumerate(sums) for k, c in s.items()]
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "key", "n"])

    out: list[dict[int, np.ndarray]] = [{} for _ in prefixes]
    for r in df.mapInArrow(count, "at int, key long, n long").groupBy("at", "key").agg(F.sum("n").alias("n")).collect():
        key = r["key"] + (1 << 63)
        cell = out[r["at"]].setdefault(key >> width, np.zeros(1 << width, np.int64))
        cell[key & ((1 << width) - 1)] += r["n"]
    return out


def values_at_ranks(df: DataFrame, cols: Sequence[str], ranks, bits: int = 64) -> tuple[list[np.ndarray], list[int]]:
    """The values at 0-based ``ranks`` of each column without nulls and NaNs,
    and how many values a column has.
    ``ranks`` is a function from a column's count to its wanted ranks. With
    fewer than 64 ``bits`` the lower end of the values that share them."""
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    shift, want = 64, None
    prefixes = [np.zeros(1, np.uint64) for _ in cols]
    while shift > 64 - bits:
        width = min(BITS, shift - (64 - bits))
        shift -= width
        cells = _counts(x, shift, width, prefixes)
        if want is None:
            totals = [int(sum(c.sum() for c in cell.values())) for cell in cells]
            want = [np.asarray(ranks(n), np.int64) if n else np.zeros(0, np.int64) for n in totals]
            at = [np.zeros(len(w), np.uint64) for w in want]
            left = [w.copy() for w in want]
        for i, cell in enumerate(cells):
            for j in range(len(want[i])):
                run = np.cumsum(cell[int(at[i][j])])
                digit = int(np.searchsorted(run, left[i][j], "right"))
                left[i][j] -= run[digit - 1] if digit else 0
                at[i][j] = np.uint64((int(at[i][j]) << width) | digit)
            prefixes[i] = np.unique(at[i])
    return [_doubles(np.array([int(k) << shift for k in a], np.uint64)) for a in at], totals


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Interpolated quantiles (position p * (n - 1)) of each column; None for
    a column without values."""

    def ranks(n: int) -> list[int]:
        place = [p * (n - 1) for p in probs]
        return [r for q in place for r in (int(np.floor(q)), int(np.ceil(q)))]

    out = []
    for v, n in zip(*values_at_ranks(df, cols, ranks)):
        part = [p * (n - 1) - np.floor(p * (n - 1)) for p in probs]
        out.append([float(v[2 * j] + (v[2 * j + 1] - v[2 * j]) * part[j]) for j in range(len(probs))] if n else [None] * len(probs))
    return out
