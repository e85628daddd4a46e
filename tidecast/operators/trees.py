"""Forests and boosted trees from histograms, many models in one pass.

Rows are binned once: ``bin_rows`` cuts every feature at exact quantiles and
packs rows into blocks (a byte per feature and row, label, weight, part, row
key) written to the shared folder. A :class:`Job` is one model: its losses,
sizes and the parts of the rows it is trained on, so the models of all folds
and the full ones read the same blocks and grow in the same passes. Bagging
and row sampling are drawn from a hash of row key, seed and tree: the same in
any partitioning.

A level of all growing trees is one grouped sum of gradients, Hessians and
counts by (tree node, feature, bin), kept for the smaller child only (its
sibling is the parent less that); the best split of each node is searched
where its sums lie, and the driver gets one row a node. When all rows fit
``local_bytes`` the same sums need no shuffle: blocks are broadcast (their
size is known, not guessed) and a task grows whole trees, each boosted model
in one task, a forest's trees spread over tasks; there the bins of two or three
columns share a code (:class:`Codes`), so a pass over the rows adds up several
columns at once, chunk by chunk. Both ways give the same
trees, bit for bit: gradients and Hessians are whole multiples of fixed units,
so their sums are exact in any order (for fewer than 2^31 rows).

Leaves are second-order, -G / (H + lam). With squared loss that is the mean
residual, a forest's leaf is the weighted mean of the label, for 0/1 labels
the share of ones (and the split gain is Gini's).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.quantiles import values_at_ranks
from tidecast.session import scratch_path

BINS = 64
#: Rows of a block.
BLOCK_ROWS = 1 << 14
#: Bytes of binned rows up to which they are broadcast: a worker takes about
#: twice as much of memory.
LOCAL_BYTES = 256 << 20
#: Bits of a code of several columns.
CODE_BITS = 12
#: Rows whose sums are added up at a time: what a core's cache holds.
CHUNK_ROWS = 1 << 15
#: Bytes of a task's sums in one distributed pass; more trees take more passes.
PASS_BYTES = 128 << 20
#: Boosting rounds after which distributed margins are written anew.
REFRESH = 20
#: Gradients and Hessians are whole multiples of a 2^20th of their unit.
_UNIT = float(1 << 20)
#: Cells (slot, column, bin) whose splits are searched at once.
_SEARCH_CELLS = 1 << 15

_BLOCK = "n int, bins binary, y binary, w binary, part binary, key binary"


@dataclass(frozen=True)
class Job:
    """One model. ``parts`` is a bit mask of the row parts it is trained on."""

    kind: str  # 'forest' or 'boost'
    trees: int
    depth: int
    rate: float = 1.0
    rows: float = 1.0
    cols: float = 1.0
    min_rows: float = 1.0
    lam: float = 0.0
    loss: str = "squared"  # or 'logistic'
    weighted: bool = False
    pos_weight: float | None = None
    parts: int = -1
    seed: int = 42


@dataclass
class Tree:
    """Flat nodes: feature (-1: leaf), bin (up to it: left), left child (the
    right one follows it), value, gain."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def state(self) -> tuple:
        """Plain arrays: what travels between processes."""
        return self.feature, self.bin, self.left, self.value, self.gain

    @classmethod
    def root(cls) -> "Tree":
        return cls(np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros(1), np.zeros(1))

    def split(self, nodes: np.ndarray, feature, bins, gain, values) -> np.ndarray:
        """Split ``nodes``; the numbers of their left children."""
        first = len(self.feature) + 2 * np.arange(len(nodes))
        more = 2 * len(nodes)
        for name, fill in (("feature", -1), ("bin", 0), ("left", 0), ("value", 0), ("gain", 0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(more, fill, old.dtype)]))
        self.feature[nodes], self.bin[nodes], self.left[nodes], self.gain[nodes] = feature, bins, first, gain
        self.value[first], self.value[first + 1] = values
        return first

    def walk(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf that each row (a column of ``bins``) is in."""
        rows = np.arange(bins.shape[1]) if rows is None else rows
        node = np.zeros(len(rows), np.int32)
        while True:
            f = self.feature[node]
            going = f >= 0
            if not going.any():
                return node
            right = bins[np.maximum(f, 0), rows] > self.bin[node]
            node = np.where(going, self.left[node] + right, node)


# ---------------------------------------------------------------- row draws
def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (splitmix64's constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed * 1_000_003 + tree], np.uint64))
        return (_mixed(key ^ salt) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _columns(job: Job, tree: int, k: int) -> np.ndarray:
    n = max(1, int(round(job.cols * k)))
    rank = np.argsort(_uniform(np.arange(k, dtype=np.uint64), job.seed + 7, tree), kind="stable")
    return np.sort(rank[:n])


class Codes:
    """Bins of several columns in one code a row: sums by code hold the sums by
    bin of each of them. Indexed like the matrix of bins by (columns, rows)."""

    def __init__(self, codes: np.ndarray, groups: list[list[tuple[int, int, int]]]):
        """``groups``: for each row of ``codes`` its (column, shift, bits)."""
        self.codes, self.groups = codes, groups
        self.group, self.shift, self.mask = (np.zeros(sum(map(len, groups)), t) for t in (np.intp, np.uint16, np.uint16))
        for i, group in enumerate(groups):
            for f, shift, bits in group:
                self.group[f], self.shift[f], self.mask[f] = i, shift, (1 << bits) - 1

    @classmethod
    def grouped(cls, highest: Sequence[int]) -> list[list[tuple[int, int, int]]]:
        """Columns by their highest bins, the widest first, each in the first
        group with room."""
        bits = [max(1, int(h).bit_length()) for h in highest]
        groups: list[list[tuple[int, int, int]]] = []
        for f in sorted(range(len(bits)), key=lambda f: (-bits[f], f)):
            for group in groups:
                used = group[-1][1] + group[-1][2]
                if used + bits[f] <= CODE_BITS:
                    group.append((f, used, bits[f]))
                    break
            else:
                groups.append([(f, 0, bits[f])])
        return groups

    @classmethod
    def of(cls, bins: "np.ndarray | Codes", highest: Sequence[int] | None = None) -> "Codes":
        if isinstance(bins, Codes):
            return bins
        groups = cls.grouped(highest if highest is not None else bins.max(axis=1, initial=0).tolist())
        codes = np.zeros((len(groups), bins.shape[1]), np.uint16)
        for code, group in zip(codes, groups):
            for f, shift, _ in group:
                code |= bins[f].astype(np.uint16) << np.uint16(shift)
        return cls(codes, groups)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.group), self.codes.shape[1]

    def __len__(self) -> int:
        return len(self.group)

    def __getitem__(self, key):
        f, rows = key
        return (self.codes[self.group[f], rows] >> self.shift[f]) & self.mask[f]

    def take(self, at: np.ndarray) -> "Codes":
        return Codes(self.codes[:, at], self.groups)


@dataclass
class Rows:
    """Unpacked rows of one or more blocks."""

    bins: "np.ndarray | Codes"
    y: np.ndarray
    w: np.ndarray
    part: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, blocks: Sequence, k: int) -> "Rows":
        kinds = (("y", np.float64), ("w", np.float64), ("part", np.uint8), ("key", np.uint64))
        flat = {c: np.concatenate([np.frombuffer(b[c], t) for b in blocks]) for c, t in kinds}
        bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(k, -1) for b in blocks], axis=1)
        return cls(np.ascontiguousarray(bins), **flat)

    def take(self, at: np.ndarray, job: Job | None = None) -> "Rows":
        """Rows ``at``; for a ``job`` only what it reads of them."""
        bins = self.bins.take(at) if isinstance(self.bins, Codes) else np.ascontiguousarray(self.bins[:, at])
        weighs, draws = job is None or job.weighted, job is None or job.kind == "forest" or job.rows < 1
        return Rows(bins, self.y[at], self.w[at if weighs else slice(0)], self.part[at], self.key[at if draws else slice(0)])

    def among(self, a: int, b: int) -> "Rows":
        """Rows ``a`` to ``b`` without their bins."""
        return Rows(self.bins, self.y[a:b], self.w[a:b], self.part[a:b], self.key[a:b])

    def weight(self, job: Job) -> np.ndarray:
        mask = np.uint64(job.parts & ((1 << 64) - 1))
        inside = ((mask >> self.part.astype(np.uint64)) & np.uint64(1)).astype(float)
        if job.pos_weight is not None:
            return inside * np.where(self.y == 1, job.pos_weight, 1.0)
        return inside * self.w if job.weighted else inside

    def draws(self, job: Job, tree: int) -> np.ndarray:
        """How often each row is taken for a tree."""
        if job.kind == "forest":
            return np.searchsorted(_POISSON, _uniform(self.key, job.seed, tree), "right").astype(float)
        return np.ones(len(self.y)) if job.rows >= 1 else (_uniform(self.key, job.seed, tree) < job.rows).astype(float)


def _gradients(job: Job, base: float, unit: float, rows: Rows, margin: np.ndarray, weight: np.ndarray, draw: np.ndarray):
    """Whole numbers of gradient and Hessian units, and row counts."""
    taken = weight * draw
    if job.loss == "logistic" and job.kind == "boost":
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = taken * (p - rows.y), taken * p * (1.0 - p)
    else:
        g, h = taken * (margin - rows.y), taken
    return np.rint(g * (_UNIT / unit)), np.rint(h * _UNIT), draw * (weight > 0)


# ---------------------------------------------------------------- kernels
def histogram(bins: np.ndarray, at: np.ndarray, slot: np.ndarray, slots: int, columns: np.ndarray, sums: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of gradients, Hessians and counts by (kind, slot, column, bin) of
    the rows ``at``. Counts of one each are counted; Hessians that are units of
    the counts (squared loss, no weights) are read off them. Whole numbers:
    either way the same sums."""
    out = np.empty((3, slots, len(columns), BINS))
    base = slot.astype(np.intp) * BINS
    g, h, c = (s[at] for s in sums)
    ones, units = bool((c == 1).all()), bool((h == c * _UNIT).all())
    for i, f in enumerate(columns.tolist()):
        code = base + bins[f].take(at)
        out[0, :, i] = np.bincount(code, g, slots * BINS).reshape(slots, BINS)
        out[2, :, i] = np.bincount(code, None if ones else c, slots * BINS).reshape(slots, BINS)
        out[1, :, i] = out[2, :, i] * _UNIT if units else np.bincount(code, h, slots * BINS).reshape(slots, BINS)
    return out


class _Sums:
    """Sums of gradients, Hessians and counts by (kind, slot, column, bin) over
    the codes of chunks of rows. A chunk's Hessians and counts are whole numbers
    that share a double where their sums fit its 53 bits: one pass for both."""

    def __init__(self, codes: Codes, slots: int, columns: np.ndarray):
        self.codes, self.slots, self.columns = codes, slots, columns
        wanted = {f: i for i, f in enumerate(columns.tolist())}
        self.groups = [(i, [(wanted[f], f, shift, bits) for f, shift, bits in g if f in wanted], g[-1][1] + g[-1][2]) for i, g in enumerate(codes.groups)]
        self.groups = [g for g in self.groups if g[1]]
        # Cells stay few against the rows of a chunk: by code for some slots only.
        self.chunk = CHUNK_ROWS * min(slots, 4)
        self.joint = {i: np.zeros((3, slots << size)) for i, fs, size in self.groups if len(fs) > 1 and slots << size <= self.chunk // 8}
        self.cells = np.zeros((3, len(columns), slots * BINS))

    def add(self, a: int, b: int, at: np.ndarray | None, slot: np.ndarray | None, sums: Sequence[np.ndarray]) -> None:
        """Rows ``a + at`` (None: all) of ``a`` to ``b``; ``sums`` are theirs."""
        g, h, c = sums
        if not len(g):
            return
        c = c.astype(float)
        bits = int(h.sum()).bit_length()
        both = h + c * float(1 << bits) if bits + int(c.sum()).bit_length() <= 53 else None

        def added(code: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            left = np.bincount(code, g, cells)
            if both is None:
                return left, np.bincount(code, h, cells), np.bincount(code, c, cells)
            packed = np.bincount(code, both, cells)
            count = np.floor(packed * 2.0**-bits)
            return left, packed - count * float(1 << bits), count

        slot = slot.astype(np.intp) if self.slots > 1 else None
        by_bin = slot * BINS if self.slots > 1 else None
        for i, columns, size in self.groups:
            code = self.codes.codes[i, a:b] if at is None else self.codes.codes[i, a:b].take(at)
            if i in self.joint:
                code = code.astype(np.intp) if slot is None else (slot << size) + code
                for total, more in zip(self.joint[i], added(code, self.slots << size)):
                    total += more
                continue
            for place, f, shift, _ in columns:
                one = (code >> np.uint16(shift) if shift else code) & self.codes.mask[f]
                one = one.astype(np.intp) if slot is None else by_bin + one
                for total, more in zip(self.cells, added(one, self.slots * BINS)):
                    total[place] += more

    def total(self) -> np.ndarray:
        out = np.ascontiguousarray(self.cells.reshape(3, len(self.columns), self.slots, BINS).swapaxes(1, 2))
        for i, columns, size in self.groups:
            if i in self.joint:
                for place, _, shift, bits in columns:
                    # (kind, slot, higher columns, this one, lower columns)
                    cells = self.joint[i].reshape(3, self.slots, 1 << (size - shift - bits), 1 << bits, 1 << shift)
                    out[:, :, place, : 1 << bits] = cells.sum(axis=(2, 4))
        return out


def best_splits(h: np.ndarray, unit: float, lam: float, min_rows: float) -> tuple[np.ndarray, ...]:
    """For each slot the gain of its best split (first column, first bin on
    ties), column, bin and the sums to its left. No split: gain 0. A few slots
    at a time, so that the sums at work stay in a core's cache."""
    many = max(1, _SEARCH_CELLS // max(1, h.shape[2] * BINS))
    if h.shape[1] > many:
        parts = [best_splits(h[:, i : i + many], unit, lam, min_rows) for i in range(0, h.shape[1], many)]
        return tuple(np.concatenate(p) for p in zip(*parts))
    g, hess, count = h
    left = [np.cumsum(x, axis=2) for x in (g, hess, count)]
    total = [x[:, :, -1:] for x in left]
    right = [t - x for t, x in zip(total, left)]

    def score(gs, hs):
        return (gs * unit) ** 2 / (hs + lam * _UNIT)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1])
    bad = (left[2] < min_rows) | (right[2] < min_rows) | (left[1] <= 0) | (right[1] <= 0)
    gain[bad] = 0.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    i = np.arange(len(flat))
    top = flat[i, best]
    # A gain within the noise of its own parts is none.
    floor = 1e-12 * np.abs(score(total[0][:, 0, 0], np.maximum(total[1][:, 0, 0], 1.0)))
    column, cut = np.divmod(best, BINS)
    sums = [x[i, column, cut] for x in left], [x[i, 0, 0] for x in total]
    return np.where(top > np.maximum(floor, 1e-9), top / _UNIT, 0.0), column, cut, *sums[0], *sums[1]


def _value(g, h, unit: float, lam: float):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h > 0, -(g * unit) / (h + lam * _UNIT), 0.0)


def grow(job: Job, unit: float, bins: "np.ndarray | Codes", sums: tuple[np.ndarray, ...], columns: np.ndarray, leaf: np.ndarray | None = None) -> Tree:
    """One tree over rows at hand; ``leaf`` gets the leaves of the rows that
    count. A level is one pass over the rows, a chunk at a time."""
    tree, codes = Tree.root(), Codes.of(bins)
    g, h, c = sums
    tree.value[0] = _value(g.sum(), h.sum(), unit, job.lam)
    n = codes.shape[1]
    # The place of a row's node among those that grow; -1: none of them.
    slot = np.where(c > 0, 0, -1).astype(np.int16 if job.depth < 15 else np.int32)
    nodes, first = np.zeros(1, np.int64), _Sums(codes, 1, columns)
    for a in range(0, n, first.chunk):
        b = min(a + first.chunk, n)
        first.add(a, b, None, None, (g[a:b], h[a:b], c[a:b]))
    hist = first.total()
    for level in range(job.depth):
        gain, column, cut, lg, lh, lc, tg, th, tc = best_splits(hist, unit, job.lam, job.min_rows)
        won = np.flatnonzero(gain > 0)
        if not len(won):
            break
        rg, rh = (tg - lg)[won], (th - lh)[won]
        values = _value(lg[won], lh[won], unit, job.lam), _value(rg, rh, unit, job.lam)
        first = tree.split(nodes[won], columns[column[won]], cut[won], gain[won], values)
        new = np.full(len(nodes), -1, slot.dtype)
        new[won] = np.arange(len(won))
        feature, last = columns[column[won]], level + 1 == job.depth
        group, mask, most = codes.group[feature], codes.mask[feature] << codes.shift[feature], cut[won].astype(np.uint16) << codes.shift[feature]
        # Sums of the smaller child; its sibling is the parent less that.
        small_right = 2 * lc[won] > tc[won]
        small = None if last else _Sums(codes, len(won), columns)
        step = CHUNK_ROWS if last else small.chunk
        for a in range(0, n, step):
            b = min(a + step, n)
            at = np.flatnonzero(slot[a:b] >= 0)
            s = new[slot[a:b][at]]
            slot[a:b] = -1
            if len(won) < len(nodes):
                at, s = at[s >= 0], s[s >= 0]
            if len(won) == 1:
                right = (codes.codes[group[0], a:b].take(at) & mask[0]) > most[0]
            else:
                right = (codes.codes[group[s], a + at] & mask[s]) > most[s]
            if leaf is not None:
                leaf[a + at] = first[s] + right
            if last:
                continue
            slot[a + at] = 2 * s + right
            mine = right == small_right[s]
            at, s = at[mine], s[mine]
            small.add(a, b, at, s, [x[a:b].take(at) for x in sums])
        if last:
            break
        part = small.total()
        pair = np.empty((3, len(won), 2, len(columns), BINS))
        for i, (parent, side) in enumerate(zip(won.tolist(), small_right.astype(int).tolist())):
            pair[:, i, side] = part[:, i]
            np.subtract(hist[:, parent], part[:, i], out=pair[:, i, 1 - side])
        hist = pair.reshape(3, -1, len(columns), BINS)
        nodes = np.stack([first, first + 1], axis=1).ravel()
    return tree


# ---------------------------------------------------------------- binned rows
@dataclass
class Binned:
    """Blocks in the shared folder and what every model needs of them."""

    folder: str
    df: DataFrame
    cols: list[str]
    edges: list[np.ndarray]
    rows: int
    stats: dict = field(default_factory=dict)

    @property
    def bytes(self) -> int:
        return self.rows * (len(self.cols) + 25)

    def start(self, job: Job) -> tuple[float, float]:
        """A job's first margin and its unit of gradients, from sums by part
        and label side (few rows)."""
        inside = [s for p, s in self.stats.items() if (job.parts >> p) & 1]
        if job.pos_weight is not None:
            pairs = [(s["n0"] + job.pos_weight * s["n1"], job.pos_weight * s["n1"]) for s in inside]
        elif job.weighted:
            pairs = [(s["w"], s["wy"]) for s in inside]
        else:
            pairs = [(s["n"], s["y"]) for s in inside]
        weight, label = (sum(p[i] for p in pairs) for i in range(2))
        top = max((s["w_max"] for s in inside), default=1.0) if job.weighted else job.pos_weight or 1.0
        if job.loss == "logistic" and job.kind == "boost":
            share = min(max(label / weight, 1e-6), 1 - 1e-6) if weight else 0.5
            return math.log(share / (1 - share)), max(top, 1.0)
        span = max((s["y_max"] for s in inside), default=1.0)
        base = 0.0 if job.kind == "forest" or not weight else label / weight
        return base, (span * max(top, 1.0)) or 1.0


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` cuts a column: its values at even ranks (to 36 bits,
    24 of them of the mantissa), the same in any partitioning."""
    found, _ = values_at_ranks(df, cols, lambda n: np.minimum(np.arange(1, bins) * n // bins, n - 1), bits=36)
    return [np.unique(v) for v in found]


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a row-major matrix, one row a feature; a value is in the bin
    after the last cut that is not above it, a missing one in the first."""
    out = np.zeros((len(edges), len(x)), np.uint8)
    for i, e in enumerate(edges):
        known = ~np.isnan(x[:, i])
        out[i, known] = np.searchsorted(e, x[known, i], "right")
    return out


def bin_rows(
    df: DataFrame, cols: Sequence[str], label: str, ids: Sequence[str], weight: Column | None = None, part: Column | None = None,
    edges: list[np.ndarray] | None = None, bins: int = BINS,
) -> Binned:
    """Bin ``df`` once and write its blocks. ``part`` is 0 to 63."""
    cols = list(cols)
    edges = edges if edges is not None else bin_edges(df, cols, bins)
    weight = weight if weight is not None else F.lit(1.0)
    part = part if part is not None else F.lit(0)
    source = df.select(
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
        F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"), part.cast("int").alias("part"), F.xxhash64(*ids).alias("key"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[: len(cols)]])
                y, w, p, key = (b.column(n).to_numpy(zero_copy_only=False) for n in ("y", "w", "part", "key"))
                data = [_binned(x, edges), y.astype(float), w.astype(float), p.astype(np.uint8), key.astype(np.int64).view(np.uint64)]
                arrays = [pa.array([b.num_rows], pa.int32()), *[pa.array([d.tobytes()], pa.binary()) for d in data]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _BLOCK.split(", ")])

    folder = scratch_path(df.sparkSession, "binned")
    source.mapInArrow(pack, _BLOCK).write.parquet(folder)
    blocks = df.sparkSession.read.schema(_BLOCK).parquet(folder)
    one = F.col("y") == 1
    stats = source.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.max("w").alias("w_max"),
        F.max(F.abs("y")).alias("y_max"), F.sum(one.cast("long")).alias("n1"), F.sum((~one).cast("long")).alias("n0"),
    ).collect()  # a row a part
    return Binned(folder, blocks, cols, edges, sum(r["n"] for r in stats), {r["part"]: r.asDict() for r in stats})


# ---------------------------------------------------------------- models
def predicted(state: tuple, x: np.ndarray) -> np.ndarray:
    kind, loss, rate, edges, base, trees = state
    bins, total = _binned(x, edges), np.zeros(len(x))
    for t in trees:
        tree = Tree(*t)
        total += tree.value[tree.walk(bins)]
    if kind == "forest":
        mean = total / max(1, len(trees))
        # Gradients and Hessians are rounded apart: a share may be off by a unit.
        return np.clip(mean, 0.0, 1.0) if loss == "logistic" else mean
    margin = base + rate * total
    return 1.0 / (1.0 + np.exp(-margin)) if loss == "logistic" else margin


@dataclass
class Fitted:
    """A fitted job: flat trees over binned features."""

    job: Job
    cols: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def state(self) -> tuple:
        return self.job.kind, self.job.loss, self.job.rate, self.edges, self.base, [t.state() for t in self.trees]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return predicted(self.state(), x)

    def transform(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        """Adds the prediction (the share of ones for a classifier) as ``out``,
        scored in Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast(self.state())

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(predicted(shared.value, x.to_numpy(dtype=float, na_value=np.nan)))

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double") for c in self.cols])))

    def importance(self) -> list[tuple[str, float]]:
        """Gains by feature, scaled to a sum of one; a forest's trees count alike."""
        total = np.zeros(len(self.cols))
        for t in self.trees:
            gain = np.bincount(np.maximum(t.feature, 0), np.where(t.feature >= 0, t.gain, 0.0), len(self.cols))
            total += gain / gain.sum() if self.job.kind == "forest" and gain.sum() else gain
        return list(zip(self.cols, (total / total.sum() if total.sum() else total).tolist()))


def _grow_here(job: Job, base: float, unit: float, rows: Rows, numbers: Sequence[int]) -> list[Tree]:
    # Rows of other parts add nothing to any sum: a job works on its own ones.
    spans = [(a, min(a + CHUNK_ROWS, len(rows.y))) for a in range(0, len(rows.y), CHUNK_ROWS)]
    inside = [a + np.flatnonzero(rows.among(a, b).weight(job) > 0) for a, b in spans]
    if sum(map(len, inside)) < len(rows.y):
        rows = rows.take(np.concatenate(inside), job)
    del inside
    n, codes = len(rows.y), Codes.of(rows.bins)
    margin, trees = np.full(n, base), []
    sums = np.empty(n), np.empty(n), np.empty(n, np.uint8)
    leaf = np.zeros(n, np.int32) if job.kind == "boost" else None
    for t in numbers:
        for a in range(0, n, CHUNK_ROWS):
            b = min(a + CHUNK_ROWS, n)
            chunk = rows.among(a, b)
            for kept, more in zip(sums, _gradients(job, base, unit, chunk, margin[a:b], chunk.weight(job), chunk.draws(job, t))):
                kept[a:b] = more
        if leaf is not None:
            leaf[:] = 0
        tree = grow(job, unit, codes, sums, _columns(job, t, codes.shape[0]), leaf)
        trees.append(tree)
        if leaf is None:
            continue
        for a in range(0, n, CHUNK_ROWS):
            b = min(a + CHUNK_ROWS, n)
            out = np.flatnonzero(sums[2][a:b] == 0)
            if len(out):
                leaf[a + out] = tree.walk(codes, a + out)
            margin[a:b] += job.rate * tree.value[leaf[a:b]]
    return trees


def fit(data: Binned, jobs: Sequence[Job], local_bytes: int = LOCAL_BYTES) -> list[Fitted]:
    """All ``jobs`` over the same binned rows."""
    starts = [data.start(j) for j in jobs]
    trees = _fit_local(data, jobs, starts) if data.bytes <= local_bytes else _fit_distributed(data, jobs, starts)
    return [Fitted(j, data.cols, data.edges, base, t) for j, (base, _), t in zip(jobs, starts, trees)]


def _all_rows(data: Binned) -> Rows:
    """All blocks as one, of at most ``local_bytes``, read a file's part at a
    time into what is returned. Labels that are small whole numbers take a byte."""
    n, k, highest, small, at = data.rows, len(data.cols), [len(e) for e in data.edges], True, 0
    groups = Codes.grouped(highest)
    whole = Rows(Codes(np.empty((len(groups), n), np.uint16), groups), np.empty(n), np.empty(n), np.empty(n, np.uint8), np.empty(n, np.uint64))
    for r in data.df.toLocalIterator():
        b = Rows.of([r.asDict()], k)
        to = slice(at, at + len(b.y))
        whole.bins.codes[:, to] = Codes.of(b.bins, highest).codes
        whole.y[to], whole.w[to], whole.part[to], whole.key[to] = b.y, b.w, b.part, b.key
        small = small and bool((b.y == b.y.astype(np.uint8)).all())
        at = to.stop
    if small:
        whole.y = whole.y.astype(np.uint8)
    return whole


def _fit_local(data: Binned, jobs: Sequence[Job], starts) -> list[list[Tree]]:
    spark = data.df.sparkSession
    whole = _all_rows(data)
    # Plain arrays travel between processes, not classes.
    shared = spark.sparkContext.broadcast((whole.bins.codes, whole.bins.groups, whole.y, whole.w, whole.part, whole.key))
    del whole
    tasks = []
    for i, job in enumerate(jobs):
        size = job.trees if job.kind == "boost" else max(1, -(-job.trees // (2 * spark.sparkContext.defaultParallelism)))
        cost = 1 if job.kind == "boost" else 2
        tasks += [(cost * size * job.depth, i, list(range(a, min(a + size, job.trees)))) for a in range(0, job.trees, size)]
    tasks.sort(key=lambda t: (-t[0], t[1:]))  # the longest first
    listed = list(jobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, groups, *more = shared.value
        rows = Rows(Codes(codes, groups), *more)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                _, i, numbers = tasks[n]
                got = _grow_here(listed[i], *starts[i], rows, numbers) if len(rows.y) else []
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps([t.state() for t in got])], pa.binary())], names=["n", "trees"])

    found = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "n long, trees binary").collect()
    shared.unpersist()
    out: list[dict[int, list[Tree]]] = [{} for _ in jobs]
    for r in found:
        _, i, numbers = tasks[r["n"]]
        out[i][numbers[0]] = [Tree(*t) for t in pickle.loads(r["trees"])]
    return [[t for first in sorted(o) for t in o[first]] for o in out]


def _fit_distributed(data: Binned, jobs: Sequence[Job], starts) -> list[list[Tree]]:
    spark, k = data.df.sparkSession, len(data.cols)
    done: list[list[Tree]] = [[] for _ in jobs]
    blocks, written = data.df.withColumn("margins", F.lit(b"")), [0 for _ in jobs]

    def margin_of(i: int, rows: Rows, stored: np.ndarray | None, trees: list[list[Tree]]) -> np.ndarray:
        margin = np.full(len(rows.y), starts[i][0]) if stored is None else stored[i].copy()
        for t in trees[i]:
            margin = margin + jobs[i].rate * t.value[t.walk(rows.bins)]
        return margin

    def unpacked(batch: pa.RecordBatch, at: int) -> tuple[Rows, np.ndarray | None]:
        row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
        margins = np.frombuffer(row["margins"], np.float64)
        return Rows.of([row], k), margins.reshape(len(jobs), -1) if len(margins) else None

    def level(frame: DataFrame, growing: list[tuple[int, int, Tree, np.ndarray]], fresh: list[list[Tree]]) -> dict:
        """Best splits by (place in ``growing``, slot)."""
        plain = [(i, t, tree.state(), nodes) for i, t, tree, nodes in growing]
        shared = spark.sparkContext.broadcast((plain, [[t.state() for t in f] for f in fresh]))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            growing, fresh = [(i, t, Tree(*s), nodes) for i, t, s, nodes in shared.value[0]], [[Tree(*t) for t in f] for f in shared.value[1]]
            total: list = [0.0] * len(growing)
            for batch in batches:
                for b in range(batch.num_rows):
                    rows, stored = unpacked(batch, b)
                    margins: dict[int, np.ndarray] = {}
                    for n, (i, t, tree, nodes) in enumerate(growing):
                        if i not in margins:
                            margins[i] = margin_of(i, rows, stored, fresh)
                        g = _gradients(jobs[i], *starts[i], rows, margins[i], rows.weight(jobs[i]), rows.draws(jobs[i], t))
                        at = np.flatnonzero(g[2] > 0)
                        slot = np.full(len(tree.feature), -1)
                        slot[nodes] = np.arange(len(nodes))
                        slot = slot[tree.walk(rows.bins, at)]
                        at, slot = at[slot >= 0], slot[slot >= 0]
                        total[n] = total[n] + histogram(rows.bins, at, slot, len(nodes), _columns(jobs[i], t, k), g)
            for n, h in enumerate(total):
                if isinstance(h, float):
                    continue
                s, c, b = np.nonzero(h[2])
                arrays = [pa.array(np.full(len(s), n)), pa.array(s), pa.array(c), pa.array(b), *[pa.array(h[j, s, c, b].astype(np.int64)) for j in range(3)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["n", "slot", "c", "b", "g", "h", "k"])

        def search(table: pa.Table) -> pa.Table:
            growing = shared.value[0]
            x = {c: table.column(c).to_numpy() for c in table.column_names}
            n = int(x["n"][0])
            i, t = growing[n][:2]
            h = np.zeros((3, 1, len(_columns(jobs[i], t, k)), BINS))
            for j, c in enumerate(("g", "h", "k")):
                h[j, 0, x["c"], x["b"]] = x[c]
            got = best_splits(h, starts[i][1], jobs[i].lam, jobs[i].min_rows)
            names = ("gain", "column", "cut", "lg", "lh", "lc", "tg", "th", "tc")
            return pa.table({"n": pa.array([n], pa.int64()), "slot": pa.array(x["slot"][:1]), **{c: pa.array(v.astype(float)) for c, v in zip(names, got)}})

        cells = frame.mapInArrow(sums, "n long, slot long, c long, b long, g long, h long, k long").groupBy("n", "slot", "c", "b")
        summed = cells.agg(*[F.sum(c).alias(c) for c in "ghk"])
        kinds = ", ".join(f"{c} double" for c in ("gain", "column", "cut", "lg", "lh", "lc", "tg", "th", "tc"))
        best = summed.groupBy("n", "slot").applyInArrow(search, f"n long, slot long, {kinds}").collect()
        return {(r["n"], r["slot"]): r for r in best}

    def grow_all(frame: DataFrame, wanted: list[tuple[int, int]], fresh: list[list[Tree]]) -> list[Tree]:
        state = [(i, t, Tree.root(), np.zeros(1, np.int64)) for i, t in wanted]
        for depth in range(max(jobs[i].depth for i, _ in wanted)):
            live = [s for s, (i, _, _, nodes) in enumerate(state) if len(nodes) and depth < jobs[i].depth]
            while live:
                size, part = 0, []
                while live and (not part or size + len(state[live[0]][3]) * k * BINS * 24 <= PASS_BYTES):
                    size += len(state[live[0]][3]) * k * BINS * 24
                    part.append(live.pop(0))
                best = level(frame, [state[s] for s in part], fresh)
                for n, s in enumerate(part):
                    i, t, tree, nodes = state[s]
                    unit, lam, columns = starts[i][1], jobs[i].lam, _columns(jobs[i], t, k)
                    got = [best.get((n, slot)) for slot in range(len(nodes))]
                    if depth == 0 and got[0] is not None:
                        tree.value[0] = _value(got[0]["tg"], got[0]["th"], unit, lam)
                    won = [slot for slot, r in enumerate(got) if r is not None and r["gain"] > 0]
                    r = {c: np.array([got[slot][c] for slot in won]) for c in ("gain", "column", "cut", "lg", "lh", "tg", "th")}
                    if not won:
                        state[s] = (i, t, tree, np.zeros(0, np.int64))
                        continue
                    values = _value(r["lg"], r["lh"], unit, lam), _value(r["tg"] - r["lg"], r["th"] - r["lh"], unit, lam)
                    first = tree.split(nodes[won], columns[r["column"].astype(int)], r["cut"], r["gain"], values)
                    state[s] = (i, t, tree, np.stack([first, first + 1], axis=1).ravel())
        return [s[2] for s in state]

    forests = [(i, t) for i, j in enumerate(jobs) if j.kind == "forest" for t in range(j.trees)]
    if forests:
        for (i, _), tree in zip(forests, grow_all(blocks, forests, [[] for _ in jobs])):
            done[i].append(tree)
    for t in range(max([j.trees for j in jobs if j.kind == "boost"], default=0)):
        wanted = [(i, t) for i, j in enumerate(jobs) if j.kind == "boost" and t < j.trees]
        fresh = [d[w:] if j.kind == "boost" else [] for d, w, j in zip(done, written, jobs)]
        for (i, _), tree in zip(wanted, grow_all(blocks, wanted, fresh)):
            done[i].append(tree)
        if (t + 1) % REFRESH == 0:
            blocks, written = _with_margins(blocks, margin_of, unpacked, [d[w:] if j.kind == "boost" else [] for d, w, j in zip(done, written, jobs)]), [len(d) for d in done]
    return done


def _with_margins(blocks: DataFrame, margin_of, unpacked, fresh: list[list[Tree]]) -> DataFrame:
    """Blocks with every job's margin, written to the shared folder."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast([[t.state() for t in f] for f in fresh])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [[Tree(*t) for t in f] for f in shared.value]
        for batch in batches:
            margins = []
            for b in range(batch.num_rows):
                rows, stored = unpacked(batch, b)
                margins.append(np.stack([margin_of(i, rows, stored, trees) for i in range(len(trees))]).tobytes())
            at = batch.schema.names.index("margins")
            yield batch.set_column(at, "margins", pa.array(margins, pa.binary()))

    folder = scratch_path(spark, "margins")
    schema = f"{_BLOCK}, margins binary"
    blocks.mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def on_parts(job: Job, parts: Sequence[int]) -> Job:
    """The job trained on these parts only."""
    return replace(job, parts=sum(1 << p for p in parts))
