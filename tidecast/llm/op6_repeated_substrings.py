"""Repeated substrings by window anchors and verified ranks.

Every byte is to be found that a ``span``-byte string (200) covers which also
starts anywhere else in the corpus. Prefix doubling ranks positions by a short
prefix first, then by pairs of ranks at growing offsets, and drops a position
as soon as its rank is unique; ranks past the threshold give the answer. Rows
for every byte position would be 16 times the input (an estimate, not measured),
so prefix doubling is replaced here: no ranks are paired and no offset doubles.
Anchors are chosen as in winnowing, and hashes of three lengths are taken from
the text and counted. The answer is exact all the same:

* Every 200-byte window has an anchor, the position of the smallest hash of
  its ``GRAM``-byte strings (25). The choice depends on the window's bytes
  alone, so equal windows have equal anchors at equal offsets. The windows
  that share one anchor are a run of consecutive starts, one row for about 70
  windows.
* First rank: the 25 bytes at the anchor. Spark brings equal ranks together,
  sorted, and counts them; a row with a unique rank is dropped with all of its
  windows. At the same time the whole run (all bytes of its windows) is ranked:
  a run that occurs twice is settled, all its windows repeat.
* Second rank: of the rows left, the 113 bytes from the anchor on and the 113
  bytes that begin 88 before it; each window contains one of the two, and those
  whose part is unique are dropped.
* Last rank: pairs (first rank, hash of the 200 bytes) of the windows left; one
  row of every settled run takes part as a witness. A window whose rank is not
  unique repeats.

Ranks are 64-bit names compared together with the first rank, 128 bits in
effect. Rows of a first rank with more than ``HOT_ROWS`` members (a passage in
a third of all documents) are ranked by grouped counts, combined before the
shuffle, and a join that Spark can split; all others by sorted windows in one
shuffle. Texts are shuffled only if they hold rows that are left; fixed-size
bitmaps (1 MB, whatever the input) tell the others. Exact copies of a text are
counted first and ranked as one text, all of whose bytes repeat.

Defined cases: null and empty texts have no bytes and no spans, as have texts
under 200 bytes; repeated rows are copies of each other and lose all of their
200 bytes or more; an empty table gives an empty result; extra columns are
kept by ``repeated_spans``. Texts are told apart by a 64-bit hash and their
length's low 16 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import col, table

SPAN = 200
GRAM = 25
HOT_ROWS = 100_000
SAMPLE = 64
_BITMAP_BITS = 1 << 23
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)
#: Bytes that are looked at together; windows never reach over more.
_BLOCK = 1 << 23


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substring from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        # A random 64-bit value for each byte.
        self.values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, data: bytes) -> None:
        x = np.frombuffer(data, np.uint8)
        if len(self.up) <= len(x):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(2 * len(x) + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        self.size = len(x)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.values[x] * self.up[: len(x)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        n = self.size - length + 1
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(grams: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: (anchor, first window, last window) of runs of
    windows with one anchor, from the hashes of all grams."""
    width = span - gram + 1
    windows = len(grams) - width + 1
    # The leftmost smallest hash: 40 bits of it, then the place.
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    # Sliding minimum from prefix and suffix minima of blocks as wide as a window.
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], first, np.append(first[1:], windows) - 1


def _position_rows(span: int, gram: int, block: int):
    """(kg, run, t, place) of every run of every text: kg and run are the first
    ranks, place holds the first window, the number of windows, the anchor's
    offset in the first window and 16 bits of the text's length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["kg", "run", "t", "place"]

        def flush(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

        parts, held = [], 0
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py()
                for at in range(0, max(1, len(data) - span + 1), block - span + 1):
                    hasher.read(data[at : at + block])
                    if hasher.size < span:
                        continue
                    anchor, first, last = runs(hasher.every(gram), span, gram)
                    kg, offset = hasher.of(anchor, anchor + gram), anchor - first
                    shape = _mix((offset * span + last - first).astype(np.uint64))
                    run = hasher.of(first, last + span) ^ shape
                    size = len(first)
                    place = (first + at) << 32 | (last - first + 1) << 24 | offset << 16 | len(data) & 0xFFFF
                    parts.append((kg.view(np.int64), run.view(np.int64), np.full(size, t, np.int64), place))
                    held += size
                    if held >= 50_000:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    return rows


_POSITIONS = "kg long, run long, t long, place long"


def _unpacked(df: DataFrame) -> DataFrame:
    """``place`` as first, windows, offset and m, the length's 16 bits."""
    bits = lambda at, n: F.shiftright("place", at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    return df.select(
        *[c for c in df.columns if c != "place"],
        F.shiftright("place", 32).cast("int").alias("first"),
        bits(24, 8).alias("windows"),
        bits(16, 8).alias("offset"),
        bits(0, 16).alias("m"),
    )


def _window_names(span: int, gram: int):
    """Second ranks and the windows' names of the rows that are left."""
    half = (span - gram + 1) // 2
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["kg", "t", "m", "first", "offset", "open", "right", "left", "names"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for t, m, text, left_rows in zip(*[batch.column(i) for i in range(4)]):
                t, m, data = t.as_py(), m.as_py(), text.as_py().encode()
                for row in left_rows.as_py():
                    first, windows, offset = row["first"], row["windows"], row["offset"]
                    # Both parts lie within the bytes of the row's windows.
                    out.append((row["kg"], t, m, first, offset, row["open"], windows, data[first : first + windows - 1 + span]))
            for at in range(0, len(out), 2000):
                lot = out[at : at + 2000]
                hasher.read(b"".join(r[7] for r in lot))
                starts = np.cumsum([0] + [len(r[7]) for r in lot])[:-1]
                made = []
                for r, p in zip(lot, starts.tolist()):
                    kg, t, m, first, offset, open_, windows, _ = r
                    anchor, low = p + offset, offset - windows + 1
                    window = np.arange(p, p + windows)
                    right = hasher.of(np.array([anchor]), np.array([anchor + span - half + 1])).view(np.int64)[0] if low < half else None
                    left = hasher.of(np.array([anchor - half]), np.array([anchor + gram])).view(np.int64)[0] if offset >= half else None
                    made.append((kg, t, m, first, offset, open_, right, left, hasher.of(window, window + span).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), types)], names=names)

    return rows


_NAMED = "kg long, t long, m int, first int, offset short, open boolean, right long, left long, names array<long>"


def _with_total(df: DataFrame, keys: list[str], total, name: str, hot: bool) -> DataFrame:
    """``df`` with an aggregate over equal ``keys``: by a sorted window, or
    for hot keys by grouped partial sums and a join."""
    if not hot:
        return df.withColumn(name, total.over(Window.partitionBy(*keys)))
    return df.join(df.groupBy(*keys).agg(total.alias(name)), keys)


def _bitmap(keys: DataFrame) -> DataFrame:
    """(word, bits) of the bits that the column ``t`` sets: at most
    _BITMAP_BITS / 64 rows, whatever the size of ``keys``."""
    bit = F.pmod("t", F.lit(_BITMAP_BITS))
    return keys.groupBy((bit / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )


def _maybe_in(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: false only if ``t`` is not in the bitmap's keys."""
    bit = F.pmod("t", F.lit(_BITMAP_BITS))
    # Bounded by _BITMAP_BITS / 64 rows of 16 bytes.
    marked = df.join(F.broadcast(bitmap), (bit / 64).cast("long") == F.col("word"), "left")
    isset = F.call_function("shiftright", F.col("bits"), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return marked.withColumn("maybe", F.coalesce(isset, F.lit(False))).drop("word", "bits")


def _packed_runs():
    """Runs of consecutive windows as ``start << 16 | windows``."""

    @F.arrow_udf("array<long>")
    def packed(first: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for f, s in zip(first.to_pylist(), starts):
            s = np.sort(s.values.to_numpy()).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1] + 1]))
            out.append((f + s[new]) << 16 | np.diff(np.append(new, len(s))))
        return pa.array(out, pa.list_(pa.int64()))

    return packed


def _merged(span: int):
    """Maximal runs of bytes from packed runs of windows."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merged(runs_: pa.Array) -> pa.Array:
        out = []
        for r in runs_:
            r = np.sort(r.values.to_numpy())
            s, e = r >> 16, (r >> 16) + (r & 0xFFFF) - 1 + span
            reach = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > reach[:-1]])
            last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
            out.append([{"start": a, "end": b} for a, b in zip(s[new].tolist(), reach[last].tolist())])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merged


def _judge_first(rows: DataFrame, hot: bool, small: bool = False) -> DataFrame:
    """(kg, t, place, settled) of the rows whose first rank is not unique:
    settled if another row has the same run. kg is null where the row takes
    no further part: settled ones do as witnesses, one of each run, where a
    row of their rank has a run of its own."""
    if hot:
        # Counts are combined before the shuffle and joined back; those of a
        # rank come from its runs' and fit a broadcast, as the ranks' list does.
        runs_ = rows.groupBy("kg", "run").agg(F.count("*").alias("same"), F.min(F.struct("t", "place")).alias("one"))
        ranks = runs_.groupBy("kg").agg(F.sum("same").alias("members"), F.min("same").alias("least"))
        out = rows.join(runs_, ["kg", "run"]).join(F.broadcast(ranks) if small else ranks, "kg")
        chosen = F.struct("t", "place") == F.col("one")
    else:
        run, rank = Window.partitionBy("kg", "run"), Window.partitionBy("kg")
        out = rows.repartition("kg").withColumn("same", F.count("*").over(run))
        out = out.withColumn("nth", F.row_number().over(run.orderBy("t")))
        out = out.withColumn("members", F.count("*").over(rank)).withColumn("least", F.min("same").over(rank))
        chosen = F.col("nth") == 1
    part = (F.col("same") == 1) | (chosen & (F.col("least") == 1))
    return out.filter("members > 1").select(F.when(part, F.col("kg")).alias("kg"), "t", "place", (F.col("same") > 1).alias("settled"))


def _judge_windows(named: DataFrame, span: int, gram: int, hot: bool) -> DataFrame:
    """(t, m, run): the repeated windows of open rows, packed."""
    half = (span - gram + 1) // 2
    # A row without one of the parts has no windows that need it: a value of
    # its own keeps such rows apart.
    own = F.xxhash64("t", "first", F.lit("none"))
    named = named.withColumn("right", F.coalesce("right", own)).withColumn("left", F.coalesce("left", own))
    # Unless hot, one shuffle: equal first ranks meet, later ranks are within them.
    out = _with_total(named if hot else named.repartition("kg"), ["kg", "right"], F.count("*"), "rights", hot)
    out = _with_total(out, ["kg", "left"], F.count("*"), "lefts", hot)
    out = out.select("kg", "t", "m", "first", "offset", "open", "rights", "lefts", F.posexplode("names").alias("i", "name"))
    near = F.col("offset") - F.col("i") < half
    out = out.filter((near & (F.col("rights") > 1)) | (~near & (F.col("lefts") > 1))).select("kg", "t", "m", "first", "open", "i", "name")
    out = _with_total(out, ["kg", "name"], F.count("*"), "times", hot).filter("open and times > 1")
    rows = out.groupBy("kg", "t", "m", "first").agg(F.collect_list("i").alias("starts"))
    return rows.select("t", "m", F.explode(_packed_runs()("first", "starts")).alias("run"))


def _spans_by_text(texts: DataFrame, span: int, gram: int, hot_rows: int, block: int, sample: int) -> DataFrame:
    """(t, m, spans) of the texts that have any. ``texts``: t, m, n, text."""
    from tidecast.session import scratch_path

    spark = texts.sparkSession
    folder = scratch_path(spark, "repeated")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    long = texts.filter(F.col("n") >= span)
    copies = kept(long.groupBy("t", "m").count().filter("count > 1").select("t", "m"), "copies")
    marked = _maybe_in(long, _bitmap(copies))
    # Copies are counted before the shuffle: a text takes part once.
    once = kept(marked.filter("maybe").groupBy("t", "m").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("text").alias("text")), "once")
    distinct = marked.filter("not maybe").select("t", "text").union(once.select("t", "text"))
    positions = distinct.mapInArrow(_position_rows(span, gram, block), _POSITIONS)
    # One row in ``sample`` tells which ranks are crowded; that only decides by
    # which of two exact ways their rows are counted.
    seen = positions.filter(F.pmod(F.xxhash64("t", "place"), F.lit(sample)) == 0).groupBy("kg").count()
    heat = kept(seen.filter(F.col("count") > max(1, hot_rows // sample)).select("kg"), "heat")
    crowded = heat.count()
    # At most one row for every ``hot_rows`` positions, about.
    small = crowded <= 100_000
    hot_keys = F.broadcast(heat) if small else heat
    if crowded:
        parts = [positions.join(hot_keys, "kg", "left_anti"), positions.join(hot_keys, "kg", "left_semi")]
        judged = kept(_judge_first(parts[0], False).unionByName(_judge_first(parts[1], True, small)), "first")
    else:
        judged = kept(_judge_first(positions, False), "first")
    settled = _unpacked(judged.filter("settled").select("t", "place"))
    runs_ = settled.select("t", "m", (F.shiftleft(F.col("first").cast("long"), 16) + F.col("windows")).alias("run"))
    place = F.struct("kg", "first", "windows", "offset", (~F.col("settled")).alias("open"))
    left = _unpacked(judged.filter("kg is not null"))
    need = kept(left.groupBy("t", "m").agg(F.collect_list(place).alias("rows")), "need")
    wanted = _maybe_in(texts, _bitmap(need)).filter("maybe").select("t", "m", "text").dropDuplicates(["t", "m"])
    named = wanted.join(need, ["t", "m"]).select("t", "m", "text", "rows").mapInArrow(_window_names(span, gram), _NAMED)
    if crowded:
        named = kept(named, "named")
        repeats = _judge_windows(named.join(hot_keys, "kg", "left_anti"), span, gram, False).union(
            _judge_windows(named.join(hot_keys, "kg", "left_semi"), span, gram, True)
        )
    else:
        repeats = _judge_windows(named, span, gram, False)
    by_text = runs_.unionByName(repeats).groupBy("t", "m").agg(F.collect_list("run").alias("runs"))
    spans = by_text.select("t", "m", _merged(span)("runs").alias("spans"))
    # Of a text that has a copy all bytes repeat.
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    whole = once.filter("copies > 1").select("t", "m", every.alias("spans"))
    return kept(spans.join(whole, ["t", "m"], "left_anti").union(whole), "spans")


def repeated_spans(
    docs: DataFrame,
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    hot_rows: int = HOT_ROWS,
    block: int = _BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` with ``spans``: the maximal runs of bytes [start, end) of the
    UTF-8 text that repeated ``span``-byte strings cover, in order."""
    names = docs.columns
    plain = docs.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(col(text), F.lit("")).alias("text")
    )
    plain = plain.withColumn("t", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    plain = plain.withColumn("m", F.col("n").bitwiseAND(F.lit(0xFFFF)).cast("int"))
    found = _spans_by_text(plain.select("t", "m", "n", "text"), span, gram, hot_rows, block, sample)
    marked = _maybe_in(plain, _bitmap(found))
    some = marked.filter("maybe").join(found, ["t", "m"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return some.select(*out, F.coalesce("spans", none).alias("spans")).union(marked.filter("not maybe").select(*out, none.alias("spans")))


def kept_bytes(data: bytes, spans: list[dict]) -> bytes:
    """The text's bytes outside of the spans."""
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def digests(spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, spans and the rest's digest."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, found: pa.Array) -> pa.Array:
        both = zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist())
        return pa.array([hashlib.sha256(kept_bytes(t or b"", s)).hexdigest() for t, s in both], pa.string())

    lengths = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    rows = spans.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"), "spans")
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        kept("text", "spans").alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
