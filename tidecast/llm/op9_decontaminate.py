"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and
non-ASCII characters. Patterns are the windows of ten consecutive words of
the benchmark items; an item of fewer words, but not none, is one pattern. As
in Wu and Manber's search, a shift table tells for the block of two words at
the end of the current window how far the search can move on; where the shift
is zero, the patterns with the same last and first blocks (suffix and prefix
buckets) are compared word by word. The alphabet is the benchmark's words, so
nearly every block of a clean text is unknown and skips nine words.

Many segments of the texts are searched in lockstep with numpy inside an
Arrow UDF: one scan of the documents, no shuffle. The benchmark goes to the
tasks in blocks of items of a checked size (``block_bytes`` of text); each
further block is one more scan, whose hits are merged.

Defined cases: null and empty texts or items have no words and no hits;
repeated items count once per item_id (a null item_id counts as the string
``null``); with an empty benchmark every text is clean; an empty table gives
an empty result; input columns named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ALNUM_WORDS, col, fresh, lots, materialise, table, with_struct

WINDOW_WORDS = 10
#: Benchmark text (bytes) that one scan searches for.
BLOCK_BYTES = 4 << 20
#: Words that one lane of the lockstep search passes.
_SEGMENT = 512
#: Words searched at a time.
_BATCH_WORDS = 1 << 20


class WuManber:
    """Shift tables and buckets of the patterns of one length."""

    def __init__(self, patterns: np.ndarray, owners: list[np.ndarray], base: int) -> None:
        self.m = m = patterns.shape[1]
        self.b = b = min(2, m)
        self.base = np.int64(base)
        last, first = self.code(patterns[:, m - b :]), self.code(patterns[:, :b])
        order = np.lexsort((first, last))
        self.patterns, self.owners = patterns[order], [owners[i] for i in order]
        # Shift: distance of a block's last occurrence in any pattern to its end.
        codes = np.concatenate([self.code(patterns[:, q - b : q]) for q in range(b, m + 1)])
        shifts = np.repeat(np.arange(m - b, -1, -1), len(patterns))
        by = np.lexsort((shifts, codes))
        keep = np.concatenate([[True], codes[by][1:] != codes[by][:-1]])
        self.codes, self.shifts = codes[by][keep], shifts[by][keep]
        self.suffix, slot = np.unique(last[order], return_inverse=True)
        self.first, rank = np.unique(first[order], return_inverse=True)
        # Buckets: patterns with one suffix block and one prefix block lie together.
        self.bucket = slot.astype(np.int64) * len(self.first) + rank

    def code(self, block: np.ndarray) -> np.ndarray:
        return block[:, 0].astype(np.int64) * (self.base if self.b == 2 else 1) + (block[:, 1] if self.b == 2 else 0)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences in ``words`` and the pattern of each."""
        m, b = self.m, self.b
        if len(words) < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # Lanes: positions of a window's last word, each up to its segment's end.
        at = np.arange(m - 1, len(words), _SEGMENT)
        until = np.minimum(at + _SEGMENT, len(words))
        starts, found = [], []
        while len(at):
            code = words[at].astype(np.int64)
            if b == 2:
                code += words[at - 1].astype(np.int64) * self.base
            slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            shift = np.where(self.codes[slot] == code, self.shifts[slot], m - b + 1)
            zero = shift == 0
            if zero.any():
                start, pattern = self.compare(words, at[zero] - m + 1, code[zero])
                starts.append(start)
                found.append(pattern)
                shift[zero] = 1
            at = at + shift
            going = at < until
            if not going.all():
                at, until = at[going], until[going]
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.empty(0, np.int64),) * 2

    def compare(self, words: np.ndarray, start: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefix = words[start].astype(np.int64)
        if self.b == 2:
            prefix = prefix * self.base + words[start + 1]
        rank = np.minimum(np.searchsorted(self.first, prefix), len(self.first) - 1)
        known = self.first[rank] == prefix
        start, code, rank = start[known], code[known], rank[known]
        key = np.searchsorted(self.suffix, code) * len(self.first) + rank
        low, high = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        size = high - low
        start, first = np.repeat(start, size), np.repeat(low, size)
        pattern = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
        same = np.ones(len(start), bool)
        for i in range(self.m):
            same &= words[start + i] == self.patterns[pattern, i]
        return start[same], pattern[same]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split()


class Matcher:
    """All patterns of a block of items, by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(number[name])
        self.searches = [
            WuManber(np.array(list(p), np.int32), [np.array(sorted(o)) for o in p.values()], len(self.vocabulary) + 1)
            for p in by_length.values()
        ]

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, list[str]]]:
        """For each text its number of words, the hit words, the items."""
        out: list = []
        get, ids, sizes = self.vocabulary.get, [], []
        for text in texts:
            words = words_of(text)
            ids.extend([get(w, 0) for w in words])
            ids.append(0)  # no window crosses texts
            sizes.append(len(words))
            if len(ids) >= _BATCH_WORDS:
                out += self._batch(ids, sizes)
                ids, sizes = [], []
        return out + self._batch(ids, sizes)

    def _batch(self, ids: list[int], sizes: list[int]) -> list:
        words = np.array(ids, np.int32)
        first = np.cumsum([0, *[n + 1 for n in sizes]])
        edge = np.zeros(len(words) + 1, np.int32)
        pairs = []
        for search in self.searches:
            start, pattern = search.search(words)
            if not len(start):
                continue
            np.add.at(edge, start, 1)
            np.add.at(edge, start + search.m, -1)
            doc = np.searchsorted(first, start, "right") - 1
            for d, p in set(zip(doc.tolist(), pattern.tolist())):
                pairs.append((d, search.owners[p]))
        hit = np.cumsum(edge) > 0
        items: dict[int, set[int]] = {}
        for d, owners in pairs:
            items.setdefault(d, set()).update(owners.tolist())
        none = np.empty(0, np.int64)
        return [
            (n, np.flatnonzero(hit[a : a + n]) if d in items else none, [self.names[i] for i in items.get(d, ())])
            for d, (n, a) in enumerate(zip(sizes, first.tolist()))
        ]


def _parts(items: DataFrame, block_bytes: int, level: int = 0) -> Iterator[DataFrame]:
    """Parts of distinct items, each measured to fit or a single item."""
    size = (F.sum(F.octet_length("text") + F.octet_length("name") + 64).alias("size"), F.count("*").alias("n"))
    whole = items.agg(*size).first()
    if whole["n"] <= 1 or whole["size"] <= block_bytes:
        yield items
        return
    items = items if level else materialise(items)
    parts = -(-2 * whole["size"] // block_bytes)
    place = F.pmod(F.xxhash64("name", "text", F.lit(level)), F.lit(parts))
    # Two numbers a part.
    for r in items.groupBy(place.alias("part")).agg(*size).orderBy("part").collect():
        part = items.filter(place == r["part"])
        if r["n"] == 1 or r["size"] <= block_bytes:
            yield part
        else:
            yield from _parts(part, block_bytes, level + 1)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items in lists of at most ``block_bytes`` of text (one
    item at least): the table is cut by hash until each part is measured to
    fit, and a part is read when it is its turn."""
    items = benchmark.select(
        F.coalesce(col(item_id).cast("string"), F.lit("null")).alias("name"), F.coalesce(col(text), F.lit("")).alias("text")
    )
    for part in _parts(items.distinct(), block_bytes):
        yield [(r["name"], r["text"].encode()) for r in part.toLocalIterator()]


def _scan_udf(spark, items: list[tuple[str, bytes]], window: int):
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf("n long, hit array<int>, items array<string>")
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, window)
        for batch in texts:
            got = [row for lot in lots(batch) for row in matcher.scan(lot)]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]
            yield pa.StructArray.from_arrays(columns, names=["n", "hit", "items"])

    return scan


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated."""
    found, more = fresh(docs, "_found", "_more")
    out = docs
    for i, items in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        scan = _scan_udf(docs.sparkSession, items, window)(col(text))
        if not i:
            out = out.withColumn(found, scan)
            continue
        # A worker holds the tables of one block: the next scan reads files.
        out = materialise(out).withColumn(more, scan)
        merged = [F.array_union(F.col(found)[c], F.col(more)[c]).alias(c) for c in ("hit", "items")]
        out = out.withColumn(found, F.struct(F.col(found)["n"].alias("n"), *merged)).drop(more)
    f = F.col(found)
    row = F.struct(
        f["n"].alias("n_words"),
        F.size(f["hit"]).cast("long").alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(f["items"])), 256).alias("items_sha256"),
        (F.size(f["hit"]) > 0).alias("contaminated"),
    )
    return with_struct(out, row, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).drop(found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with the columns of ``docs`` only."""
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    judged = decontaminate(plain, benchmark, f"c{names.index(text)}")
    return judged.filter("not contaminated").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '{_CLASS}') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT item, ws, least({WINDOW_WORDS}, len(ws)) AS m, unnest(range(1, len(ws) - least({WINDOW_WORDS}, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)
),
spots AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)
),
hits AS (SELECT doc_id, i, m, item FROM spots JOIN windows USING (m, w)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
