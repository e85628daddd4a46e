"""Cross-tokenizer alignment with an identity-map fast path.

A text is encoded by tokenizer A (byte-level BPE) and by tokenizer B
(SentencePiece). Byte offsets at which tokens of both end cut the two
sequences into groups; tokens of a group are linked. An array made once maps
each A id to the B id with the same bytes. A group of one token each that this
map names is counted in a vector over A's vocabulary, one per task; only the
pairs of the other, irregular groups are shuffled, and these summed up before:
a lot of texts (about a megabyte) is encoded in one task, where the number of
documents that hold a pair is counted, so one row a lot and pair goes out.

Pass 1 (``encode``) writes a row a lot to the shared folder: per document the
digest columns and which chunks of text it consists of, per chunk its links.
``pair_counts`` sums the vectors and the lots' pairs into corpus-wide document
counts. Pass 2 (``documents``) sends each lot the counts of its own irregular
pairs (a join of lots' pairs with counts; a pair occurs once a lot, so no key
is hotter than the number of lots) and adds them up per document. Counts of
identity pairs are a vector of A's vocabulary, the only thing that is broadcast.

Chunks: neither tokenizer merges across a space that stands between other
characters, if A splits as byte-level BPE does and no piece of B has a space
after another character, which is looked up. Encodings and links of chunks
are kept in a bounded table; a text with other white space after a space is
one chunk of its own.

Links inside a group are counted by distinct ids with multiplicities, so long
groups of few different ids (a row of one letter) stay small.

Defined cases: null and empty texts, and texts whose tokens' bytes are not a
space and the text (B writes U+2581 as a space), have no tokens: zeros and an
empty hash; a document is a row, so repeated rows count as several documents
and a null doc_id stays; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import col, lots, materialise, table

#: Bytes of text in a lot, as far as whole texts allow.
LOT_BYTES = 1 << 20
#: Chunks and tokens that a worker's table keeps.
TABLE_CHUNKS, TABLE_TOKENS = 200_000, 4_000_000
#: Groups with more links than this are counted by distinct ids.
_WIDE = 4096
#: Chunks learned at a time.
_LEARN = 1000

LOTS = (
    "lot long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<long>, sha array<string>, "
    "pairs array<long>, n_docs array<long>, chunks binary, chunk_sizes binary, links binary, times binary, links_sizes binary, ones binary, ones_sizes binary"
)
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_bytes(tokens: list[str]) -> list[bytes]:
    """Bytes of byte-level BPE entries. The usual alphabet: printable Latin-1
    characters stand for themselves, the other bytes, in order, for the
    characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in own}
    of.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))})
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]


def piece_bytes(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        out.append(bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return out


def _expand(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that lie one after the other and end at ``ends``: positions
    of the elements of lists ``rows``, and the place in ``rows`` of each."""
    high = ends[rows]
    n = high - np.where(rows > 0, ends[rows - 1], 0)
    at = np.cumsum(n)
    which = np.repeat(np.arange(len(rows)), n)
    return np.arange(at[-1] if len(at) else 0) - np.repeat(at - n, n) + np.repeat(high - n, n), which


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive lists that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


class Vocabularies:
    """Both tokenizers, their entries' bytes and the identity map."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = byte_level_bytes([self.a.id_to_token(i) for i in range(self.a.get_vocab_size())])
        self.b_bytes = piece_bytes(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_leads, self.b_leads = (np.array([x[:1] == b" " for x in y], bool) for y in (self.a_bytes, self.b_bytes))
        # Of ids with the same bytes the ordinary piece, not the byte's.
        same = {x: i for plain in (False, True) for i, x in enumerate(self.b_bytes) if self.b.is_byte(i) != plain}
        self.identity = np.array([same.get(x, -1) for x in self.a_bytes], np.int64)
        pre = self.a.pre_tokenizer
        self.by_chunk = (
            type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.a.normalizer is None
            and not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        )


class _Numbers(dict):
    """Numbers of chunks in order of first sight; ``new`` has the unread ones."""

    def __init__(self) -> None:
        self.next, self.new = 0, []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = self.next
        self.next += 1
        self.new.append(chunk)
        return number


class Links:
    """Links of chunks (or whole texts), appended one after the other."""

    def __init__(self, v: Vocabularies) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        zero = np.zeros(0, np.int64)
        self.good, self.lots = np.zeros(0, bool), np.zeros(0, np.int32)
        #: Per chunk: A tokens, B tokens, groups, links, ends of its one-to-one ids and of its irregular pairs.
        self.counts = np.zeros((4, 0), np.int64)
        self.ones, self.ones_ends = zero, zero
        self.pairs, self.times, self.pairs_ends = zero, zero, zero
        self.strings: list[str] = []

    def compact(self) -> None:
        """Keep only chunks that several lots had, the most frequent first, up
        to half the table; whole texts go."""
        number = np.fromiter(self.known.values(), np.int64, len(self.known))
        chunks = list(self.known)
        rank = np.argsort(-self.lots[number], kind="stable")[: TABLE_CHUNKS // 2]
        rank = rank[self.lots[number[rank]] > 1]
        kept = number[rank]
        self.known = _Numbers()
        for i in rank.tolist():
            self.known[chunks[i]]
        self.known.new = []
        for name, ends in (("ones", "ones_ends"), ("pairs", "pairs_ends"), ("times", "pairs_ends")):
            at, _ = _expand(getattr(self, ends), kept)
            setattr(self, name, getattr(self, name)[at])
        for ends in ("ones_ends", "pairs_ends"):
            size = np.diff(getattr(self, ends), prepend=0)
            setattr(self, ends, np.cumsum(size[kept]))
        self.good, self.counts, self.lots = self.good[kept], self.counts[:, kept], np.zeros(len(kept), np.int32)
        self.strings = [self.strings[i] for i in kept.tolist()]
        if len(self.ones) + len(self.pairs) > TABLE_TOKENS // 2:
            self.forget()

    def add(self, texts: list[str], whole: bool) -> None:
        """Chunks or whole texts, each encoded behind a space; not good where
        bytes differ or a chunk opens with white space."""
        if not whole and self._joined(texts):
            return
        v = self.v
        sure = [t if whole or t and not t[0].isspace() and t[0] != "\u180e" else "" for t in texts]
        a = [e.ids for e in v.a.encode_batch_fast([" " + t for t in sure], add_special_tokens=False)]
        b = v.b.encode(sure, num_threads=1)
        good = []
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            fits = b"".join(map(v.a_bytes.__getitem__, a[i])) == want == b"".join(map(v.b_bytes.__getitem__, b[i]))
            good.append(fits)
            if not fits:
                a[i], b[i] = [], []
        sizes = [np.array([len(x) for x in ids], np.int64) for ids in (a, b)]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in zip((a, b), sizes)]
        self._append(np.array(good, bool), *sizes, *ids)

    def _joined(self, chunks: list[str]) -> bool:
        """Chunks encoded in one go, joined by spaces, and cut where a token
        opens with a space; False, and nothing done, if that is not exact."""
        if any(not c or c[0].isspace() or c[0] == "\u180e" for c in chunks):
            return False
        v, text = self.v, " ".join(chunks)
        want = (" " + text).encode()
        sizes, ids = [], []
        for got, entries, leads in (
            (v.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, v.a_bytes, v.a_leads),
            (v.b.encode(text, num_threads=1), v.b_bytes, v.b_leads),
        ):
            if b"".join(map(entries.__getitem__, got)) != want:
                return False
            ids.append(np.array(got, np.int64))
            first = np.flatnonzero(leads[ids[-1]])
            if len(first) != len(chunks):
                return False
            sizes.append(np.diff(np.append(first, len(got))))
        self._append(np.ones(len(chunks), bool), *sizes, *ids)
        return True

    def _append(self, good: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        v, n = self.v, len(good)
        end_a, end_b = np.cumsum(v.a_size[ia]), np.cumsum(v.b_size[ib])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        wa, wb = (np.bincount(g, minlength=len(cuts)) for g in (ga, gb))
        first_a, first_b = np.cumsum(wa) - wa, np.cumsum(wb) - wb
        chunk = np.repeat(np.arange(n), n_a)[first_a] if len(cuts) else np.zeros(0, np.int64)
        one = (wa == 1) & (wb == 1)
        one[one] = v.identity[ia[first_a[one]]] == ib[first_b[one]]
        links = np.bincount(chunk, weights=wa * wb, minlength=n).astype(np.int64)
        keys, times = self._irregular(np.flatnonzero(~one), chunk, ia, ib, wa, wb, first_a, first_b)
        n_pairs = len(v.a_size) * len(v.b_size)
        self.good = np.concatenate([self.good, good])
        self.lots = np.concatenate([self.lots, np.zeros(n, np.int32)])
        self.counts = np.hstack([self.counts, [n_a, n_b, np.bincount(chunk, minlength=n), links]])
        self.ones_ends = np.concatenate([self.ones_ends, len(self.ones) + np.cumsum(np.bincount(chunk[one], minlength=n))])
        self.ones = np.concatenate([self.ones, ia[first_a[one]]])
        self.pairs_ends = np.concatenate([self.pairs_ends, len(self.pairs) + np.cumsum(np.bincount(keys // n_pairs, minlength=n))])
        self.pairs = np.concatenate([self.pairs, keys % n_pairs])
        self.times = np.concatenate([self.times, times])
        self.strings += self._texts(n, n_a, ia, ib, ga, gb, chunk)

    def _irregular(self, groups, chunk, ia, ib, wa, wb, first_a, first_b) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (chunk, pair) keys of groups, in order, and how often each is linked."""
        n_b = len(self.v.b_size)
        base = len(self.v.a_size) * n_b
        wide = wa[groups] * wb[groups] > _WIDE
        keys, times = [], []
        g = groups[~wide]
        size = wa[g] * wb[g]
        which = np.repeat(np.arange(len(g)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        x, y = np.divmod(k, wb[g][which])
        keys.append(chunk[g][which] * base + ia[first_a[g][which] + x] * n_b + ib[first_b[g][which] + y])
        times.append(np.ones(len(which), np.int64))
        for i in groups[wide].tolist():
            a, na = np.unique(ia[first_a[i] : first_a[i] + wa[i]], return_counts=True)
            b, nb = np.unique(ib[first_b[i] : first_b[i] + wb[i]], return_counts=True)
            keys.append(chunk[i] * base + (a[:, None] * n_b + b).ravel())
            times.append((na[:, None] * nb).ravel())
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return found, total

    @staticmethod
    def _texts(n: int, n_a, ia, ib, ga, gb, chunk) -> list[str]:
        """``a1,a2|b1;...`` of every chunk, by one pass over all tokens."""
        side = np.concatenate([2 * ga, 2 * gb + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([ia, ib])[order]
        # A token is followed by "," inside its side, "|" before B's, ";" before the next group, "\n" before the next chunk.
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        of = chunk[side // 2]
        mark = np.where(~last, 0, np.where(side % 2 == 0, 1, np.where(np.append(of[1:] == of[:-1], False) if len(of) else False, 2, 3)))
        marks = (",", "|", ";", "\n")
        text = "".join([f"{i}{marks[m]}" for i, m in zip(ids.tolist(), mark.tolist())])
        full = iter(text.split("\n"))
        return [next(full) if k else "" for k in n_a.tolist()]

    def lot(self, texts: list[str]) -> list[list[int]]:
        """Numbers of each text's chunks; none for texts without tokens."""
        if len(self.strings) > TABLE_CHUNKS or len(self.ones) + len(self.pairs) > TABLE_TOKENS:
            self.compact()
        known = self.known
        if self.v.by_chunk:
            numbers = [list(map(known.__getitem__, t.split(" "))) if t else [] for t in texts]
            while known.new:
                part, known.new = known.new[:_LEARN], known.new[_LEARN:]
                self.add(part, whole=False)
            flat = np.fromiter(chain.from_iterable(numbers), np.int64)
            bad = _sums(~self.good[flat], np.cumsum([len(n) for n in numbers])) > 0
        else:
            numbers = [[] for _ in texts]
            bad = np.array([t != "" for t in texts], bool)
        for i in np.flatnonzero(bad).tolist():
            self.add([texts[i]], whole=True)
            numbers[i] = [known.next] if self.good[known.next] else []
            known.next += 1
        return numbers

    def row(self, lot: int, ids: list, texts: list[str], vector: np.ndarray) -> dict:
        """A lot's row of ``LOTS``; its one-to-one ids are counted in ``vector``."""
        v, n_a, n_b = self.v, len(self.v.a_size), len(self.v.b_size)
        numbers = self.lot(texts)
        sizes = np.array([len(n) for n in numbers], np.int64)
        ends = np.cumsum(sizes)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, ends[-1])
        used, local = np.unique(flat, return_inverse=True)
        self.lots[used] += 1
        # Documents that hold an id or a pair: chunks count once a document.
        seen = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(used)) + local)
        doc, chunk = (seen // len(used), used[seen % len(used)]) if len(seen) else (seen, seen)
        at, of = _expand(self.ones_ends, chunk)
        ones = np.unique(doc[of] * n_a + self.ones[at])
        vector += np.bincount(ones % n_a, minlength=n_a)
        at, of = _expand(self.pairs_ends, chunk)
        held = np.unique(doc[of] * (n_a * n_b) + self.pairs[at])
        which, pair = np.divmod(held, n_a * n_b)
        a, b = np.divmod(pair, n_b)
        counted = (v.identity[a] == b) & np.isin(which * n_a + a, ones)
        pairs, place = np.unique(pair, return_inverse=True)
        sums = [_sums(c[flat], ends).tolist() for c in self.counts]
        at, of = _expand(self.pairs_ends, used)
        one_at, one_of = _expand(self.ones_ends, used)
        return {
            "lot": lot,
            "doc_id": ids,
            **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)),
            "sha": [hashlib.sha256(";".join(map(self.strings.__getitem__, n)).encode()).hexdigest() if n else "" for n in numbers],
            "pairs": pairs,
            "n_docs": np.bincount(place[~counted], minlength=len(pairs)),
            "chunks": _packed(local),
            "chunk_sizes": _packed(sizes),
            "links": _packed(np.searchsorted(pairs, self.pairs[at])),
            "times": _packed(self.times[at]),
            "links_sizes": _packed(np.bincount(of, minlength=len(used))),
            "ones": _packed(self.ones[one_at]),
            "ones_sizes": _packed(np.bincount(one_of, minlength=len(used))),
        }


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest asks for; the
    first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or values.max() < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _arrow_type(kind: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


_LOT_FIELDS = [(f.split()[0], _arrow_type(f.split()[1])) for f in LOTS.split(", ")]


def _lot_batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in _LOT_FIELDS], names=[n for n, _ in _LOT_FIELDS])


def encode(docs: DataFrame, folder: str, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", lot_bytes: int = LOT_BYTES) -> None:
    """Pass 1: lots of ``docs`` and, with a null lot, the vector of each task,
    as Parquet in ``folder``, which all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        links = vector = None
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            if links is None:
                links = Links(Vocabularies(a_path, b_path))
                vector = np.zeros(len(links.v.a_size), np.int64)
            at = 0
            for part in lots(batch.column(1)):
                for i, t in zip(batch.column(0).slice(at, len(part)).to_pylist(), part):
                    ids.append(i)
                    texts.append(t.decode())
                    size += len(t) + 64
                    if size >= lot_bytes:
                        yield _lot_batch(links.row(number, ids, texts, vector))
                        ids, texts, size, number = [], [], 0, number + 1
                at += len(part)
        if ids:
            yield _lot_batch(links.row(number, ids, texts, vector))
        if links is not None and vector.any():
            a = np.flatnonzero(vector)
            yield _lot_batch({"pairs": a * len(links.v.b_size) + links.v.identity[a], "n_docs": vector[a]})

    docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(run, LOTS).write.option("compression", "zstd").parquet(folder)


def pair_counts(spark: SparkSession, folder: str, n_b: int) -> DataFrame:
    """Documents of the corpus that hold a pair linked: pair (A id times
    ``n_b`` plus B id), n_docs, one (a pair of the identity map, met one to
    one), best (no pair of its A id has more)."""
    held = spark.read.schema(LOTS).parquet(folder).select("lot", F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
    rows = held.select("lot", F.col("p.pairs").alias("pair"), F.col("p.n_docs").cast("long").alias("n"))
    vector = rows.filter("lot is null").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("one", F.lit(True))
    irregular = rows.filter("lot is not null").select("pair", "n", F.lit(False).alias("one"))
    counts = irregular.unionByName(vector).groupBy("pair").agg(F.sum("n").alias("n_docs"), F.max("one").alias("one"))
    a = F.expr(f"pair div {n_b}")
    # One row an A id: bounded by A's vocabulary.
    top = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n_docs", "one", (F.col("n_docs") == F.col("top")).alias("best"))


def documents(spark: SparkSession, folder: str, counts: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Pass 2: a row of ``DOCUMENT`` for each document of pass 1."""
    # At most one row an id of A.
    ones = counts.filter("one").select(F.expr(f"int(pair div {n_b})"), "n_docs", "best").toArrow()
    table_ = np.zeros((2, n_a), np.int64)
    where = ones.column(0).to_numpy()
    table_[0, where], table_[1, where] = ones.column(1).to_numpy(), ones.column(2).to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast(table_)
    stored = spark.read.schema(LOTS).parquet(folder).filter("lot is not null")
    wanted = stored.select(F.col("lot").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    found = wanted.join(counts.select("pair", "n_docs", "best"), "pair").groupBy("of").agg(F.collect_list(F.struct("at", "n_docs", "best")).alias("found"))
    rest = stored.drop("pairs", "n_docs")
    both = rest.join(found, F.col("lot") == F.col("of"), "left").select(
        *rest.columns, F.col("found.at").alias("at"), F.col("found.n_docs").alias("n_docs"), F.col("found.best").cast("array<int>").alias("best")
    )
    names = [f.split()[0] for f in DOCUMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                chunks, sizes, place, times, links_sizes, one, ones_sizes = (
                    _unpacked(row[n].as_py()) for n in ("chunks", "chunk_sizes", "links", "times", "links_sizes", "ones", "ones_sizes")
                )
                value = np.zeros((2, place.max() + 1 if len(place) else 1), np.int64)
                if row["at"].is_valid:
                    at = row["at"].values.to_numpy()
                    value[0, at], value[1, at] = row["n_docs"].values.to_numpy(), row["best"].values.to_numpy()
                sums = []
                for k in range(2):
                    by_chunk = _sums(value[k, place] * times, np.cumsum(links_sizes)) + _sums(ones[k, one], np.cumsum(ones_sizes))
                    sums.append(pa.array(_sums(by_chunk[chunks], np.cumsum(sizes))))
                counts = [row[n].values.cast(pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([row["doc_id"].values, *counts, sums[1], sums[0], row["sha"].values], names=names)

    return both.mapInArrow(run, DOCUMENT)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", lot_bytes: int = LOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``docs`` with their document counts, as (a_id, b_id,
    n_docs, best), and a row of ``DOCUMENT`` for each row of ``docs``."""
    from tidecast.session import scratch_path

    spark = docs.sparkSession
    v = Vocabularies(a_path, b_path)
    n_a, n_b = len(v.a_size), len(v.b_size)
    folder = scratch_path(spark, "alignment-lots")
    encode(docs, folder, a_path, b_path, doc_id, text, lot_bytes)
    counts = materialise(pair_counts(spark, folder, n_b))
    pairs = counts.select(F.expr(f"pair div {n_b}").alias("a_id"), F.expr(f"pair % {n_b}").alias("b_id"), "n_docs", "best")
    return pairs, documents(spark, folder, counts, n_a, n_b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(table(spark, sf_dir, "documents"), *paths)[1]
