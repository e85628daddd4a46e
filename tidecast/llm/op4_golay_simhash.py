"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, one per bit of the XXH64 hashes of a text's word
shingles. It is cut into three segments, each padded to the 23 bits of the
perfect binary Golay code. Decoding a segment to all codewords within four
bits gives one or six codeword indices, and two segments that differ in two
bits or fewer always share one of them: if they lie in balls of one codeword
this is plain; if not, some weight-7 codeword contains the first's three
error bits and one of the two bits that differ. Pigeonhole: of two wrong
bits, over the cyclic pairs (1,2), (2,3), (3,1) some pair has its first
segment right and at most one wrong bit in its second. The key of a pair is
the first segment's value and one codeword index of the second, 16 keys a
fingerprint on average.

Fingerprints are made distinct before anything is joined, so copies cost
nothing. Pairs come from an equality join on the key and are verified by
their bit distance. A key that many distinct fingerprints share is not
joined: those fingerprints are linked through common neighbours at one
flipped bit (all members of such a ball are within two bits of each other and
every pair within two bits has a common ball), at most 65 rows each and
groups of at most 65. Links become components by alternating large-star and
small-star steps; every step is a Spark job on checkpointed tables and
nothing of the corpus reaches the driver.

Defined cases: null and empty texts have no words and fingerprint zero, and
zero is linked like any other; null doc_ids keep their rows and count for a
component's smallest doc_id only if it has no other; repeated rows share
fingerprint and component; an empty table gives an empty result; extra
columns are ignored by ``components`` and kept by ``one_per_component``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ASCII_LOWER, col, lots, materialise, table

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Distinct fingerprints of one key beyond which ball links replace the join.
JOIN_LIMIT = 64

#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
_WIDTHS = (22, 21, 21)


def simhash(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    import xxhash

    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    hashes = np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())],
        np.uint64,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int = SHINGLE_WORDS):
    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        got = [simhash(t, shingle) for lot in lots(texts) for t in lot]
        return pa.array(np.array(got, np.uint64).view(np.int64))

    return fingerprints


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GENERATOR << (bit - 11))
    return x


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of at most four bits, and how many
    there are (one of weight three or less, five more beside weight three)."""
    patterns = np.array([sum(1 << b for b in c) for k in range(5) for c in combinations(range(23), k)], np.int64)
    syndromes = _syndromes(patterns)
    order = np.argsort(syndromes, kind="stable")
    count = np.bincount(syndromes, minlength=2048)
    table_ = np.zeros((2048, 6), np.int64)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    table_[syndromes[order], nth] = patterns[order]
    return table_, count


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the row that each key belongs to."""
    errors, count = _decoder()
    segments, at = [], 0
    for width in _WIDTHS:
        segments.append(((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    keys, rows = [], []
    for pair, (exact, fuzzy) in enumerate(((0, 1), (1, 2), (2, 0))):
        word = segments[fuzzy]
        syndrome = _syndromes(word)
        row = np.repeat(np.arange(len(word)), count[syndrome])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count[syndrome]) - count[syndrome], count[syndrome])
        # The upper 12 bits of a codeword index it: no two codewords share them.
        index = (word[row] ^ errors[syndrome[row], nth]) >> 11
        keys.append((np.int64(pair) << 36) | (segments[exact][row] << 12) | index)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _emit(df: DataFrame, make, schema: str, names: tuple[str, str]) -> DataFrame:
    """Rows (made value, fingerprint) for every fingerprint in column ``f``."""

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 20000):
                part = f[at : at + 20000]
                made, rows = make(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(made.astype(np.int64)), pa.array(part[rows])], names=list(names))

    return df.select("f").mapInArrow(run, schema)


def _balls(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return (f[:, None] ^ flips).ravel().view(np.int64), np.repeat(np.arange(len(f)), 65)


def links(fingerprints: DataFrame, join_limit: int = JOIN_LIMIT) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints in column ``f`` whose
    transitive closure links all within MAX_BITS bits."""
    keys = _emit(fingerprints, fuzzy_keys, "k bigint, f bigint", ("k", "f"))
    crowded = keys.groupBy("k").count().filter(F.col("count") > 1).withColumn("hot", F.col("count") > join_limit)
    shared = materialise(keys.join(crowded.select("k", "hot"), "k"))
    cold = shared.filter(~F.col("hot")).select("k", "f")
    pairs = (
        cold.select("k", F.col("f").alias("a"))
        .join(cold.select("k", F.col("f").alias("b")), "k")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    hot = shared.filter("hot").select("f").distinct()
    balls = _emit(hot, _balls, "z bigint, f bigint", ("z", "f"))
    stars = (
        balls.groupBy("z")
        .agg(F.collect_list("f").alias("fs"))  # 65 at most
        .filter(F.size("fs") > 1)
        .select(F.array_min("fs").alias("a"), F.explode("fs").alias("b"))
        .filter(F.col("a") < F.col("b"))
    )
    return pairs.union(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest
    node of its component. Large-star and small-star steps until the edges
    form stars; each step is checkpointed."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .filter("u > v")
            .distinct()
        )
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(narrow: DataFrame, join_limit: int) -> DataFrame:
    """(f, first_id, root, component_id) for every distinct fingerprint ``f``
    of ``narrow`` (doc_id, f); ``first_id`` is its smallest doc_id."""
    distinct = materialise(narrow.groupBy("f").agg(F.min("doc_id").alias("first_id")))
    root = connected(links(distinct, join_limit))
    named = distinct.join(root, distinct.f == root.node, "left").select("f", "first_id", F.coalesce("root", "f").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(smallest, "root").select("f", "first_id", "root", "component_id")


def components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, join_limit: int = JOIN_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    narrow = materialise(docs.select(col(doc_id).alias("doc_id"), fingerprint_udf(shingle)(col(text)).alias("f")))
    return narrow.join(_roots(narrow, join_limit), "f").select(
        "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join_limit: int = JOIN_LIMIT) -> DataFrame:
    """The row of each component that has its smallest doc_id, with the
    columns of ``docs``. Of several such rows (repeated doc_ids, components
    without any doc_id) one stays."""
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    id_col, text_col = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    udf = fingerprint_udf()
    narrow = materialise(plain.select(id_col.alias("doc_id"), udf(text_col).alias("f")))
    # The keeper of a component, settled on fingerprints and ids alone: texts
    # are fingerprinted once and move once, to meet the ids that stay.
    stays = (
        _roots(narrow, join_limit)
        .filter(F.col("first_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("first_id").alias("doc_id"), F.min("f").alias("f"))
    )
    repeated = narrow.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("repeated"))
    keepers = materialise(stays.join(repeated, "doc_id", "left").withColumn("shared", F.expr("repeated or doc_id is null")).fillna(False, ["shared"]))
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    sole = keepers.filter("not shared").select("doc_id")
    rows = plain.join(sole, id_col == sole.doc_id, "left_semi").select(*out)
    # An id that several rows share (or none has) does not name a row: among
    # its rows the fingerprint tells which stay, and of equal ones any does.
    shared = keepers.filter("shared").select("doc_id", "f")
    if shared.isEmpty():
        return rows
    ids = shared.filter("doc_id is not null").select("doc_id").distinct()
    candidates = plain.join(ids, id_col == ids.doc_id, "left_semi").union(plain.filter(id_col.isNull())).withColumn("f", udf(text_col))
    met = candidates.join(shared, id_col.eqNullSafe(shared.doc_id) & (candidates.f == shared.f), "left_semi")
    return rows.union(met.dropDuplicates([f"c{names.index(doc_id)}", "f"]).select(*out))


def query(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
