"""Sharding by extendible hashing.

A document's address is the bit string of a 60-bit hash of its doc_id and
text. A shard is a bucket of all addresses with one prefix; a bucket over the
byte limit, and no other, is split on the next bit until every shard fits. The
directory is indexed by a longer prefix, several entries per shard: one grouped
sum over the documents gives the bytes of the fine prefixes, sums over those
give every shorter prefix, and an entry points to the shortest prefix that
fits. Where a fine prefix is still too large, the next level of the directory
indexes eight bits more for its documents alone.

Rows with one address (identical rows) are split too: if together they are
over the limit, 60 more bits are drawn from their row numbers. A single
document over the limit is a shard of its own.

Defined cases: null doc_ids and null texts count as empty; an empty table
gives an empty result; input columns named like a result column give way to
it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import col, materialise, table

#: Text bytes of a shard.
SHARD_BYTES = 128 << 20
#: Text bytes of a shard in the registered query and its SQL.
QUERY_BYTES = 2 << 20
#: Directory rows up to which a level is sent to every task.
BROADCAST_ROWS = 100_000
_BITS = 60
_STEP = 8
_RESULT = ["shard", "n_bytes", "shard_bytes", "shard_docs"]


def address(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.lpad(F.bin(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")), _BITS, "0")


def _level(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Directory entries (prefix of ``high`` bits, shard and its size) and
    the prefixes that are still too large."""
    fine = materialise(
        rows.groupBy(F.substring("bits", 1, high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    )
    each = fine.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("q", F.expr("substring(p, 1, d)"))
    sums = each.groupBy("d", "q").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    entries = materialise(
        each.select("p", "d", "q").join(fits, ["d", "q"]).groupBy("p").agg(F.min(F.struct("d", "q", "shard_bytes", "shard_docs")).alias("s"))
    )
    return entries, materialise(fine.join(entries, "p", "left_anti").select("p"))


def shards(
    docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with shard (its prefix, as 0b...), n_bytes, shard_bytes and
    shard_docs."""
    names = [c for c in docs.columns if c.lower() not in _RESULT]
    keyed = docs.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(names)],
        address(col(doc_id), col(text)).alias("bits"),
        F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(_BITS, 4 + max(0, math.ceil(math.log2(max(1, total) / limit))))
    rows, levels, end = keyed, [], _BITS
    while True:
        entries, over = _level(rows, low, high, limit)
        levels.append((high, entries))
        if over.isEmpty():
            break
        if high == end:
            # Identical rows: longer addresses from their row numbers, written
            # with the rows so that every later step sees the same ones.
            more = F.lpad(F.bin(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << _BITS) - 1)), _BITS, "0")
            end += _BITS
            keyed = materialise(keyed.withColumn("bits", F.concat("bits", more)))
        rows = keyed.join(over, F.substring(keyed.bits, 1, high) == over.p, "left_semi")
        low, high = high + 1, min(end, high + _STEP)
    out = keyed
    for i, (depth, entries) in enumerate(levels):
        small = entries.count() <= BROADCAST_ROWS
        entries = entries.select(F.col("p").alias(f"p{i}"), F.col("s").alias(f"s{i}"))
        how = F.broadcast(entries) if small else entries
        out = out.join(how, F.substring("bits", 1, depth) == F.col(f"p{i}"), "left")
    out = out.withColumn("s", F.coalesce(*[F.col(f"s{i}") for i in range(len(levels))]))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.concat(F.lit("0b"), F.col("s.q")).alias("shard"),
        "n_bytes",
        F.col("s.shard_bytes").alias("shard_bytes"),
        F.col("s.shard_docs").alias("shard_docs"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard's documents meet in one task, which its
    byte limit bounds."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_BYTES).drop("text")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, ''))[1:15])::BIGINT), {_BITS}, '0') AS bits
  FROM documents
),
prefixes AS (SELECT doc_id, n_bytes, d, left(bits, d) AS q FROM d, range(0, {_BITS + 1}) AS t(d)),
sums AS (SELECT d, q, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM prefixes GROUP BY d, q),
fits AS (SELECT * FROM sums WHERE shard_bytes <= {QUERY_BYTES} OR shard_docs = 1)
SELECT doc_id, '0b' || q AS shard, n_bytes, shard_bytes, shard_docs
FROM prefixes JOIN fits USING (d, q)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""
