"""Mixing sources to target weights by entropy balancing (DataFrame only).

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; no target exceeds twice its source's words, the
excess goes to the others by weight (water filling, in closed form).

Rates: a document of s words in a source of mean m is taken at the rate
r = min(2, exp(l * sqrt(s / m))), the solution of the entropy problem with
base measure sqrt(s * m) and the source's token constraint; l is found by
Newton steps on the convex dual. Documents of one size in one source have one
rate, so the steps run on the table of (source, size) cells with their counts,
pre-aggregated once: every step is a grouped sum over cells for all sources at
a time, kept inside a bracket by bisection, checkpointed.

Copies: within a source, documents in order of size (and of their hash) get
floor(c + r) - floor(c) copies at the running rate c, so a source's words are
off by less than its largest document; a few cells then give or take one copy
where that brings the source closer to its target. Running rates come from
sums over cells and over hash buckets inside a cell, so no window ever holds
more than the distinct sizes of a source or a bucket of documents: a source or
a size with a third of all rows is no hot spot. All of it is deterministic.

Defined cases: null and empty texts have size 0 (kept once; twice in a source
at its cap); null sources form one source, last in order; repeated rows are
separate documents; an empty table gives an empty result; input columns named
like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import col, materialise, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents that a hash bucket of a cell holds at the most, about.
BUCKET_ROWS = 20_000
#: Rows up to which the table of sources is sent to every task.
BROADCAST_ROWS = 50_000
CORRECTIONS = 6

_RESULT = ["size", "source_size", "target", "rate", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(rank, source, docs, positive, least, source_size, target) from the
    (source, docs, positive, least, source_size) table of sources."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = float(MOST_COPIES) * F.col("source_size")
    by = Window.orderBy("limit", "rank")
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("limit", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the sources before this one at their caps, the level of the rest:
    # right from the first source on whose own limit is not below it.
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(capped), F.lit(0.0))) / F.sum("weight").over(rest)
    out = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("limit", F.col("cap") / F.col("weight"))
    out = out.withColumn("at", F.when(level <= F.col("limit"), level))
    out = out.withColumn("level", F.first("at", ignorenulls=True).over(whole))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return out.withColumn("target", target).drop("weight", "cap", "limit", "at", "level")


def _rate(lam: Column, z: Column) -> Column:
    return F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(F.least(F.lit(float(MOST_COPIES)), F.exp(lam * z)))


def solve(cells: DataFrame, sources: DataFrame, steps: int = 80) -> DataFrame:
    """``sources`` with the tilt ``lam`` that meets each token constraint."""
    log_most = F.log(F.lit(float(MOST_COPIES)))
    z = F.sqrt(F.col("size") / F.col("mean"))
    ratio = F.try_divide("target", "source_size")
    state = sources.withColumn("mean", F.greatest(F.try_divide("source_size", "positive"), F.lit(1.0)))
    state = state.withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    least_z = F.sqrt(F.greatest(F.coalesce("least", F.lit(1)), F.lit(1)) / F.col("mean"))
    state = (
        state.withColumn("full", F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - 1e-12))
        .withColumn("lam", F.lit(0.0))
        .withColumn("low", F.when(ratio < 1, F.log(ratio) / least_z).otherwise(F.lit(0.0)))
        .withColumn("high", F.when(ratio < 1, F.lit(0.0)).otherwise(log_most / least_z))
        .withColumn("done", F.col("full") | (F.col("source_size") == 0))
    )
    state = materialise(state)
    for _ in range(steps):
        if state.filter(~F.col("done")).isEmpty():
            break
        tilt = F.exp(F.col("lam") * z)
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(F.broadcast(state.filter(~F.col("done"))) if _small(state) else state.filter(~F.col("done")), "rank")
            .groupBy("rank")
            .agg(
                F.sum(words * F.least(F.lit(float(MOST_COPIES)), tilt)).alias("taken"),
                F.sum(F.when(tilt < MOST_COPIES, words * z * tilt).otherwise(F.lit(0.0))).alias("slope"),
            )
        )
        gap = F.col("taken") - F.col("target")
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        near = F.coalesce(F.abs(gap) <= 1e-9 * F.col("target") + 1e-6, F.lit(True)) | (high - low < 1e-13)
        moved = F.when(F.col("done") | near, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        state = materialise(
            state.join(sums, "rank", "left").select(
                *[c for c in state.columns if c not in ("lam", "low", "high", "done")],
                moved.alias("lam"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | near).alias("done"),
            )
        )
    # Sums of doubles may differ in their last bits between runs.
    return state.withColumn("lam", F.round("lam", 9)).drop("low", "high", "done")


def _small(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _correct(cells: DataFrame, state: DataFrame) -> DataFrame:
    """``cells`` with ``extra``: a copy more or less of a cell's first
    document, chosen so that each source comes closer to its target."""
    last = F.floor(F.col("base") + F.col("n") * F.col("rate") + 0.5) - F.floor(F.col("base") + 0.5)
    cells = cells.withColumn("extra", F.lit(0)).withColumn(
        "head", F.floor(F.col("base") + F.col("rate") + 0.5) - F.floor(F.col("base") + 0.5)
    )
    cells = materialise(cells)
    off = cells.groupBy("rank").agg(F.sum(last * F.col("size")).alias("taken")).join(state.select("rank", "target"), "rank")
    off = materialise(off.select("rank", (F.col("taken") - F.col("target")).alias("off")))
    for _ in range(CORRECTIONS):
        size, gap = F.col("size"), F.col("off")
        fits = (F.col("extra") == 0) & (size > 0) & (size < 2 * F.abs(gap)) & F.when(gap < 0, F.col("head") < MOST_COPIES).otherwise(F.col("head") > 0)
        picked = (
            cells.join(off, "rank").filter(fits).groupBy("rank").agg(F.min(F.struct(F.abs(size - F.abs(gap)).alias("d"), size)).alias("p"))
        ).join(off, "rank")
        picked = materialise(picked.select("rank", F.col("p.size").alias("size"), F.when(gap < 0, 1).otherwise(-1).alias("change")))
        if picked.isEmpty():
            break
        cells = materialise(
            cells.join(picked, ["rank", "size"], "left")
            .withColumn("extra", F.col("extra") + F.coalesce("change", F.lit(0)))
            .drop("change")
        )
        off = materialise(
            off.join(picked, "rank", "left").select("rank", (F.col("off") + F.coalesce(F.col("size") * F.col("change"), F.lit(0))).alias("off"))
        )
    return cells


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", size: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE
) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken."""
    names = [c for c in docs.columns if c.lower() not in _RESULT]
    plain = docs.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(names)],
        col(source).alias("source"),
        (word_count(col(text)) if size is None else size.cast("long")).alias("size"),
    )
    by_size = materialise(plain.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = targets(
        by_size.groupBy("source").agg(
            F.sum("n").alias("docs"),
            F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("positive"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
            F.sum(F.col("n") * F.col("size")).alias("source_size"),
        ),
        weights,
        share,
    )
    sources = materialise(sources)
    small = _small(sources)

    def ranked(df: DataFrame) -> DataFrame:
        s = sources.select("rank", F.col("source").alias("key"))
        return df.join(F.broadcast(s) if small else s, F.col("source").eqNullSafe(F.col("key"))).drop("source", "key")

    cells = materialise(ranked(by_size))
    state = solve(cells, sources)
    of_source = state.select("rank", "source_size", "target", "mean", "full", "lam")
    rate = _rate(F.col("lam"), F.sqrt(F.col("size") / F.col("mean")))
    cells = cells.join(F.broadcast(of_source) if small else of_source, "rank").withColumn("rate", rate)
    before = Window.partitionBy("rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))
    cells = _correct(cells.drop("mean", "full", "lam"), state)

    total = sources.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = ranked(plain.withColumn("h", F.xxhash64(*plain.columns)).withColumn("bucket", F.pmod("h", F.lit(buckets))))
    key = ["rank", "size", "bucket"]
    earlier = Window.partitionBy("rank", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("k"))
    counts = counts.withColumn("skip", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k").join(cells, ["rank", "size"])
    place = F.col("skip") + F.row_number().over(Window.partitionBy(*key).orderBy("h")) - 1
    at = F.col("base") + F.col("place") * F.col("rate") + 0.5
    copies = F.floor(at + F.col("rate")) - F.floor(at) + F.when(F.col("place") == 0, F.col("extra")).otherwise(0)
    return (
        rows.join(counts, key)
        .withColumn("place", place)
        .withColumn("copies", copies.cast("int"))
        .select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
            "size",
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"d{i}") for i, c in enumerate(names)])
    taken = mix(plain, f"d{names.index(source)}", f"d{names.index(text)}").filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"d{i}").alias(c) for i, c in enumerate(names)]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(materialise(docs), size=F.col("words")).drop("words", "source")
