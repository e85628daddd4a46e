"""The pipeline against a brute-force version, awkward rows through every
stage, and the SQL twins at the smallest scale."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_output_operators import naive_targets
from tests.llm.test_text_operators import AWKWARD, WORDS, naive_components, naive_fingerprint, naive_hits, naive_rules, prose
from tidecast.llm import op10_extendible_shards as op10
from tidecast.llm import queries


def naive_pipeline(docs, items):
    """Rows (doc_id, source, text) left after the first three stages."""
    left = [d for d in docs if naive_rules(d[2])[6]]
    groups = naive_components([(d[0], naive_fingerprint(d[2])) for d in left], lambda x: x[1])
    left = [d for d, g in zip(left, groups) if d[0] == g]
    return [d for d in left if not naive_hits(d[2], items)[4]]


def test_pipeline_matches_brute_force(spark, sf_small):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    want = naive_pipeline(docs, items)
    out = corpus_pipeline.run(spark, sf_small)
    rows = out.collect()
    size = {d[0]: len(WORDS.findall(d[2])) for d in want}
    by_source, taken = Counter(), Counter()
    for d in want:
        by_source[d[1]] += size[d[0]]
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    for r in rows:
        taken[r["source"]] += size[r["doc_id"]]
    for s, target in naive_targets(by_source).items():
        assert abs(taken[s] - target) <= max(0.1 * target, max(v for d, v in size.items()) / 4), (s, taken[s], target)
    bytes_of = Counter()
    for r in rows:
        bytes_of[r["shard"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == bytes_of[r["shard"]] <= op10.SHARD_BYTES for r in rows)
    assert {c for c in spark.read.parquet(f"{sf_small}/documents.parquet").columns} <= set(out.columns)


def test_stages_take_awkward_rows_and_empty_tables(spark, docs_of, sf_small):
    rng = random.Random(1)
    docs = docs_of([*AWKWARD, *[(50 + i, prose(rng, 60), rng.choice([None, "a", "b"])) for i in range(20)]])
    docs = docs.withColumn("size", F.lit(1)).withColumn("copies", F.lit(None).cast("string")).withColumn("f", F.lit(2.0))
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_small)
        assert out.count() > 0, name
        assert out.columns == names or i == len(corpus_pipeline.STAGES) - 1, name
        assert stage(spark, docs.limit(0), sf_small).count() == 0, name


def test_stage_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_small)
    want = con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(map(str, want.project(", ".join(columns)).fetchall()))
