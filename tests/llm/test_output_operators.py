"""Token records, chat masks, mixing, shards, urls, co-training."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecast.llm import op1_cotraining as op1
from tidecast.llm import op2_token_records as op2
from tidecast.llm import op5_url_filter as op5
from tidecast.llm import op7_entropy_mix as op7
from tidecast.llm import op8_chat_masks as op8
from tidecast.llm import op10_extendible_shards as op10
from tidecast.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b \n c", "Grüße 日本 🙂", "x" * 20000, "one two one two " * 300, "tail space ", "\ttab", "a\u00a0 b", "it's \n\n ok\r\n"]


def test_chunked_encoding_equals_whole_encoding():
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", " 's", "é", "1", "!", "<|endoftext|>", " ", "日本", "\r\n", "x y", "\x1c", "...", " -"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    tokenizer, encoder = Tokenizer.from_file(PATH), op2.Encoder(PATH, cache_chunks=200)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        got = [np.frombuffer(e, encoder.dtype).tolist() for e in encoder.encode(part)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_records_round_trip_in_any_order(docs_of, spark):
    rows = [(i * 7 % 11 if i else None, t) for i, t in enumerate(TEXTS)]
    folder = scratch_path(spark, "test-records")
    op2.write_records(docs_of(rows), folder, PATH)
    index = op2.read_index(spark, folder)
    ids = {r["doc_id"]: r for r in op2.read_records(index.orderBy(F.rand(3)), folder).collect()}
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (ids[doc_id]["start"], bytes(ids[doc_id]["ids"])) == (start, want)
        start += len(want) // 4
    one = op2.read_records(index.filter("doc_id = 5"), folder).select(F.crc32("ids")).first()[0]
    assert one == zlib.crc32(bytes(ids[5]["ids"]))
    empty = scratch_path(spark, "test-no-records")
    op2.write_records(docs_of(rows).limit(0), empty, PATH)
    assert op2.read_records(op2.read_index(spark, empty), empty).count() == 0


def test_damaged_records_are_noticed():
    record = op2.frame(b"\x02\x01\x00")
    assert op2.unframe(record) == b"\x02\x01\x00"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            op2.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def test_chats_round_trip(spark):
    rng = random.Random(4)
    bits = [*op8.CONTROLS, "\\", "[", "<", "INST]", "ok", " ", "\n", "é", "\\/s>", "[\\INST]", "<\\\\/s>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", None), ("assistant", ""), (None, "x"), ("tool[INST]", "</s>"), ("assistant", "[")])]
    rows += [(1, 5, "assistant", "\\INST]"), (None, 0, "assistant", "null id"), (2, None, "system", "z" * 30000)]
    for c in range(10, 40):
        rows += [(c, t, rng.choice(["user", "assistant", "system", "a\\[ROLE]"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for t in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = op8.format_chats(op8.conversations(frame.repartition(5)), PATH)
    got = {r["conv_id"]: r for r in op8.digests(formatted, PATH).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by_conv)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(op8.render(turns)[0]))
    assert op8.digests(op8.format_chats(op8.conversations(frame.limit(0)), PATH), PATH).count() == 0


def test_spans_and_tokens_meet_by_binary_search():
    rng = random.Random(6)
    for _ in range(300):
        cut = sorted(rng.sample(range(60), 12))
        offsets = np.array(list(zip(cut, cut[1:])))
        ends = sorted(rng.sample(range(60), 6))
        spans = np.array(list(zip(ends[::2], ends[1::2])))
        want = [any(a < e and s < b for s, e in spans) for a, b in offsets]
        assert op8.under_spans(offsets, spans).tolist() == want


def naive_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Sources by code point, null last; the excess over a cap goes on until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in capped}, **target}
        capped |= over


def test_mix_meets_its_targets(docs_of):
    rng = random.Random(8)
    rows = [(i, "w " * max(0, int(rng.lognormvariate(4, 1))), rng.choice(["a", "b", "ä", "Z", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "empty"), (None, "x y z", "b"), (5, "same " * 50, "hot"), (5, "same " * 50, "hot"), (902, "w " * 4000, "b")]
    docs = docs_of(rows).withColumn("rate", F.lit("old")).repartition(4)
    out = op7.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = naive_targets(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 and 0 < r["rate"] <= 2
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(3, 0.003 * target), (s, taken[s], target)
    assert sorted(map(str, out)) == sorted(map(str, op7.mix(docs.repartition(7)).select(*out[0].__fields__).collect()))
    copies = op7.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in out)
    assert op7.mix(docs.limit(0)).count() == 0 and op7.mixed_documents(docs.limit(0)).count() == 0


def test_rates_solve_the_dual(docs_of):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 300), rng.choice("abc")) for i in range(600)]
    out = op7.mix(docs_of(rows)).collect()
    words = Counter()
    for r in out:
        words[r["source"]] += r["rate"] * r["size"]
    for r in out:
        assert words[r["source"]] == pytest.approx(r["target"], rel=1e-6)


def test_buckets_split_hot_sizes(docs_of, monkeypatch):
    monkeypatch.setattr(op7, "BUCKET_ROWS", 10)
    rows = [(i, "same words here", "one") for i in range(300)] + [(1000 + i, "w " * (i + 1), "two") for i in range(50)]
    out = op7.mix(docs_of(rows)).collect()
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    want = naive_targets({"one": 900, "two": 1275})
    assert all(abs(taken[s] - t) <= 3 for s, t in want.items())


def test_shard_query_splits_beyond_two_mebibytes(docs_of, spark, tmp_path):
    rng = random.Random(11)
    docs_of([(i, "x" * rng.randint(0, 300_000)) for i in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    size, got = Counter(), op10.query(spark, str(tmp_path)).collect()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert len(got) == 60 and len(size) > 3
    assert all(r["shard_bytes"] == size[r["shard"]] <= 2 << 20 for r in got)
    assert "shard_bytes <= 2097152 OR" in op10.SQL


def test_shards_split_only_what_is_too_large(docs_of, spark):
    rng = random.Random(10)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(500)] + [(None, None), (600, ""), (601, "y" * 5000), *[(7, "same row here " * 10)] * 300]
    docs = docs_of(rows).withColumn("Shard", F.lit(1)).withColumn("bits", F.lit(2))
    out = op10.shards(docs, 3000)
    got = out.collect()
    assert len(got) == len(rows) and "bits" in out.columns
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    assert all(r["shard_bytes"] == size[r["shard"]] and r["shard_docs"] == count[r["shard"]] for r in got)
    assert all(size[s] <= 3000 or count[s] == 1 for s in size)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    parents = {s[:-1] for s in names}
    assert all(sum(n for s, n in size.items() if s.startswith(p)) > 3000 for p in parents)
    assert op10.shards(docs.limit(0)).count() == 0
    assert [r["shard"] for r in op10.shards(docs.limit(3)).select("shard").distinct().collect()] == ["0b"]
    folder = scratch_path(spark, "test-shards")
    op10.write_shards(out.select("doc_id", "text", "shard"), folder)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(folder).groupBy("shard").count().collect()} == count


def naive_rule(host, path):
    best = None
    for verdict, h, p in op5.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_urls(spark):
    rng = random.Random(12)
    urls = [None, "", "no scheme/en/", "http://", "http://COM/", "HTTPS://Example.COM?x=/en/", "x://a.net/es/1#f", "a://b://c.com/en/", "http://é.com/\n/en"]
    urls += ["http://" + "a" * 50000 + ".com/" + "b" * 50000]
    urls += [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example.com', 'x.net', 'y.org', 'notexample.com'])}/{rng.choice(['en', 'es', 'fr', ''])}/{rng.randint(0, 99)}?q#h" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("old"))
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 2 else 'good'}{i}.org/{i}", i % 2) for i in range(200)], "url string, label int")
    got = {r["page_id"]: r for r in op5.judge(pages, op5.fit(labelled)).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:].split("?")[0].split("#")[0]
        rule, verdict = naive_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    test = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}{i}.org/{i}") for i in range(1000, 1100)], "page_id long, url string")
    judged = op5.judge(test, op5.fit(labelled)).collect()
    assert sum((r["verdict"] == "block") == r["page_id"] % 2 for r in judged) >= 95
    assert {r["verdict"] for r in op5.judge(test, op5.fit(labelled.limit(0))).collect()} == {"allow"}
    assert op5.judge(pages.limit(0), op5.fit(labelled.filter("label = 1"))).count() == 0


def test_co_training_on_held_out_documents(docs_of, spark):
    rng = random.Random(14)
    words = ["stone", "river", "cloud", "maple", "north", "quiet", "amber"]
    rows, labels = [], []
    for i in range(500):
        good = i % 4 > 0
        text = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 80))]
        rows.append((i, " ".join(text if good else [w.upper() + "!!" for w in text]), rng.choice("ab") if rng.random() < 0.3 else "good" if good else "bad"))
        if i < 200:
            labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "x " * 20000), (5, rows[5][1], rows[5][2])]
    docs = docs_of(rows).withColumn("score", F.lit("old")).withColumn("n_chars", F.when(F.col("doc_id") != 900, F.col("n_chars")))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = op1.fit(docs, known, rounds=1)
    got = model.score(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["doc_id"] and 200 <= r["doc_id"] < 500]
    assert sum(r["kept"] == (r["doc_id"] % 4 > 0) for r in unseen) >= 0.95 * len(unseen)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    plain = op1.fit(docs, known.filter("quality = 1"))
    assert not plain.views and plain.score(docs).filter("kept").count() == len(rows)
    assert op1.fit(docs.limit(0), known).score(docs.limit(0)).count() == 0


def test_co_training_hands_over_the_surest_of_all_documents(spark, monkeypatch):
    # 15,000 unlabelled documents, more than any fixed pool or count would take.
    good = F.col("doc_id") % 2 == 0
    docs = spark.range(15_400).select(
        F.col("id").alias("doc_id"),
        F.when(good, F.concat(F.lit("quiet river stone "), F.col("id").cast("string"))).otherwise(F.lit("BUY NOW!! ###")).alias("text"),
        F.when(good, "good").otherwise("bad").alias("source"),
        F.lit("en").alias("lang"),
        (F.col("id") % 900).alias("n_chars"),
    )
    known = docs.filter("doc_id < 400").select("doc_id", good.cast("int").alias("quality"))
    fitted = []
    monkeypatch.setattr(op1.View, "__init__", lambda self, name, train, held, init=op1.View.__init__: (fitted.append(train), init(self, name, train, held))[1])
    op1.fit(docs, known, rounds=1)
    first = fitted[0].count()
    for train in fitted[2:]:
        told = train.filter("id >= 400")
        count = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
        assert train.count() - told.count() == first and told.select("id").distinct().count() == told.count()
        assert min(count[0.0], count[1.0]) >= 1_490
        assert told.filter((F.col("label") == 1) != (F.col("id") % 2 == 0)).count() == 0
