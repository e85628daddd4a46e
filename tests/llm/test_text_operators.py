"""Quality rules, SimHash components, decontamination, repeated substrings:
each against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidecast.llm import op3_quality_rules as op3
from tidecast.llm import op4_golay_simhash as op4
from tidecast.llm import op6_repeated_substrings as op6
from tidecast.llm import op9_decontaminate as op9

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a b c"),
    (5, "x " * 3000),
    (None, "no id here at all, but eleven words to be kept by rules"),
    (7, "Grüße aus Köln   日本 語 🙂 " * 40),
    (7, "Grüße aus Köln   日本 語 🙂 " * 40),
    (8, "line one is here\nline one is here\nother words follow in this line\n\n\n"),
    (9, "word" * 30000),
]


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def naive_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    chars = sum(map(len, words))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, WORDS.findall(line)))
            seen.add(line)
    grams, again = {}, 0
    for n in range(5, 11):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, first, inside, any_ = Counter(windows), set(), set(), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                any_.update(range(i, i + n))
            if w in first:
                inside.update(range(i, i + n))
            first.add(w)
        grams[n] = sum(len(words[i]) for i in inside)
        again = len(any_) if n == 5 else again
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    kept = not failed and 100 * dup_chars <= 20 * chars and all(100 * grams[n] <= op3.GRAM_PERCENT[n] * chars for n in grams)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup_lines, again, failed, kept, dup_chars, *grams.values())


def test_rules_match_brute_force(docs_of):
    rng = random.Random(3)
    rows = [*AWKWARD, *[(100 + i, prose(rng, rng.randint(5, 400)) + "\n" + prose(rng, 8) * rng.randint(1, 4)) for i in range(60)]]
    got = op3.repetition_coverage(docs_of(rows)).collect()
    fields = [n for n, _ in op3.fields()]
    want = sorted(str((r[0], *naive_rules(r[1]))) for r in rows)
    assert sorted(str((r["doc_id"], *[r[f] for f in fields])) for r in got) == want


def test_rules_keep_columns_and_empty_tables(docs_of, spark):
    docs = docs_of(AWKWARD).withColumn("kept", F.lit("mine")).withColumn("_result", F.lit(1))
    out = op3.repetition_coverage(docs)
    assert dict(out.dtypes)["kept"] == "boolean" and "_result" in out.columns
    assert op3.keep_clean(docs).columns == docs.columns
    assert op3.repetition_coverage(docs.limit(0)).count() == 0


def naive_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(items, key):
    """Component of every (id, fingerprint): its smallest id."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in combinations(range(len(items)), 2):
        if bin(key(items[i]) ^ key(items[j])).count("1") <= 2:
            parent[find(i)] = find(j)
    out = {}
    for i, item in enumerate(items):
        if item[0] is not None:
            out[find(i)] = min(out.get(find(i), item[0]), item[0])
    return [out.get(find(i)) for i in range(len(items))]


def test_golay_keys_meet_within_two_bits():
    flips = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i, j in combinations(range(64), 2)]]
    for value in np.random.default_rng(0).integers(0, 2**64, 25, dtype=np.uint64).tolist():
        keys, rows = op4.fuzzy_keys(np.array([value ^ f for f in flips], np.uint64))
        assert set(rows[np.isin(keys, keys[rows == 0])].tolist()) == set(range(len(flips)))


def test_links_join_and_balls_agree_with_brute_force(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            values.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    values = sorted(values)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "f long")
    want = naive_components([(i, v) for i, v in enumerate(values)], lambda x: x[1])
    number = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    for limit in (1000, 2):
        root = {r["node"]: r["root"] for r in op4.connected(op4.links(frame, limit)).collect()}
        label = {}
        got = [label.setdefault(root.get(f, f), i) for f, i in sorted(number.items(), key=lambda x: x[1])]
        assert got == want


def test_components_and_survivors(docs_of):
    rng = random.Random(7)
    rows = [*AWKWARD]
    for i in range(30):
        text = prose(rng, 120)
        rows += [(1000 + 10 * i + j, text if j < 2 else text + " tail" * (j > 3), "s") for j in range(rng.randint(1, 5))]
    docs = docs_of(rows)
    got = op4.components(docs).collect()
    items = [(r[0], naive_fingerprint(r[1])) for r in rows]
    labels = naive_components(items, lambda x: x[1])
    want = sorted(str((i, f"{f:016x}", c)) for (i, f), c in zip(items, labels))
    assert sorted(str(tuple(r)) for r in got for r in [(r["doc_id"], r["fingerprint"], r["component_id"])]) == want
    kept = op4.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter(set(labels))
    assert op4.components(docs.limit(0)).count() == 0 and op4.one_per_component(docs.limit(0)).count() == 0


def naive_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = find(text), set(), set()
    for name, item in items:
        w = find(item)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_matches_brute_force(docs_of, spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 25]), ["Ab", "c1", "d", "é"])) for i in range(12)]
    items += [(50, None), (51, "-- !"), (None, "Only One phrase, here"), (3, items[3][1])]
    rows = [*AWKWARD]
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 30), ["ab", "C1", "d", "é", "zzz"])] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))]
        rows.append((100 + i, (rng.choice([" ", ", ", "\n"])).join(parts)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((r[0], *naive_hits(r[1], items))) for r in rows)
    for size in (op9.BLOCK_BYTES, 700):
        got = op9.decontaminate(docs_of(rows), benchmark, block_bytes=size).drop("text", "lang", "source", "n_chars").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    none = op9.decontaminate(docs_of(rows).withColumn("n_hit", F.lit("x")), benchmark.limit(0))
    assert none.filter("contaminated or n_hit > 0").count() == 0
    assert op9.keep_clean(docs_of(rows).limit(0), benchmark).count() == 0


def test_lanes_of_the_search_cover_long_texts():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    text = [rng.choice(vocabulary) for _ in range(30000)]
    item = text[511 - 5 : 511 + 8] + ["other"] + text[20480 - 3 : 20480 + 9]
    matcher = op9.Matcher([("i", " ".join(item).encode())], 10)
    (n, hit, names), = matcher.scan([" ".join(text).encode()])
    want = {p for i in range(len(item) - 9) for j in range(len(text) - 9) if text[j : j + 10] == item[i : i + 10] for p in range(j, j + 10)}
    assert n == 30000 and set(hit.tolist()) == want and names == ["i"]


def naive_spans(texts, span):
    where = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t) + 1)
        for p in range(len(t) - span + 1):
            if where[t[p : p + span]] > 1:
                mark[p : p + span] = b"\1" * span
        edges = [i for i in range(len(mark)) if mark[i] != (mark[i - 1] if i else 0)]
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


def test_repeated_substrings_match_brute_force(docs_of):
    rng = random.Random(13)
    passage = prose(rng, 30)
    rows = [*AWKWARD[:8], (10, "ab" * 400), (11, "x" * 119), (12, "x" * 121)]
    for i in range(60):
        text = prose(rng, rng.randint(3, 60))
        at = rng.randint(0, len(passage))
        rows.append((100 + i, text + passage[at // 2 : at] + prose(rng, 5) + (text if i % 7 == 0 else "")))
    rows += [(300 + i, rows[20][1]) for i in range(3)]
    docs = docs_of(rows).withColumn("t", F.lit(1)).withColumn("spans", F.lit(2))
    want = sorted(str((r[0], s)) for r, s in zip(rows, naive_spans([(r[1] or "").encode() for r in rows], 40)))
    for how in ({}, {"hot_rows": 4, "block": 97}):
        out = op6.repeated_spans(docs.drop("spans"), span=40, gram=9, **how)
        got = [(r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in out.collect()]
        assert sorted(map(str, got)) == want
    row = {r["doc_id"]: r for r in op6.digests(out).collect()}[10]
    assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (800, 800, 1, hashlib.sha256(b"").hexdigest())
    assert op6.digests(op6.repeated_spans(docs.drop("spans").limit(0))).count() == 0


def test_copies_of_a_text_are_ranked_once(docs_of, monkeypatch):
    rng = random.Random(17)
    copied, passage = prose(rng, 40), prose(rng, 20)
    rows = [(i, copied) for i in range(50)] + [(100, prose(rng, 9) + copied[10:90]), (101, passage), (102, "tail " + passage), (103, prose(rng, 30))]
    ranked = []
    monkeypatch.setattr(op6, "_judge_first", lambda rows, *how, judge=op6._judge_first: (ranked.append(rows), judge(rows, *how))[1])
    want = sorted(str((r[0], s)) for r, s in zip(rows, naive_spans([r[1].encode() for r in rows], 40)))
    for how in ({}, {"hot_rows": 1}):
        got = op6.repeated_spans(docs_of(rows), span=40, gram=9, **how).collect()
        assert sorted(str((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]])) for r in got) == want
    assert all(r.groupBy("t", "place").count().filter("count > 1").isEmpty() for r in ranked)


def test_passages_shared_by_documents_go_the_hot_way(docs_of, monkeypatch):
    rng = random.Random(19)
    passage = prose(rng, 20)
    rows = [(i, prose(rng, 4) + passage + prose(rng, 4)) for i in range(20)]
    hot = []
    monkeypatch.setattr(op6, "_judge_first", lambda rows, *how, judge=op6._judge_first: (hot.append(rows) if how[0] else None, judge(rows, *how))[1])
    got = op6.repeated_spans(docs_of(rows), span=40, gram=9, hot_rows=1, sample=1).collect()
    want = sorted(str((r[0], s)) for r, s in zip(rows, naive_spans([r[1].encode() for r in rows], 40)))
    assert sorted(str((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]])) for r in got) == want
    assert len(hot) == 1 and hot[0].select("t").distinct().count() == len(rows)


def test_benchmark_blocks_are_measured_and_read_in_turn(spark):
    rows = [(1, "one item, many rows " * 5)] * 200 + [(i, f"item {i} " * (i % 9)) for i in range(2, 40)] + [(99, "long " * 500)]
    blocks = op9._blocks(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 700)
    assert not isinstance(blocks, list)
    blocks = list(blocks)
    assert sorted(i for b in blocks for i in b) == sorted({(str(i), t.encode()) for i, t in rows})
    assert all(len(b) == 1 or sum(len(n) + len(t) + 64 for n, t in b) <= 700 for b in blocks)
