"""License templates, cross-tokenizer alignment, conversation repair."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecast.llm import op11_license_templates as op11
from tidecast.llm import op12_alignment as op12
from tidecast.llm import op13_repair as op13

A_PATH, B_PATH = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- licenses


def license_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def ends(parts, words, at):
    """All ends of a template's wording that begins at ``at``."""
    if not parts:
        return {at}
    head, rest = parts[0], parts[1:]
    if isinstance(head, str):
        return ends(rest, words, at + 1) if at < len(words) and words[at] == head else set()
    if isinstance(head, list):
        firsts = {at} | ends(head, words, at)
    else:
        firsts = {at + k for k in range(head[0], head[1] + 1) if at + k <= len(words)}
    return set().union(*[ends(rest, words, f) for f in firsts]) if firsts else set()


def license_row(text, base, templates):
    words, hits = license_words(text), []
    for i, (label, markup) in enumerate([*base, *templates]):
        parts = op11.parsed(markup)
        for at in range(len(words)):
            if got := ends(parts, words, at):
                hits.append((at, max(got), label, i < len(base)))
    places = [h[0] for h in hits if h[3]]
    covered = {p for h in hits for p in range(h[0], h[1])}
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({h[2] for h in hits if h[3]})),
        ",".join(sorted({h[2] for h in hits})), len(covered) / len(words) if words else 0.0,
    )


def filled(rng, parts):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, list):
            out += filled(rng, p) if rng.random() < 0.5 else []
        else:
            out += rng.choices(["acme", "inc", "version", "the"], k=rng.randint(p[0], p[1] + (rng.random() < 0.1)))
    return out


def test_license_rows_equal_brute_force(docs_of):
    rng = random.Random(5)
    texts = [None, "", "...", "Released under the MIT License.", "cc by nc cc by nc", "Licensed under CC-BY-NC 4.0", "under " * 3000, "ünder the mit license é"]
    texts += ["Under The\nMIT--License! " * 2, "apache license version 2 " * 500]
    for _, markup in op11.TEMPLATES * 12:
        words = filled(rng, op11.parsed(markup))
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "not"
        words = rng.choices(["under", "the", "licensed", "permission", "x", "cc", "by"], k=rng.randint(0, 9)) + words + ["end"] * rng.randint(0, 2)
        texts.append(rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = docs_of(rows).withColumn("Score", F.lit("clash"))
    got = sorted(op11.scan_licenses(docs).select("doc_id", *[f.split()[0] for f in op11.FIELDS.split(", ")]).collect())
    want = sorted((i, *license_row(t, op11.BASE, op11.TEMPLATES)) for i, t in rows)
    assert [tuple(r) for r in got] == want
    assert op11.scan_licenses(docs.limit(0)).count() == 0


def test_automaton_starts_anew_and_markup_errors():
    small = op11.Automaton(["a [[b c]] {{0..3}} d", "{{1..2}} e"], max_states=3)
    words = {w: small.vocabulary.get(w.encode(), 0) for w in "abcdex"}
    for text, want in (("a d", {0: 2}), ("a b c x d e", {0: 5}), ("x e", {1: 2}), ("a x x x d", {0: 5}), ("a x x x x d", {}), ("a e e", {1: 3})):
        ids = [words[w] for w in text.split()]
        for _ in range(3):
            assert small.accepted(ids, 0, len(ids)) == want, text
    for bad in ("a ]] b", "[[ a"):
        with pytest.raises(ValueError):
            op11.parsed(bad)


# --- alignment


def alignment_rows(texts):
    """Rows of the contract by whole-text encoding and all links."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_bytes, b_bytes = op12.byte_level_bytes([a.id_to_token(i) for i in range(a.get_vocab_size())]), op12.piece_bytes(b)
    docs, held = [], Counter()
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in ia) != want or b"".join(b_bytes[i] for i in ib) != want:
            docs.append(None)
            continue
        ends_a, ends_b = ([*itertools.accumulate(len(x[i]) for i in ids)] for x, ids in ((a_bytes, ia), (b_bytes, ib)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, p, q = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while p < len(ia) and ends_a[p] <= c:
                ga.append(ia[p])
                p += 1
            while q < len(ib) and ends_b[q] <= c:
                gb.append(ib[q])
                q += 1
            groups.append((ga, gb))
        docs.append((ia, ib, groups))
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = Counter((x, y) for ga, gb in d[2] for x in ga for y in gb)
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d[2])
        out.append((
            len(d[0]), len(d[1]), len(d[2]), sum(links.values()), sum(n for (x, y), n in links.items() if held[x, y] == best[x]),
            sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest(),
        ))
    return out, held


def test_alignment_equals_brute_force(docs_of, monkeypatch):
    rng = random.Random(7)
    bits = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "<|endoftext|>", "</s>", "日本", "\r\n", "x y", "\x1c", "▁", "the", "ing", " word", "ＡＢ", " ", " "]
    texts = [None, "", " ", "▁", "a▁b", "Grüße 日本 🙂", "x" * 5000, "one two one two " * 300, " lead", "tail ", "<|endoftext|> <s> </s>", "a" * 300 + "é" * 300]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]
    texts += [" ".join(rng.choices(["ereal", "thation", "shounding", "le,", "être", "über.\nDie"], k=rng.randint(1, 60))) for _ in range(60)]
    texts += texts[-5:]
    monkeypatch.setattr(op12, "TABLE_CHUNKS", 150)
    docs = docs_of([(i if i else None, t) for i, t in enumerate(texts)]).withColumn("pair", F.lit("clash")).repartition(3)
    pairs, got = op12.align(docs, A_PATH, B_PATH, lot_bytes=3000)
    rows, held = alignment_rows(texts)
    want = {(i if i else None): r for i, r in enumerate(rows)}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == want
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in pairs.collect()} == dict(held)
    assert op12.align(docs.limit(0), A_PATH, B_PATH)[1].count() == 0


def test_wide_groups_count_distinct_ids(monkeypatch):
    v = op12.Vocabularies(A_PATH, B_PATH)
    texts = ["x" * 700, "é" * 90 + "日本語" * 40, "0123456789" * 30]
    plain, wide = op12.Links(v), op12.Links(v)
    plain.add(texts, whole=True)
    monkeypatch.setattr(op12, "_WIDE", 1)
    wide.add(texts, whole=True)
    assert plain.pairs.tolist() == wide.pairs.tolist() and plain.times.tolist() == wide.times.tolist()


# --- repair


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows):
    """All edits of a short conversation, the cheapest and ASCII-least."""
    space, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, _, role, text in rows:
        if not text.strip(space):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if text.rstrip(space)[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    ways = itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1)
    for price, gaps in sorted((sum(3 * len(g) for g in w), w) for w in ways):
        if best is not None and price > best[0]:
            break
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, out = price, "", []
            for gap, edit, row, fault in zip(gaps, [*edits, ""], [*rows, None], [*faults, ""]):
                audit += "I" * len(gap)
                out += [({"u": "user", "a": "assistant"}[g], "") for g in gap]
                if row is None:
                    break
                if edit != "D" and fault in ("blank", "duplicate"):
                    break
                audit += "R" if edit in "ua" else edit
                cost += {"K": 0, "D": 4}.get(edit, 3) + (3 if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    out.append((row[2] if edit == "K" else {"u": "user", "a": "assistant"}[edit], row[3]))
            else:
                continue
            if row is None and re.fullmatch("(s?(ua)+)?", "".join((r or "-")[0] for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    turns = [r[1] for r in rows if r[1] is not None]
    bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        bad, best[0], best[1], hashlib.sha256(text.encode()).hexdigest(),
    )


NAMES = [f.split()[0] for f in op13.SUMMARY.split(", ")]


def conversations_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def by_conversation(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r))):
        out[r[0]].append(r)
    return out


@pytest.fixture(scope="module")
def short_conversations():
    rng, rows = random.Random(3), []
    for c in range(60):
        for t in range(rng.choice([1, 2, 2, 3, 3, 3])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ü"])
            text = rng.choice(["Hi.", "Hi.", "Why? ", "cut off", None, "", " \n", "a.b\t", "Yes!\n"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows + [(None, 0, "user", "A."), (None, 1, "assistant", "B."), (2**60 + 1, 2**62, "user", "x.")]


def test_repair_equals_all_edits(spark, short_conversations):
    frame = conversations_of(spark, short_conversations).withColumn("audit", F.lit("clash")).repartition(4)
    for rows, read in ((damage(short_conversations), op13.damaged), ([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in short_conversations], op13.undamaged)):
        groups = by_conversation(rows)
        want = {c: repaired(groups.get(c, [])) for c, *_ in short_conversations}
        got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in op13.repair(read(frame)).collect()}
        assert got == want
    assert op13.repair(op13.damaged(frame.limit(0))).count() == 0


def test_edit_rows_give_the_same_conversations(spark, short_conversations):
    frame = op13.damaged(conversations_of(spark, short_conversations))
    summary = {r["conv_id"]: r for r in op13.repair(frame).collect()}
    rows = defaultdict(list)
    for r in op13.repair(frame, edits=True).orderBy("conv_id", "place").collect():
        rows[r["conv_id"]].append(r)
    for c, s in summary.items():
        assert "".join(r["edit"] for r in rows[c]) == s["audit"]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in rows[c] if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == s["repaired_sha256"]


def test_giant_conversation_spills_backpointers(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), rng.choice([f"Text {i}.", f"cut {i}", "again."])) for i in range(5000)]
    frame = op13.undamaged(conversations_of(spark, rows).union(conversations_of(spark, [(2, 0, "user", "a."), (2, 1, "assistant", "b.")])))
    whole = [tuple(r) for r in op13.repair(frame).orderBy("conv_id").collect()]
    assert [tuple(r) for r in op13.repair(frame, spill_bytes=1000).orderBy("conv_id").collect()] == whole
    assert whole[0][NAMES.index("duplicate") + 1] > 1000 and whole[1][NAMES.index("audit") + 1] == "KK"
    back = op13.Backpointers(str(tmp_path), 10)
    for i in range(100):
        back.push(i, i % 4)
    assert len(list(tmp_path.iterdir())) == 20
    assert [back.pop() for _ in range(100)] == [(i, i % 4) for i in reversed(range(100))]
    assert not list(tmp_path.iterdir())
