"""License scans by matching template markup.

A template is license wording with two kinds of regions: ``[[ ... ]]`` may be
left out, ``{{low..high}}`` stands for that many words of any kind (names,
years, titles). All else is mandatory and has to stand word for word; case,
punctuation and line breaks do not count. Templates are compiled into one
token automaton: states are places in templates, sets of places reached
together are made into states of a deterministic automaton when a text first
reaches them. A text has a template's label where the automaton accepts from
some word on; of several ends the farthest counts.

One scan, no shuffle: words become ids of the templates' vocabulary, numpy
finds the places whose first two words can open a template, and the automaton
runs from those only.

Beside the labels, ``score`` is the share of a text's words inside accepted
wording. The base phrases are templates without regions; all their places are
counted.

Defined cases: null and empty texts have no words, no labels and score zero;
overlapping places all count; repeated rows are judged alike; an empty table
gives an empty result; input columns named like a result column give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import ALNUM_WORDS, col, fresh, lots, table, with_struct

# The contract's phrases and labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

_MIT_TERMS = """
to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]
shall be included in all copies or substantial portions of the software
"""
_AS_IS = "is provided as is without warranty of any kind express or implied including but not limited to"
_BSD_TERMS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution
"""

# Wording of public licenses and notices, by label.
TEMPLATES = (
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] {_MIT_TERMS} [[the software {_AS_IS}]]"),
    ("mit", "spdx license identifier mit"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", _BSD_TERMS),
    ("bsd-3-clause", f"{_BSD_TERMS} [[3]] neither the name of {{{{1..20}}}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]] [[you may not use {{1..6}} except in compliance with the license]]"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-3", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("gpl-2", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("lgpl", "under the [[terms of the]] gnu {{1..1}} general public license [[as published by the free software foundation]] [[either]] version {{1..1}} [[of the license]]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{1..8}}]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[{{1..1}}]] international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc [[sa]] [[nd]] {{1..1}} 0"),
)

#: Deterministic states that a worker keeps; beyond them it starts anew.
MAX_STATES = 50_000
_TOKEN = re.compile(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+")


def parsed(markup: str) -> list:
    """Markup as a list of words, (low, high) regions and lists of what may
    be left out."""
    stack: list[list] = [[]]
    for t in _TOKEN.findall(markup):
        if t == "[[":
            stack.append([])
        elif t == "]]":
            inner = stack.pop()
            if not stack:
                raise ValueError(f"']]' without '[[' in {markup!r}")
            stack[-1].append(inner)
        elif t.startswith("{{"):
            low, high = map(int, t[2:-2].split(".."))
            stack[-1].append((low, high))
        else:
            stack[-1].append(t.lower())
    if len(stack) > 1:
        raise ValueError(f"'[[' without ']]' in {markup!r}")
    return stack[0]


class Automaton:
    """All templates as one automaton over word ids; id 0 is any other word."""

    def __init__(self, templates: list[str], max_states: int = MAX_STATES) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.words: list[tuple[int, int] | None] = []  # of a place: (word id, next place); id -1 takes any word
        self.skips: list[list[int]] = []  # of a place: places reached without a word
        self.accepts: dict[int, int] = {}
        self.max_states = max_states
        opening = []
        for i, markup in enumerate(templates):
            start = self._place()
            self.accepts[self._add(parsed(markup), start)] = i
            opening.append(start)
        self._forget(opening)
        size = len(self.vocabulary) + 1
        self.base = np.int64(size)
        # Codes of two words that can open a template; an accepting first word goes with any second one.
        pairs = []
        for a in range(size):
            first = self.step(0, a)
            if first is not None:
                pairs += [a * size + b for b in range(size) if self.ends[first] or self.step(first, b) is not None]
        self.pairs = np.array(pairs, np.int64)
        self.alone = np.array([(s := self.step(0, a)) is not None and bool(self.ends[s]) for a in range(size)])

    def _place(self) -> int:
        self.words.append(None)
        self.skips.append([])
        return len(self.words) - 1

    def _word(self, at: int, word: int) -> int:
        to = self._place()
        self.words[at] = (word, to)
        # A place has one word; what follows starts at a place of its own.
        on = self._place()
        self.skips[to].append(on)
        return on

    def _add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, str):
                at = self._word(at, self.vocabulary.setdefault(part.encode(), len(self.vocabulary) + 1))
                continue
            before = at
            if isinstance(part, list):
                inner = self._place()
                self.skips[before].append(inner)
                at = self._add(part, inner)
                ends = [before, at]
            else:
                low, high = part
                ends = [at] if low == 0 else []
                for k in range(high):
                    inner = self._place()
                    self.skips[at].append(inner)
                    at = self._word(inner, -1)
                    if k + 1 >= low:
                        ends.append(at)
            at = self._place()
            for e in ends:
                self.skips[e].append(at)
        return at

    def _closed(self, places: list[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def _forget(self, opening: list[int] | None = None) -> None:
        """Start the deterministic automaton anew, with its opening state 0."""
        self.opening = self._closed(opening) if opening is not None else self.opening
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.moves: list[dict[int, int | None]] = []
        self._state(self.opening)

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.states:
            self.states[places] = len(self.sets)
            self.sets.append(places)
            self.ends.append(tuple(sorted(self.accepts[p] for p in places if p in self.accepts)))
            self.moves.append({})
        return self.states[places]

    def step(self, state: int, word: int) -> int | None:
        """The state after ``word``, None where no template goes on."""
        moves = self.moves[state]
        if word not in moves:
            to = [w[1] for p in self.sets[state] if (w := self.words[p]) is not None and w[0] in (word, -1)]
            moves[word] = self._state(self._closed(to)) if to else None
        return moves[word]

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Places whose words can open a template; ids end with a 0."""
        pair = np.isin(ids[:-1].astype(np.int64) * self.base + ids[1:], self.pairs)
        return np.flatnonzero(pair | self.alone[ids[:-1]])

    def accepted(self, ids: list[int], start: int, end: int) -> dict[int, int]:
        """Template to farthest end of the wording that begins at ``start``."""
        if len(self.sets) > self.max_states:
            self._forget()
        found, state, at = {}, 0, start
        while at < end and (state := self.step(state, ids[at])) is not None:
            at += 1
            for template in self.ends[state]:
                found[template] = at
        return found


class Scanner:
    """Licenses of whole texts: the result columns of each."""

    def __init__(self, base, templates) -> None:
        self.n_base = len(base)
        self.labels = [label for label, _ in (*base, *templates)]
        self.automaton = Automaton([markup for _, markup in (*base, *templates)])

    def scan(self, texts: list[bytes]) -> list[tuple]:
        get, ids, ends = self.automaton.vocabulary.get, [], []
        for text in texts:
            ids.extend([get(w, 0) for w in text.translate(ALNUM_WORDS).split()])
            ends.append(len(ids))
        starts = self.automaton.starts(np.array([*ids, 0], np.int64))
        which = np.searchsorted(np.array(ends), starts, "right")
        found: dict[int, list] = {}
        for start, d in zip(starts.tolist(), which.tolist()):
            for template, end in self.automaton.accepted(ids, start, ends[d]).items():
                found.setdefault(d, []).append((start, end, template))
        out, low = [], 0
        for d, high in enumerate(ends):
            out.append(self._row(found.get(d, ()), low, high - low))
            low = high
        return out

    def _row(self, found, low: int, n_words: int) -> tuple:
        base = [(start - low, t) for start, _, t in found if t < self.n_base]
        covered = reach = 0
        for start, end, _ in sorted(found):
            covered += max(0, end - max(start, reach))
            reach = max(reach, end)
        return (
            n_words,
            len(base),
            min((s for s, _ in base), default=None),
            max((s for s, _ in base), default=None),
            ",".join(sorted({self.labels[t] for _, t in base})),
            ",".join(sorted({self.labels[t] for _, _, t in found})),
            covered / n_words if n_words else 0.0,
        )


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """``docs`` with the columns of ``FIELDS``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]

    @F.arrow_udf(FIELDS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(base, templates)
        for batch in batches:
            got = [row for lot in lots(batch) for row in scanner.scan(lot)]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.StructArray.from_arrays(columns, names=names)

    (found,) = fresh(docs, "_license")
    judged = docs.withColumn(found, scan(col(text)))
    return with_struct(judged, F.col(found), names).drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


def _pattern(parts: list) -> str:
    """Markup as a pattern over words that are each followed by a space."""
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += part + " "
        elif isinstance(part, list):
            out += f"(?:{_pattern(part)})?"
        else:
            out += rf"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
    return out


def _first(parts: list) -> set[str]:
    """The mandatory word that a template opens with."""
    if not isinstance(parts[0], str):
        raise ValueError("the SQL twin needs templates that open with a word")
    return {parts[0]}


def _sql() -> str:
    every = [(label, parsed(markup), i < len(BASE)) for i, (label, markup) in enumerate((*BASE, *TEMPLATES))]
    firsts = ", ".join(f"'{w}'" for w in sorted(set().union(*[_first(p) for _, p, _ in every])))
    rows = ",\n  ".join(f"('{label}', {str(is_base).lower()}, '^{_pattern(p)}')" for label, p, is_base in every)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH t(label, base, pattern) AS (VALUES
  {rows}
),
d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
spots AS (
  SELECT doc_id, i - 1 AS w, array_to_string(ws[i:i + 300], ' ') || ' ' AS rest
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i] IN ({firsts})
),
hits AS (
  SELECT doc_id, w, label, base, len(regexp_replace(regexp_extract(rest, pattern), '[^ ]', '', 'g')) AS n
  FROM spots JOIN t ON regexp_matches(rest, pattern)
),
covered AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(w, w + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(w) FILTER (WHERE base) AS first_word, max(w) FILTER (WHERE base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(c, 0)::DOUBLE / len(ws) END AS score
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


SQL = _sql()
