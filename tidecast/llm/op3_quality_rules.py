"""Quality rules: repetition coverage of every whole text.

Words are runs of characters other than space and ``\\t\\n\\v\\f\\r``. Rolling
hashes over the word ids of a text name its n-grams for several lengths at
once (numpy prefix sums of ``mix(id) * base**i``); a text is judged by the
characters inside repeated n-grams and repeated lines. One pass over the
documents inside Arrow batches, no shuffle, whole texts always.

Defined cases: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; an empty table gives an empty result; input
columns named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import col, lots, with_struct

#: Most characters of a text (percent) that may lie in repeats of n-grams.
#: The published thresholds of the MassiveText quality filter.
GRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 20
MIN_WORDS = 10
REPEAT_PERCENT = 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NOT_CODE_POINTS = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fields(percent: dict[int, int] | None = None) -> list[tuple[str, str]]:
    grams = [(f"dup_{n}gram_chars", "bigint") for n in (percent or GRAM_PERCENT)]
    return [(c, "bigint") for c in _COUNTS] + [("base_failed", "boolean"), ("kept", "boolean"), ("dup_line_chars", "bigint")] + grams


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: word ids become random-looking 64-bit values."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words from ``starts``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(prefix: np.ndarray, down: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of n-gram windows that occur again anywhere in the text, and
    of those that have occurred before."""
    size = len(prefix) - 1
    if size < n + 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (prefix[n:] - prefix[:-n]) * down[: size - n + 1]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    member = np.zeros(len(h), bool)
    member[:-1] |= same
    member[1:] |= same
    return order[member], order[1:][same]


def measure(text: bytes, percent: dict[int, int], powers: Powers) -> tuple:
    """The row of one text: counts, verdicts, characters in repeats."""
    words = text.split()  # bytes.split() separates at exactly _SPACES
    n_words = len(words)
    word_chars = len(text.translate(None, _SPACES + _NOT_CODE_POINTS))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(line.translate(None, _SPACES + _NOT_CODE_POINTS))
        elif line.strip():
            seen.add(line)
    chars = dict.fromkeys(percent, 0)
    n_repeat_words = 0
    if n_words > 5:
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(index.__getitem__, words), np.int64, n_words)
        up, down = powers.upto(n_words + 1)
        prefix = np.zeros(n_words + 1, np.uint64)
        np.cumsum(_mix(ids) * up[:n_words], out=prefix[1:])
        again, later = repeats(prefix, down, 5)
        if len(again):
            n_repeat_words = int(_covered(again, 5, n_words).sum())
            each = np.fromiter((len(w.translate(None, _NOT_CODE_POINTS)) for w in index), np.int64, len(index))[ids]
            for n in percent:
                # A longer n-gram repeats only where its first five words do.
                starts = later if n == 5 else repeats(prefix, down, n)[1]
                if len(starts):
                    chars[n] = int(each[_covered(starts, n, n_words)].sum())
    base_failed = n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words
    kept = (
        not base_failed
        and 100 * dup_line_chars <= LINE_PERCENT * word_chars
        and all(100 * chars[n] <= p * word_chars for n, p in percent.items())
    )
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, *chars.values())


def repetition_coverage(docs: DataFrame, text: str = "text", percent: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with the counts and verdicts of every whole text.

    ``percent`` gives the n-gram lengths (five words at least) and the most
    characters, in percent, that may lie in their repeats."""
    percent = dict(percent or GRAM_PERCENT)
    if min(percent) < 5:
        raise ValueError("n-gram lengths start at five words")
    out = fields(percent)
    arrow = pa.struct([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in out])

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in out))
    def rows(texts: pa.Array) -> pa.Array:
        powers = Powers()
        got = [measure(t, percent, powers) for lot in lots(texts) for t in lot]
        columns = list(zip(*got)) or [()] * len(out)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], fields=list(arrow))

    return with_struct(docs, rows(col(text)), [n for n, _ in out])


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` only."""
    names = docs.columns
    judged = repetition_coverage(docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]), f"c{names.index(text)}")
    return judged.filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    from tidecast.llm.common import table

    return repetition_coverage(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_GRAMS = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0)::BIGINT AS dup_{n}gram_chars" for n in GRAM_PERCENT)
_LENGTHS = ", ".join(f"({n})" for n in GRAM_PERCENT)
_PASSES = " AND ".join(f"100 * coalesce(dup_{n}gram_chars, 0) <= {p} * word_chars" for n, p in GRAM_PERCENT.items())
_GRAM_COLUMNS = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in GRAM_PERCENT)

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM d
), lines AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup_lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_dup_lines,
         sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars
  FROM lines WHERE nth > 1 GROUP BY doc_id
), fives AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5))
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), grams AS (
  -- A longer n-gram repeats only where its first five words do.
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM fives JOIN d USING (doc_id), (VALUES {_LENGTHS}) AS t(n) WHERE i + n - 1 <= len(ws)
), counted AS (
  SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS nth FROM grams
), repeated AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM fives) GROUP BY doc_id
), inside AS (
  SELECT doc_id, n, sum(length(ws[p])) AS chars
  FROM (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM counted WHERE nth > 1) JOIN d USING (doc_id)
  GROUP BY doc_id, n
), gram_chars AS (
  SELECT doc_id, {_GRAMS} FROM inside GROUP BY doc_id
), all_of AS (
  SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * n_words AS base_failed,
         coalesce(dup_line_chars, 0) AS dup_line_chars, {_GRAM_COLUMNS}
  FROM base LEFT JOIN dup_lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gram_chars USING (doc_id)
)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars AND {_PASSES} AS kept FROM all_of
"""
