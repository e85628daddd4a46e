"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, ``<s>`` and then one marked turn after the
other, and encoded once. Control strings are added tokens, so no token of a
text ever reaches over a turn's border; inside texts and role names every
control string is escaped by a backslash after its first character (one more
where there already are some), which is undone by taking one away. Token
offsets and the sorted spans of the assistant's texts are intersected by
binary search: a token is under the loss mask if it overlaps a span.

Turns of a conversation meet in one row, ordered by turn; a conversation is
one training record, so it is as long as it is and has to fit in memory.

Defined cases: a null text is empty; a null role is a role without a name;
equal turn numbers stand in order of role and text, a null turn number comes
first; rows with a null conv_id are one conversation; repeated rows are
repeated turns; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import col, table

BEGIN = "<s>"
#: Markers before and after a turn's text, by role.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ANS]", "</s>")}
#: Any other role: its name stands between the first two.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: Strings that a text must not hold as they are: the template's and the
#: tokenizer's own special token.
CONTROLS = (BEGIN, *[m for pair in MARKS.values() for m in pair], *OTHER, "<|endoftext|>")

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_SPLIT = re.compile("(" + "|".join(re.escape(c) for c in CONTROLS) + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts."""
    parts, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        text = escape(text)
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        parts += (before, text, after)
        start = at + len(before)
        if role == "assistant":
            spans.append((start, start + len(text)))
        at = start + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    pieces = _SPLIT.split(formatted)
    by_mark = {before: role for role, (before, _) in MARKS.items()}
    turns, i = [], 3  # pieces: "", <s>, "", marker, text, marker, "", ...
    while i < len(pieces):
        if pieces[i] in by_mark:
            turns.append((by_mark[pieces[i]], unescape(pieces[i + 1])))
            i += 4
        else:
            turns.append((unescape(pieces[i + 1]), unescape(pieces[i + 3])))
            i += 6
    return turns


def under_spans(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (rows of start, end; sorted) overlap one of the sorted,
    disjoint spans: the first span that ends after a token's start must start
    before the token's end."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    inside = first < len(spans)
    return inside & (spans[np.minimum(first, len(spans) - 1), 0] < offsets[:, 1])


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return tokenizer


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order."""
    one = F.struct(
        col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")
    )
    return rows.groupBy(col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def format_chats(chats: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, input_ids, loss_mask) for every row of ``conversations``."""

    @F.arrow_udf("input_ids array<int>, loss_mask array<boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load_tokenizer(tokenizer)
        for batch in batches:
            ids, masks = [], []
            for at in range(0, len(batch), 100):
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.slice(at, 100).to_pylist()]
                for e, (_, spans) in zip(encoder.encode_batch([f for f, _ in rendered], add_special_tokens=False), rendered):
                    ids.append(np.array(e.ids, np.int32))
                    # An empty text has an empty span, which no token overlaps.
                    spans = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
                    masks.append(under_spans(np.array(e.offsets, np.int64).reshape(-1, 2), spans))
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=["input_ids", "loss_mask"]
            )

    done = chats.select("conv_id", encode("turns").alias("e"))
    return done.select("conv_id", "e.input_ids", "e.loss_mask")


_DIGESTS = [
    ("n_turns", pa.int64()),
    ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
]


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What the ids and masks of ``format_chats`` say, read back from them."""

    @F.arrow_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        decoder = load_tokenizer(tokenizer)
        for all_ids, all_masks in batches:
            rows = []
            for ids, mask in zip(all_ids, all_masks):
                ids = ids.values.to_numpy()
                mask = np.array(mask.as_py(), bool)
                whole = decoder.decode(ids.tolist(), skip_special_tokens=False)
                turns = parse(whole)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                loss = "".join(
                    unescape(decoder.decode(ids[a:b].tolist(), skip_special_tokens=False)) for a, b in edges.reshape(-1, 2).tolist()
                )
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                sha = [hashlib.sha256(t.encode()).hexdigest() for t in (said, loss)]
                rows.append((len(turns), sha[0], len(loss), sha[1], len(whole)))
            columns = list(zip(*rows)) or [()] * len(_DIGESTS)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _DIGESTS)], names=[n for n, _ in _DIGESTS])

    done = formatted.select("conv_id", read("input_ids", "loss_mask").alias("d"))
    return done.select("conv_id", *[f"d.{n}" for n, _ in _DIGESTS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    return digests(format_chats(conversations(rows.unionByName(extra)), tokenizer), tokenizer)


_SQL_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_MARK_CHARS = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())


def _sql_chars(column: str) -> str:
    return rf"(length({column}) + len(regexp_extract_all({column}, '[<\[]\\*(?:{_SQL_TAILS})')))"


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(BEGIN)} + sum({_sql_chars('text')}
         + CASE role {_MARK_CHARS} ELSE {sum(map(len, OTHER))} + {_sql_chars('role')} END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
