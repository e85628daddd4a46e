"""Conversation structure repair by a streamed dynamic programme.

A repaired conversation is nothing, or an optional system row and then
user/assistant pairs. Edits of a row: Keep (0), Rerole to the role that the
place asks for (3), Delete (4, required for blank and duplicate rows); an
empty user or assistant row may be Inserted anywhere (3); a truncated row that
stays adds 3. The cheapest edits are found, among equally cheap ones those
whose letters D, I, K, R are the ASCII-least.

Secondary sort: rows are repartitioned by conversation and sorted so that a
conversation passes twice through one ``mapInPandas``. First its narrow rows
(role, digest, faults; no text) from the last to the first: the programme's
state is the cost to go from four grammar states, four numbers that are
carried across Arrow batches, and each row leaves one byte of backpointers
(two bits a state) and one byte with its fault. Going backwards, the least
letter among the cheapest moves of a state is the least audit, without
comparing audits. Then its texts pass from the first to the last: the
backpointers are walked, and edits, hash and counts come out as they are met.
Backpointers beyond ``spill_bytes`` go to files in the shared scratch folder
and come back block by block, so a conversation of any length needs bounded
memory, but for its audit (one letter an edit), which is part of its result row.
A conversation is one task's, as the order of its rows asks for; its texts are
shuffled once. Whether a row's role and text were seen earlier is settled before
that by grouped minima of (turn, tie) per digest, which hot rows reach as
partial aggregates.

Defined cases: a null role or text counts as one space; a null turn stands
first; equal turns stand in order of role and then the digest of the text,
repeats of a row are adjacent; rows with a null conv_id are one conversation;
a conversation all of whose rows are gone has zeros, an empty audit and the
hash of an empty string; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import col, table
from tidecast.llm.op2_token_records import _store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Backpointer and fault bytes of a conversation that stay in memory.
SPILL_BYTES = 16 << 20
#: Rows of an output batch.
OUT_ROWS = 2000
SPACE = " \t\n\x0b\x0c\r"

# Grammar states: nothing yet, after the system row, after a user, after an assistant.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that an inserted or reroled row leads to, and its role.
_ASKED = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_FAR = 1 << 40
_LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
BLANK, DUPLICATE, CUT = 1, 2, 3


def _settled(costs: list[int], moves: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs and moves with inserts; moves packed, two bits a state."""
    out, packed = list(costs), 0
    for _ in range(2):  # an insert leads to state 2 or 3, a second one on from there
        for s in range(4):
            via = INSERT + out[_ASKED[s]]
            if via < out[s] or via == out[s] and moves[s] > _I:
                out[s], moves[s] = via, _I
    for s in range(4):
        packed |= moves[s] << 2 * s
    return tuple(out), packed


class Programme:
    """Cost to go from each state, row by row from the last to the first."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.end, self.end_moves = _settled([0, _FAR, _FAR, 0], [0, 0, 0, 0])

    def step(self, after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
        """Costs before the row less the smallest of them, that one, moves.
        ``after`` are such costs too, so there are few different ones."""
        key = (after, initial, fault)
        if key not in self.known:
            costs, moves = [], []
            extra = TRUNCATED if fault == CUT else 0
            for s in range(4):
                ways = [(DELETE + after[s], _D)]
                if fault not in (BLANK, DUPLICATE):
                    if (s, initial) in _NEXT:
                        ways.append((KEEP + extra + after[_NEXT[s, initial]], _K))
                    ways.append((REROLE + extra + after[_ASKED[s]], _R))
                cost, move = min(ways)
                costs.append(cost)
                moves.append(move)
            got, packed = _settled(costs, moves)
            least = min(got)
            self.known[key] = tuple(c - least for c in got), least, packed
        return self.known[key]


class Backpointers:
    """Two bytes a row, written from the last row and read from the first;
    full blocks lie in files of a shared folder until they are read."""

    def __init__(self, folder: str, spill_bytes: int) -> None:
        self.folder, self.limit = folder, spill_bytes
        self.block, self.files = bytearray(), []

    def push(self, moves: int, fault: int) -> None:
        self.block += bytes((fault, moves))
        if len(self.block) >= self.limit:
            store, path = _store(self.folder)
            store.create_dir(path, recursive=True)
            name = f"{path}/{uuid.uuid4().hex}.bp"
            with store.open_output_stream(name) as out:
                out.write(bytes(self.block))
            self.files.append(name)
            self.block = bytearray()

    def pop(self) -> tuple[int, int]:
        if not self.block:
            store, _ = _store(self.folder)
            name = self.files.pop()
            with store.open_input_file(name) as f:
                self.block = bytearray(f.read())
            store.delete_file(name)
        return self.block.pop(), self.block.pop()


class Conversation:
    """One conversation: backwards over its narrow rows, forwards over its texts."""

    def __init__(self, programme: Programme, back: Backpointers, rows: bool) -> None:
        self.programme, self.back, self.want_rows = programme, back, rows
        self.costs, self.base = programme.end, 0
        back.push(programme.end_moves, 0)
        self.held = None  # the last narrow row; the next one may be its like
        self.walking = False

    # Backwards.
    def narrow(self, turn, role: str, digest, fault: int, copies: int) -> None:
        row = (turn, role, digest)
        if self.held is not None:
            same = self.held[0] == row
            self._settle(self.held[1], self.held[2], self.held[3], same)
        self.held = (row, role[:1], fault, copies)

    def _settle(self, initial: str, fault: int, copies: int, seen: bool) -> None:
        for k in range(copies - 1, -1, -1):
            late = seen or k > 0
            self._step(initial, DUPLICATE if late and fault != BLANK else fault)

    def _step(self, initial: str, fault: int) -> None:
        self.costs, least, moves = self.programme.step(self.costs, initial, fault)
        self.base += least
        self.back.push(moves, fault)

    # Forwards.
    def _walk(self) -> None:
        if self.held is not None:
            self._settle(self.held[1], self.held[2], self.held[3], False)
        self.walking = True
        self.cost = self.base + self.costs[0]
        self.state, self.audit, self.out = 0, [], []
        self.sha, self.any = hashlib.sha256(), False
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns = [None, None, 0]

    def _put(self, letter: str, role: str | None, text: str | None) -> None:
        self.audit.append(letter)
        if role is not None:
            self.sha.update(f"\n{role}:{text}".encode() if self.any else f"{role}:{text}".encode())
            self.any = True
        if self.want_rows:
            self.out.append((len(self.audit) - 1, letter, role, text))

    def _inserts(self, moves: int) -> int:
        """The row's move after the inserts before it."""
        while (move := moves >> 2 * self.state & 3) == _I:
            self._put("I", _ROLE[self.state], "")
            self.state = _ASKED[self.state]
        return move

    def text(self, turn, role: str, text: str, copies: int) -> None:
        if not self.walking:
            self._walk()
        if turn is not None:
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high)]
        initial = role[:1]
        for _ in range(copies):
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            moves, fault = self.back.pop()
            self.faults[fault] += 1
            move = self._inserts(moves)
            if move == _D:
                self._put("D", None, None)
            elif move == _K:
                self.state = _NEXT[self.state, initial]
                self._put("K", role, text)
            else:
                self._put("R", _ROLE[self.state], text)
                self.state = _ASKED[self.state]

    def end(self) -> tuple:
        if not self.walking:
            self._walk()
        moves, _ = self.back.pop()
        while moves >> 2 * self.state & 3 == _I:
            self._put("I", _ROLE[self.state], "")
            self.state = _ASKED[self.state]
        low, high, n = self.turns
        gaps = 0 if low is None else high - low + 1 - n
        return (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20, as rows
    (conv_id, turn, role, text, copies); copies is zero where a row is dropped."""
    either = [F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)]
    kind = F.crc32(F.concat(either[0], F.lit(":"), either[1])) % 20
    return conversations.select(
        col(conv_id).alias("conv_id"),
        col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(either[2]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(either[3], ".!?", "")).otherwise(either[3]).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as they are, in the form that ``repair`` reads."""
    either = [F.coalesce(col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return conversations.select(col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"), *either, F.lit(1).alias("copies"))


def _key(turn: Column) -> Column:
    return F.struct(turn.isNotNull(), turn)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "place long, edit string, role string, text string"


def repair(rows: DataFrame, edits: bool = False, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """From rows of ``damaged`` or ``undamaged``: one summary row a
    conversation or, with ``edits``, the repaired rows and deletions in order
    (place, edit letter, role and text, both null where the row is deleted)."""
    from tidecast.session import scratch_path

    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    base = rows.withColumn("digest", digest)
    alive = base.filter("copies > 0")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    narrow = alive.select(
        "conv_id", "turn", "role", "digest", "copies",
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0).alias("fault"),
    )
    # A row whose like stands at a smaller turn is a repeat; likes of one turn are adjacent in the stream.
    first = alive.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(_key(F.col("turn"))).alias("first"))
    marked = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).withColumn(
        "fault", F.when((F.col("fault") != BLANK) & (F.col("first") < _key(F.col("turn"))), DUPLICATE).otherwise(F.col("fault"))
    )
    null = F.lit(None)
    conv = F.col("conv_id").cast("string").alias("conv_id")
    back = marked.select(
        conv, F.lit(0).alias("pass"), F.col("turn").alias("turn0"), F.col("role").alias("role0"), F.col("digest").alias("digest0"),
        null.cast("long").alias("turn1"), null.cast("string").alias("role1"), null.cast("binary").alias("digest1"),
        null.cast("string").alias("text"), "copies", "fault",
    )
    forth = base.select(
        conv, F.lit(1).alias("pass"), null.cast("long").alias("turn0"), null.cast("string").alias("role0"), null.cast("binary").alias("digest0"),
        F.col("turn").alias("turn1"), F.col("role").alias("role1"), F.col("digest").alias("digest1"),
        F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies", F.lit(0).alias("fault"),
    )
    stream = back.unionByName(forth).repartition("conv_id").sortWithinPartitions(
        F.asc("conv_id"), "pass", F.desc_nulls_last("turn0"), F.desc("role0"), F.desc("digest0"),
        F.asc_nulls_first("turn1"), "role1", "digest1",
    )
    folder = scratch_path(rows.sparkSession, "repair-backpointers")
    columns = [c.split()[0] for c in (ROWS if edits else SUMMARY).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        programme, current, name = Programme(), None, None
        done: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=["conv_id", *columns])
            done.clear()
            return out

        def finish() -> None:
            summary = current.end()
            done.extend([(name, *r) for r in current.out] if edits else [(name, *summary)])

        for batch in batches:
            ids = [None if pd.isna(c) else c for c in batch["conv_id"]]
            turns = [[None if pd.isna(t) else int(t) for t in batch[c]] for c in ("turn0", "turn1")]
            for c, p, t0, r0, d0, t1, r1, x, n, f in zip(
                ids, batch["pass"], turns[0], batch["role0"], batch["digest0"], turns[1], batch["role1"], batch["text"], batch["copies"], batch["fault"]
            ):
                if current is None or c != name:
                    if current is not None:
                        finish()
                    current, name = Conversation(programme, Backpointers(folder, spill_bytes), edits), c
                if p == 0:
                    current.narrow(t0, r0, d0, f, n)
                elif n:
                    current.text(t1, r1, x, n)
                    if edits and len(current.out) >= OUT_ROWS:
                        done.extend((name, *r) for r in current.out)
                        current.out.clear()
                if len(done) >= OUT_ROWS:
                    yield frame()
        if current is not None:
            finish()
            yield frame()

    # Ids and turns may be null: as strings, they do not become floats in pandas.
    turns = [F.col(c).cast("string").alias(c) for c in ("turn0", "turn1")]
    narrow_stream = stream.select("conv_id", "pass", *turns, "role0", "digest0", "role1", "text", "copies", "fault")
    out = narrow_stream.mapInPandas(run, f"conv_id string, {ROWS if edits else SUMMARY}")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
