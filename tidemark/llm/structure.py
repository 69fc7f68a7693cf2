"""13. Conversation structure repair: rank-convergence parallel Viterbi over chunks, least audits traced from its costs.

A conversation's turns must read ``(s?(ua)+)?`` in the initials of their roles. Rows are kept, given another role or
deleted, and empty turns inserted, at least cost. The cost of what remains, for each of the pattern's four states, is a
vector that goes backwards from row to row. Rows are dealt by ranges of conversation and order, and stretches of 4,096
are chunks, whatever the conversation's size: each chunk starts from a speculative vector at its end, that of an ended
conversation. Fix-up passes then give each chunk its right neighbour's vector and run old and new side by side until
they differ by a constant only, which ends the chunk; passes are rerun until none changes a chunk. Pass p goes through
2^p neighbouring chunks in one task, so that a vector which never converges still arrives after a logarithm of passes.
The vectors then drive the trace: each chunk maps states to states, the maps chain the chunks' first states, and all
chunks write their edits at once, at each step the ASCII-least edit that is still cheapest.

Roles and texts stay in their place but for one shuffle in the end, when edits and rows of a conversation are read in
order; a conversation is then streamed through one task, batch by batch, as its digest is sequential.

Cases: null roles and texts are one space, null turns come first; rows of one turn stand by role and text digest; roles
whose initial isn't s, u or a (or that are empty) can be given another role or deleted only; a conversation without
rows repairs to nothing; a null conversation id is a conversation; repeated rows are duplicates; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import written

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
# Costs of edits and of what is truncated.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the pattern: nothing yet, s, u, a; the state that a new turn leads to, and that turn's role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: States that a kept s, u or a leads from, and to.
KEPT = (((0,), 1), ((0, 1, 3), 2), ((2,), 3))
#: A row's code: its initial (s, u, a, other), and what was found.
MUST_GO, CUT = 4, 8

Vector = tuple[int, int, int, int]


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


#: The costs when no row is left.
ENDED: Vector = tuple(_with_inserts([0, 1 << 20, 1 << 20, 0]))


@lru_cache(maxsize=1 << 16)
def step(after: Vector, code: int) -> tuple[Vector, Vector]:
    """The costs before a row, as they follow from those after it, and the same less their minimum."""
    own = TRUNCATED if code & CUT else 0
    out = [DELETE + c for c in after]
    if not code & MUST_GO:
        out = [min(c, REROLE + own + after[NEXT[s]]) for s, c in enumerate(out)]
        if code & 3 < 3:
            states, to = KEPT[code & 3]
            out = [min(c, KEEP + own + after[to]) if s in states else c for s, c in enumerate(out)]
    full = tuple(_with_inserts(out))
    return full, tuple(c - min(full) for c in full)


def run(codes: list[int], end: Vector) -> Vector:
    """The vector at a chunk's start."""
    for code in reversed(codes):
        end = step(end, code)[1]
    return end


def rerun(codes: list[int], old: Vector, new: Vector, start: Vector) -> Vector:
    """The vector at the start if the chunk's end has ``new``; with ``old`` it was ``start``. Stops where both agree."""
    for code in reversed(codes):
        if old == new:
            return start
        old, new = step(old, code)[1], step(new, code)[1]
    return new


def trace(codes: list[int], end: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """(edits, cost, state at the end) from a state at a chunk's start: at each step the ASCII-least of the cheapest edits.

    What is inserted before a row stands before the row's own edit; the last chunk has what is inserted at the end.
    """
    after = [end]
    for code in reversed(codes):
        after.append(step(after[-1], code)[1])
    edits, cost, i, n = [], 0, 0, len(codes)
    while i < n or last:
        here = step(after[n - i - 1], codes[i])[0] if i < n else end
        later = after[n - i - 1] if i < n else end
        own = TRUNCATED if i < n and codes[i] & CUT else 0
        if i < n and DELETE + later[state] == here[state]:
            edits.append("D")
            cost, i = cost + DELETE, i + 1
        elif INSERT + here[NEXT[state]] == here[state]:
            edits.append("I")
            cost, state = cost + INSERT, NEXT[state]
        elif i == n:
            break
        elif codes[i] & 3 < 3 and state in KEPT[codes[i] & 3][0] and KEEP + own + later[KEPT[codes[i] & 3][1]] == here[state]:
            edits.append("K")
            cost, i, state = cost + KEEP + own, i + 1, KEPT[codes[i] & 3][1]
        else:
            edits.append("R")
            cost, i, state = cost + REROLE + own, i + 1, NEXT[state]
    return "".join(edits), cost, state


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (``conv_id, turn, role, text``) with faults by the row's own hash: dropped, emptied, cut, repeated, another role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    said = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def _key(column: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(column).cast("string")), F.lit(""))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows, stored, with their place: ascending ``_pos`` is conversation by conversation, turn by turn."""
    said = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    bare = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    known = rows.select(_key().alias("_key"), "turn", "role", "text", said.alias("_said"), bare.alias("_bare"))
    by = ["_key", "turn", "role", "_said"]
    tie = F.monotonically_increasing_id()  # spreads rows that are equal
    dealt = known.withColumn("_row", tie).repartitionByRange(*by, "_row").sortWithinPartitions(*by).drop("_row")
    return written(dealt.withColumn("_pos", F.monotonically_increasing_id()), "turns")


def _chunks(placed: DataFrame) -> DataFrame:
    """``_key, _chunk, _pos, codes`` and counts of faults. The first row that says a thing is found by a grouping, and joined by place."""
    first = placed.where("_bare <> ''").groupBy("_key", "_said").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("_first"))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    rows = placed.select("_key", "_pos", initial.alias("_initial"), (F.col("_bare") == "").alias("_blank"), (~F.col("_bare").isin(".", "!", "?")).alias("_cut")).join(first, "_pos", "left")
    again = ~F.col("_blank") & F.col("_first").isNull()
    cut = ~F.col("_blank") & ~again & F.col("_cut")
    code = F.col("_initial") + F.when(F.col("_blank") | again, MUST_GO).otherwise(0) + F.when(cut, CUT).otherwise(0)
    told = F.array_sort(F.collect_list(F.struct("_pos", code.cast("tinyint").alias("code"))))
    out = rows.groupBy("_key", F.shiftright("_pos", CHUNK_BITS).alias("_chunk")).agg(told.alias("c"), F.count_if("_blank").alias("blank"), F.count_if(again).alias("duplicate"), F.count_if(cut).alias("truncated"))
    return written(out.select("_key", "_chunk", F.col("c")[0]["_pos"].alias("_pos"), F.col("c.code").alias("codes"), "blank", "duplicate", "truncated"), "chunks")


_PASS = "_key string, _i bigint, _end array<int>, _start array<int>, _changed boolean"


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of spans, each span from its last to its first: each gets its right neighbour's vector."""
    at, carried = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            here = (row["_key"], row["_span"])
            new = carried if here == at else tuple(row["_seed"])
            old, start = row["_end"], row["_start"]
            carried = run(row["codes"], new) if start is None else rerun(row["codes"], tuple(old), new, tuple(start))
            out.append({"_key": row["_key"], "_i": row["_i"], "_end": new, "_start": carried, "_changed": old is None or tuple(old) != new})
            at = here
        if out:
            fields = [("_key", pa.string()), ("_i", pa.int64()), ("_end", pa.list_(pa.int32())), ("_start", pa.list_(pa.int32())), ("_changed", pa.bool_())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))


def _converged(chunks: DataFrame) -> DataFrame:
    """``_key, _i, _end`` of chunks (``_key, _i, codes``) of conversations with several: the costs after each."""
    ended = F.array(*[F.lit(c) for c in ENDED])
    null = F.lit(None).cast("array<int>")
    given = chunks.select("_key", "_i", "codes", F.col("_i").alias("_span"), ended.alias("_seed"), null.alias("_end"), null.alias("_start"))  # the speculation
    state, passes = written(given.mapInArrow(_fixed, _PASS), "vectors"), 0
    while True:
        ahead = state.select("_key", (F.col("_i") - 1).alias("_i"), F.col("_start").alias("_seed"))
        spans = chunks.join(state.drop("_changed"), ["_key", "_i"]).join(ahead, ["_key", "_i"], "left").withColumn("_seed", F.coalesce("_seed", ended)).withColumn("_span", F.shiftright("_i", passes))
        dealt = spans.select("_key", "_i", "codes", "_span", "_seed", "_end", "_start").repartition("_key", "_span").sortWithinPartitions("_key", "_span", F.desc("_i"))
        state, passes = written(dealt.mapInArrow(_fixed, _PASS), "vectors"), passes + 1
        if state.where("_changed").isEmpty():
            return state.select("_key", "_i", "_end")


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at a chunk's end for each state at its start."""
    for batch in batches:
        rows = batch.select(["_key", "_i", "codes", "_end", "last"]).to_pylist()
        ends = [[trace(r["codes"], tuple(r["_end"]), s, r["last"])[2] for s in range(4)] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_i"), pa.array(ends, pa.list_(pa.int32()))], ["_key", "_i", "_to"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states that chunks start with, from their maps in order."""
    at, state = None, 0
    for batch in batches:
        states = []
        for key, to in zip(batch.column("_key").to_pylist(), batch.column("_to").to_pylist(), strict=True):
            state = state if key == at else 0
            states.append(state)
            at, state = key, to[state]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_i"), pa.array(states, pa.int32())], ["_key", "_i", "state"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("codes", "_end", "state", "last")), strict=True)
        told = [trace(codes, tuple(end), state, last) for codes, end, state, last in rows]
        kept = ["_key", "_pos", "blank", "duplicate", "truncated"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64())], [*kept, "edits", "cost"])


def _edits(chunks: DataFrame) -> DataFrame:
    """``_key, _pos, edits, cost`` and counts of faults of every chunk."""
    count = chunks.groupBy("_key").agg(F.count("*").alias("n"), F.min("_chunk").alias("_lowest"))
    ended = F.array(*[F.lit(c) for c in ENDED])
    many = written(count.where("n > 1"), "long")
    told = chunks.join(many, "_key", "left")
    columns = ["_key", "_pos", "codes", "blank", "duplicate", "truncated"]
    todo = told.where("n is null").select(*columns, ended.alias("_end"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    if not many.isEmpty():
        number = F.row_number().over(Window.partitionBy("_key").orderBy("_chunk"))  # of chunks, not of rows
        numbered = told.where("n is not null").select("_key", "_chunk", "n").withColumn("_i", number.cast("bigint"))
        parts = written(numbered.join(chunks, ["_key", "_chunk"]).withColumn("last", F.col("_i") == F.col("n")), "parts")
        ends = parts.join(_converged(parts.select("_key", "_i", "codes")), ["_key", "_i"])
        maps = ends.select("_key", "_i", "codes", "_end", "last").mapInArrow(_mapped, "_key string, _i bigint, _to array<int>")
        states = maps.repartition("_key").sortWithinPartitions("_key", "_i").mapInArrow(_chained, "_key string, _i bigint, state int")
        todo = todo.unionByName(ends.join(states, ["_key", "_i"]).select(*columns, "_end", "state", "last"))
    return todo.mapInArrow(_edited, "_key string, _pos bigint, blank bigint, duplicate bigint, truncated bigint, edits string, cost bigint")


class _Conversation:
    """What is known of a conversation while its edits and rows pass."""

    def __init__(self, key: str, conv_id):
        self.key, self.conv_id = key, conv_id
        self.counts, self.audit, self.hash, self.lines = [0, 0, 0, 0], [], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = self.state = 0
        self.edits: Iterator[str] = iter("")

    def chunk(self, row: dict) -> None:
        self.audit.append(row["edits"])
        self.edits = iter(row["edits"])
        self.counts = [a + row[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "cost"), strict=True)]

    def said(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1
        return edit, role, text

    def row(self, row: dict) -> Iterator[tuple[str, str, str]]:
        """A row and what is inserted before it, as they are after repair."""
        if (t := row["turn"]) is not None:
            self.low, self.high = t if self.low is None else self.low, t
            self.turns += t != self.turn
            self.turn = t
        if self.initial is not None and self.initial + row["role"][:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = row["role"][:1]
        for edit in self.edits:
            if edit == "D":
                return
            if edit == "K":
                self.state = KEPT["sua".index(row["role"][0])][1]
                yield self.said(edit, row["role"], row["text"])
                return
            role, self.state = ROLE[self.state], NEXT[self.state]
            yield self.said(edit, role, row["text"] if edit == "R" else "")
            if edit == "R":
                return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            role, self.state = ROLE[self.state], NEXT[self.state]
            yield self.said(edit, role, "")

    def told(self) -> dict:
        blank, duplicate, truncated, cost = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _read(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[dict]:
    """Conversations in order: first the name, then each chunk's edits, each before its rows. Gives turns or reports."""
    now = None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for row in batch.slice(i, 256).to_pylist():
                if row["_kind"] == 0:
                    if now is not None:
                        yield from _closed(now, turns)
                    now = _Conversation(row["_key"], row["conv_id"])
                elif row["_kind"] == 1:
                    now.chunk(row)
                else:
                    for edit, role, text in now.row(row):
                        if turns:
                            yield {"conv_id": now.conv_id, "place": now.lines - 1, "edit": edit, "role": role, "text": text}
    if now is not None:
        yield from _closed(now, turns)


def _closed(now: _Conversation, turns: bool) -> Iterator[dict]:
    for edit, role, text in now.rest():
        if turns:
            yield {"conv_id": now.conv_id, "place": now.lines - 1, "edit": edit, "role": role, "text": text}
    if not turns:
        yield now.told()


def _result(rows: DataFrame, names: DataFrame, turns: bool) -> DataFrame:
    placed = _in_order(rows)
    edits = _edits(_chunks(placed))
    named = names.select("conv_id").distinct().select(_key().alias("_key"), "conv_id", F.lit(-1).cast("bigint").alias("_pos"), F.lit(0).alias("_kind"))
    both = named.unionByName(edits.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(placed.select("_key", "_pos", "turn", "role", "text", F.lit(2).alias("_kind")), allowMissingColumns=True)
    kind = dict(names.dtypes)["conv_id"]
    body = "place bigint, edit string, role string, text string" if turns else "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    dealt = both.repartition("_key").sortWithinPartitions("_key", "_pos", "_kind")
    schema = dealt.sparkSession.createDataFrame([], f"conv_id {kind}, {body}").schema
    fields = to_arrow_schema(schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _read(batches, turns):
            held.append(row)
            size += len(row["text"] if turns else row["audit"])
            if len(held) >= 4096 or size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema=fields)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=fields)

    return dealt.mapInArrow(told, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired turns of conversations (``conv_id, turn, role, text``)."""
    text = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return _result(rows.select("conv_id", "turn", text("role"), text("text")), rows, True)


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its faults after ``damaged``, the least cost, the audit, the repaired text's digest."""
    return _result(damaged(conversations), conversations, False)
