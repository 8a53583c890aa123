"""Repair of conversations: the cheapest edits that give them the structure ``(s?(ua)+)?``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.auction import ASSISTANT, BLANK, DELETE, DUPLICATE, FINE, INITIALS, INSERT, NONE, REROLE, STATES, TRUNCATED, USER, before, chained, cheapest, crossing, edits_from, endings, fix, keep
from tensorloom.llm.common import stored, table

#: Rows of one conversation that are looked at together; longer ones are cut.
PIECE = 4096
#: Roles of turns that are given one or put in.
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The order of rows: by turn, nulls first; of one turn by role, then by digest of role and text.
ORDER = ["turn", "role", "digest"]
KEYS = ["conv", *ORDER, "uid"]


def turns(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, digest of rows (conv_id, turn, role, text); a null role or text counts as one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"))
    return out.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.char_length("role"), "role", "text"))))


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row for each of ``turns``: its order, and a code of its role's initial and first fault.

    A duplicate is found without gathering a conversation: each (conversation, digest) keeps the
    number of its first row, by partial aggregation, and rows meet that by their own number, so
    that neither a long conversation nor a much repeated text lands in one task.
    """
    last = F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)")
    code = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.char_length("role") > 0) & (code > 0), code - 1).otherwise(len(INITIALS))
    fault = F.when(last == "", BLANK).when(F.right(last, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    narrow = stored(rows.select("conv", *ORDER, F.monotonically_increasing_id().alias("uid"), initial.alias("initial"), fault.alias("fault")))
    first = narrow.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "uid")).getField("uid").alias("uid")).select("uid", F.lit(True).alias("first"))
    marked = narrow.join(first, "uid", "left").withColumn("fault", F.when(F.col("first").isNull() & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")))
    return marked.select(*KEYS, (F.col("initial") + 4 * F.col("fault")).cast("int").alias("code"))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and length of their texts."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)

    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(kept) >= size or held >= max_bytes:
            yield batch()
            kept, held = [], 0
    if kept:
        yield batch()


def _arrow(df: DataFrame, fields: str) -> tuple[str, pa.Schema]:
    """A schema of df's conv and ``fields``, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType([df.schema["conv"], *StructType.fromDDL(fields).fields])
    return kind, to_arrow_schema(kind)


def _pieces(rows: Iterator[tuple], piece: int) -> Iterator[tuple]:
    """Sorted rows (conv, turn, role, digest, uid, code) cut into conversations and, if long or cut by the task's edge, pieces.

    Yields (key of the first row, codes, whole).
    """
    head, codes, edge, cut = None, bytearray(), True, False
    for row in rows:
        if head is not None and row[0] != head[0]:
            yield head, bytes(codes), not (edge or cut)
            head, codes, edge, cut = None, bytearray(), False, False
        elif len(codes) == piece:
            yield head, bytes(codes), False
            head, codes, cut = None, bytearray(), True
        if head is None:
            head = row[:5]
        codes.append(row[5])
    if head is not None:
        yield head, bytes(codes), False


def cost_of(codes: bytes, edits: str) -> int:
    rows = iter(codes)
    price = {"K": 0, "R": REROLE, "D": DELETE}
    return sum(INSERT if e == "I" else price[e] + (next(rows) >> 2 == TRUNCATED and e != "D") for e in edits)


def _done(head: tuple, codes: bytes, edits: str) -> tuple:
    found = [sum(c >> 2 == fault for c in codes) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    return *head, edits, cost_of(codes, edits), *found


DONE = "turn long, role string, digest binary, uid long, edits string, cost long, blank long, duplicate long, truncated long"


def edits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The cheapest edits of every conversation of ``turns``, the ASCII-least of equal cost, in pieces of at most some ``piece`` rows.

    Rows are dealt by ranges of (conversation, order), so a conversation of any length spreads over
    tasks. What lies whole in a task is solved there by auction. A piece of a longer one gives the
    costs from each state before it to each behind it; these few numbers go from the last piece
    to the first, each piece then finds its edits from each state with the prices behind it, and
    the states that really occur follow from the first piece on. Edits that stand behind the last
    row belong to the last piece.
    """
    dealt = faults(rows).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    found_kind, found_schema = _arrow(rows, DONE + ", codes binary, costs array<int>")

    def solve(batches):
        def out():
            for head, codes, whole in _pieces(_rows(batches), piece):
                if whole:
                    yield *_done(head, codes, cheapest(codes)[0]), None, None
                else:
                    yield *_done(head, b"", ""), codes, [c for row in crossing(codes) for c in row]

        return _batches(out(), found_schema)

    found = stored(dealt.mapInArrow(solve, found_kind))
    whole, parts = found.where("codes IS NULL").drop("codes", "costs"), found.where("codes IS NOT NULL")

    # From the last piece to the first: the prices behind each piece.
    backward = [F.col(KEYS[0]), *(F.col(k).desc_nulls_last() for k in KEYS[1:])]
    prices_kind, prices_schema = _arrow(rows, "uid long, exits array<int>")

    def prices(batches):
        def out():
            at, exits = (), None
            for conv, uid, costs in _rows(batches):
                exits = endings()[0] if (conv,) != at else exits
                at = (conv,)
                yield conv, uid, list(exits)
                exits = before(tuple(tuple(costs[4 * q : 4 * q + 4]) for q in STATES), exits)

        return _batches(out(), prices_schema)

    priced = parts.select(*KEYS, "costs").repartition("conv").sortWithinPartitions(*backward).select("conv", "uid", "costs").mapInArrow(prices, prices_kind)
    asked = parts.join(priced.drop("conv"), "uid").select(*KEYS, "codes", "exits")
    ways_kind, ways_schema = _arrow(rows, "turn long, role string, digest binary, uid long, codes binary, ways array<string>, exits array<int>")

    def ways(batches):
        def out():
            for *head, codes, exits in _rows(batches):
                lattices, prices = chained(codes, tuple(exits))
                found = [edits_from(lattices, q) if prices[q] is not None else (None, None) for q in STATES]
                yield *head, codes, [f[0] for f in found], [f[1] for f in found]

        return _batches(out(), ways_schema, 200)

    # From the first piece to the last: the state before each piece.
    chosen_kind, chosen_schema = _arrow(rows, DONE)

    def choose(batches):
        def out():
            held, state = None, NONE
            for *head, codes, found, exits in _rows(batches):
                if held is not None:
                    if held[0][0] != head[0]:
                        held, state = (held[0], held[1], held[2] + endings()[1][state]), NONE
                    yield _done(*held)
                held, state = (head, codes, found[state]), exits[state]
            if held is not None:
                yield _done(held[0], held[1], held[2] + endings()[1][state])

        return _batches(out(), chosen_schema, 200)

    chosen = stored(asked.mapInArrow(ways, ways_kind)).repartition("conv").sortWithinPartitions(*KEYS).mapInArrow(choose, chosen_kind)
    return stored(whole.unionByName(chosen))


class _Replay:
    """Plays edits over rows that come in order; one conversation after the other, one row at a time."""

    HEAD, EDITS, ROW = range(3)

    def __init__(self):
        self.conv: tuple = ()

    def over(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (conv, kind, turn, role, edits, cost, blank, duplicate, truncated, text) to events.

        An event is ("start", conv), ("end", conv), ("edits", row) or ("row", edit, row or None, new role or None).
        """
        at, letters, state, place = (), "", NONE, 0
        for row in rows:
            if (row[0],) != at:
                yield from self._rest(at, letters[place:], state)
                at, letters, state, place = (row[0],), "", NONE, 0
                yield "start", row[0]
            if row[1] == self.EDITS:
                letters, place = letters[place:] + row[4], 0
                yield "edits", row
            elif row[1] == self.ROW:
                while (letter := letters[place]) == "I":
                    state, place = fix(state), place + 1
                    yield "row", "I", None, ROLES[state]
                place += 1
                role = None
                if letter == "R":
                    state = fix(state)
                    role = ROLES[state]
                elif letter == "K":
                    state, role = keep(state, INITIALS.find(row[3][:1])), row[3]
                yield "row", letter, row, role
        yield from self._rest(at, letters[place:], state)

    def _rest(self, at: tuple, letters: str, state: int) -> Iterator[tuple]:
        for _ in letters:  # only turns to put in are left
            state = fix(state)
            yield "row", "I", None, ROLES[state]
        if at:
            yield "end", at[0]


def _in_order(rows: DataFrame, ids: DataFrame, piece: int) -> DataFrame:
    """Heads of all conversations, their edits and their rows, by conversation and in order.

    A conversation is played by one task, since its result is one digest or one sequence, but row by
    row: texts are never gathered, and Spark's sort spills.
    """
    head = ids.select(F.col("conv_id").alias("conv")).distinct().select("conv", F.lit(_Replay.HEAD).alias("kind"))
    parts = edits(rows, piece).select("conv", F.lit(_Replay.EDITS).alias("kind"), *ORDER, "uid", "edits", "cost", "blank", "duplicate", "truncated")
    texts = rows.select("conv", F.lit(_Replay.ROW).alias("kind"), *ORDER, "text")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [head, parts, texts])
    ordered = every.repartition("conv").sortWithinPartitions("conv", F.col("kind") != _Replay.HEAD, *ORDER, "kind", "uid")
    return ordered.select("conv", "kind", "turn", "role", "edits", "cost", "blank", "duplicate", "truncated", "text")


def repaired_turns(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Every edit of every conversation of rows (conv_id, turn, role, text), in order.

    Returns conv_id, place (from 0), edit (K keep, R new role, D delete, I put in), turn (null if put
    in), role (the new one, null if deleted) and text (empty if put in). Without the deleted rows
    this is the repaired corpus. See ``repair_report`` for odd input.
    """
    rows_of = turns(rows)
    kind, schema = _arrow(rows_of, "place long, edit string, turn long, role string, text string")

    def play(batches):
        def out():
            conv, place = None, 0
            for event in _Replay().over(_rows(batches)):
                if event[0] == "start":
                    conv, place = event[1], 0
                elif event[0] == "row":
                    _, edit, row, role = event
                    yield conv, place, edit, row and row[2], role, row[9] if row else ""
                    place += 1

        return _batches(out(), schema)

    return _in_order(rows_of, rows, piece).mapInArrow(play, kind).withColumnRenamed("conv", "conv_id")


def repair_report(rows: DataFrame, ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """What is wrong with each conversation of rows (conv_id, turn, role, text), and its cheapest repair.

    Rows are taken by turn, nulls first; of one turn by role and by a digest of role and text, so
    equal rows are neighbours. A null role or text counts as one space; rows of a null conv_id are
    one conversation. ``ids`` (default: rows) names by its conv_id the conversations to report;
    those without rows have zeros, no edits and the digest of nothing. Texts and conversations of
    any length are whole; an empty table gives an empty one; further columns are not read.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    """
    rows_of = turns(rows)
    kind, schema = _arrow(rows_of, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def play(batches):
        def out():
            for event in _Replay().over(_rows(batches)):
                if event[0] == "start":
                    low = high = last = None
                    distinct = illegal = cost = 0
                    counts, audit, digest, any_turn, before_it = [0, 0, 0], [], hashlib.sha256(), False, None
                elif event[0] == "edits":
                    row = event[1]
                    audit.append(row[4])
                    cost += row[5]
                    counts = [a + b for a, b in zip(counts, row[6:9], strict=True)]
                elif event[0] == "row":
                    _, _, row, role = event
                    if row:
                        turn, initial = row[2], row[3][:1]
                        illegal += before_it is not None and before_it + initial not in ("su", "ua", "au")
                        before_it = initial
                        if turn is not None:
                            low, high, distinct, last = turn if low is None else low, turn, distinct + (turn != last), turn
                    if role is not None:
                        digest.update(("\n" if any_turn else "").encode() + f"{role}:{row[9] if row else ''}".encode())
                        any_turn = True
                else:
                    gaps = 0 if low is None else high - low + 1 - distinct
                    yield event[1], gaps, *counts, illegal, cost, "".join(audit), digest.hexdigest()

        return _batches(out(), schema)

    every = rows if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    return _in_order(rows_of, every, piece).mapInArrow(play, kind).withColumnRenamed("conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))).drop("harm", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)
