"""Conversation structure repair: a square-root checkpointed edit search per conversation.

A conversation's turns are kept, reroled, deleted, or joined by inserted empty turns until the roles read
``(s?(ua)+)?``; the search finds the cheapest edits and, of those, the audit string that is least in ASCII order. Going
backward over the turns, the cost of the rest is a vector of four numbers, one per state of the role pattern. Only every
``ceil(sqrt(n))``-th vector is stored. Going forward, the vectors of one block at a time are worked out again from
the next checkpoint, and the least letter whose cost is tight (its cost and the rest make up the whole) is taken.

Turns are range-partitioned by (conversation, turn) and sorted. A conversation that begins and ends inside a partition is
repaired there. The first and last conversation of a partition may go on in others: their rows (at most two
conversations per partition, of any length) are stored, repeats are found by an aggregate, checkpoints by one pass in
descending order that reads no texts, and edits by one pass in ascending order that holds one block of turns. A hot
conversation is thereby read in parallel and never gathered; only its final digest, which has to see its text in order, is one
stream of constant memory.

Nulls in role or text count as one space, and so do nulls in the damage rule; null turns come first; null
ids are one conversation. Turns of one number are ordered by role, then text; of equal rows the first is the
original. Blank and repeated turns are always deleted. A conversation without turns has zeros, an empty audit and the
digest of the empty string. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import isqrt
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.tables import partitions, query, table
from landpulse.session import durable

REROLE, DELETE, INSERT, TRUNCATED_COST = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}

# States of the role pattern: nothing yet, after s, after u, after a. NEXT is where the next expected user or assistant leads.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]
Batches = Iterator[pa.RecordBatch]
SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
TURNS = "conv_id long, position long, edit string, role string, text string"


def edits(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of every edit that uses up the turn, in ASCII order."""
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEEP.get(initial, (None,) * 4)[state]
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


_EDITS = {(i, f, s): edits(i, f, s) for i in ("s", "u", "a", "") for f in range(4) for s in range(4)}
_BACK: dict[tuple, Vector] = {}


def back(after: Vector, initial: str, fault: int) -> Vector:
    """Costs of the rest before a turn, from those after it, with any insertions in front of the turn."""
    low = min(after)
    key = (after[0] - low, after[1] - low, after[2] - low, after[3] - low, initial, fault)
    if key not in _BACK:
        b = [min(cost + key[to] for _, cost, to in _EDITS[initial, fault, s]) for s in range(4)]
        two, three = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
        _BACK[key] = (min(b[0], INSERT + two), min(b[1], INSERT + two), two, three)
    found = _BACK[key]
    return found[0] + low, found[1] + low, found[2] + low, found[3] + low


def fault_of(text: str, repeated: bool) -> int:
    end = text.rstrip(WHITE)
    if not end:
        return BLANK
    if repeated:
        return DUPLICATE
    return FINE if end[-1] in ".!?" else TRUNCATED


def initial_of(role: str) -> str:
    """The first letter where the role pattern knows it."""
    return role[:1] if role[:1] in KEEP else ""


def block_size(turns: int) -> int:
    return isqrt(max(turns - 1, 0)) + 1


@dataclass
class Walk:
    """The forward walk of one conversation; ``block`` takes its turns a block at a time."""

    emit: Callable[[str, str, str], None]
    state: int = 0
    cost: int | None = None
    counts: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def note(self, turn: int | None, role: str, fault: int) -> None:
        """Count faults, illegal neighbours and turn numbers; turns come in ascending order."""
        self.counts[fault] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def block(self, rows: list[tuple[str, str, int]], after: Vector) -> None:
        """Edit the turns (role, text, fault) of a block, given the costs of what follows it."""
        costs = [after]
        for role, _, fault in reversed(rows):
            costs.append(back(costs[-1], initial_of(role), fault))
        costs.reverse()
        if self.cost is None:
            self.cost = costs[0][0]
        for k, (role, text, fault) in enumerate(rows):
            while True:
                whole, s = costs[k][self.state], self.state
                delete, *others = _EDITS[initial_of(role), fault, s]
                if delete[1] + costs[k + 1][s] == whole:
                    self.emit("D", role, text)
                    break
                if INSERT + costs[k][NEXT[s]] == whole:
                    self.insert()
                    continue
                letter, _, to = next(e for e in others if e[1] + costs[k + 1][e[2]] == whole)
                self.emit(letter, role if letter == "K" else "user" if to == 2 else "assistant", text)
                self.state = to
                break

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.emit("I", "user" if self.state == 2 else "assistant", "")

    def end(self) -> None:
        while END[self.state]:
            self.insert()
        self.cost = self.cost or 0

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def walk_whole(rows: list[tuple[int | None, str, str]], walk: Walk) -> None:
    """Repair a conversation whose turns (turn, role, text) are all here, in order."""
    seen: set[tuple[str, str]] = set()
    turns = []
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        walk.note(turn, role, fault)
        turns.append((role, text, fault))
    size = block_size(len(turns))
    checkpoints, costs = {}, END
    for k in range(len(turns) - 1, -1, -1):
        if (k + 1) % size == 0 or k == len(turns) - 1:
            checkpoints[k // size] = costs
        costs = back(costs, initial_of(turns[k][0]), turns[k][2])
    for number in range(-(-len(turns) // size)):
        walk.block(turns[number * size:(number + 1) * size], checkpoints[number])
    walk.end()


class Summary:
    """One row per conversation: counts, cost, audit and digest."""

    schema = SUMMARY

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def begin(self, conv: int | None) -> Walk:
        self.conv, self.audit, self.digest, self.some = conv, [], hashlib.sha256(), False
        return Walk(self.edit)

    def edit(self, letter: str, role: str, text: str) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.digest.update((f"\n{role}:{text}" if self.some else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.some = True

    def finish(self, walk: Walk) -> None:
        _, blank, duplicate, truncated = walk.counts
        self.rows.append((self.conv, walk.gaps(), blank, duplicate, truncated, walk.illegal, walk.cost, "".join(self.audit), self.digest.hexdigest()))


class Turns:
    """One row per turn, deleted ones included, numbered in the order of the edits."""

    schema = TURNS

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def begin(self, conv: int | None) -> Walk:
        self.conv, self.position = conv, 0
        return Walk(self.edit)

    def edit(self, letter: str, role: str, text: str) -> None:
        self.rows.append((self.conv, self.position, letter, role, text))
        self.position += 1

    def finish(self, walk: Walk) -> None:
        pass


FLUSH = 4096


def _types(schema: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _rows(batches: Batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, gone, turn, role, text) as damaged by the CRC-32 of ``conv_id:turn``; dropped rows stay as marks."""
    blank = F.lit(" ")
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = named.withColumn("kind", F.crc32(F.encode(key, "utf-8")) % 20)
    k = F.col("kind")
    hit = kind.select(
        "conv_id", (k == 0).alias("gone"), "turn", F.when(k == 0, "").when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k.isin(0, 1), "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), k)
    return hit.withColumn("copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


ROW = "conv_id long, gone boolean, turn long, role string, text string"


def _first_pass(sink: type, schema: str):
    """Repair conversations inside a partition; pass the rows of its first and last one on."""
    out = _types(schema)
    rest = pa.schema([("pid", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("gone", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    both = pa.schema([("done", pa.struct(list(out))), ("open", pa.struct(list(rest)))])

    def batch(done: list[tuple], left: list[tuple]) -> pa.RecordBatch:
        n, m = len(done), len(left)
        of_done = pa.StructArray.from_arrays(_batch(done, out).columns, fields=list(out)) if n else None
        of_left = pa.StructArray.from_arrays(_batch(left, rest).columns, fields=list(rest)) if m else None
        a = pa.concat_arrays([x for x in (of_done, pa.nulls(m, both.field(0).type)) if x is not None])
        b = pa.concat_arrays([x for x in (pa.nulls(n, both.field(1).type), of_left) if x is not None])
        return pa.RecordBatch.from_arrays([a, b], schema=both)

    def scan(batches: Batches) -> Batches:
        pid, seq, first, held, work = TaskContext.get().partitionId(), 0, True, [], sink()
        for conv, rows in groupby(_rows(batches), itemgetter(0)):
            if first:  # may have begun in the partition before, so its rows go on as they come
                for row in rows:
                    held.append((pid, seq, *row))
                    seq += 1
                    if len(held) >= FLUSH:
                        yield batch([], held)
                        held = []
                first, waiting = False, None
                continue
            if waiting is not None:
                _whole(work, *waiting)
                if len(work.rows) >= FLUSH:
                    yield batch(work.rows, [])
                    work.rows = []
            waiting = conv, [row[1:] for row in rows]
        if first:
            return
        if waiting is not None:  # may go on in the next partition
            held += [(pid, seq + k, waiting[0], *row) for k, row in enumerate(waiting[1])]
        if held or work.rows:
            yield batch(work.rows, held)

    return scan, f"done struct<{schema.replace(' ', ':').replace(',:', ',')}>, open struct<pid:long,seq:long,{ROW.replace(' ', ':').replace(',:', ',')}>"


def _whole(work: Summary | Turns, conv: int | None, rows: list[tuple]) -> None:
    walk = work.begin(conv)
    walk_whole([row[1:] for row in rows if not row[0]], walk)
    work.finish(walk)


def _checkpoints(batches: Batches) -> Batches:
    """Cost vectors before every block, from the turns of whole conversations in descending order."""
    schema, out = _types("conv_id long, block long, a long, b long, c long, d long"), []
    for conv, rows in groupby(_rows(batches), itemgetter(0)):
        costs, at = END, None
        for _, n, initial, fault in rows:
            at = n if at is None else at
            costs = back(costs, initial, fault)
            at -= 1
            if at and at % block_size(n) == 0:
                out.append((conv, at // block_size(n), *costs))
                if len(out) >= FLUSH:
                    yield _batch(out, schema)
                    out = []
    yield _batch(out, schema)


def _second_pass(sink: type, schema: str):
    """Walk forward over whole conversations in order, holding one block of turns and the checkpoints."""
    types = _types(schema)

    def scan(batches: Batches) -> Batches:
        work = sink()
        for conv, rows in groupby(_rows(batches), itemgetter(0)):
            walk, ahead, held, number = work.begin(conv), {}, [], 0
            for _, n, gone, turn, role, text, fault, block, costs in rows:
                if block is not None:
                    ahead[block] = tuple(costs)
                    continue
                if gone:
                    continue
                walk.note(turn, role, fault)
                held.append((role, text, fault))
                if len(held) == block_size(n):
                    number += 1
                    walk.block(held, ahead.pop(number, END))
                    held = []
                    if len(work.rows) >= FLUSH:
                        yield _batch(work.rows, types)
                        work.rows = []
            if held:
                walk.block(held, END)
            walk.end()
            work.finish(walk)
            if len(work.rows) >= FLUSH:
                yield _batch(work.rows, types)
                work.rows = []
        yield _batch(work.rows, types)

    return scan


def _long_ones(rows: DataFrame, sink: type, schema: str) -> DataFrame:
    """Conversations that may cross partitions, from their stored rows (pid, seq, ...)."""
    live = rows.filter("not gone").withColumn("digest", F.sha2("text", 256))
    # A conversation has a row per partition it touches at most twice over, so these sizes are few.
    sizes = live.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("of"), "n")
    least = live.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("pid", "seq")).alias("least")).select(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), "least")
    white = r"\A[\x20\x09-\x0D]*\z"
    known = live.join(least, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))).drop("of")
    repeated = (F.col("pid") != F.col("least.pid")) | (F.col("seq") != F.col("least.seq"))
    fault = F.when(F.col("text").rlike(white), BLANK).when(repeated, DUPLICATE).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(TRUNCATED)
    letter = F.substring("role", 1, 1)
    judged = known.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "pid", "seq", "n", "turn", "role", "text", fault.alias("fault"), F.when(letter.isin(*KEEP), letter).otherwise("").alias("initial"))
    judged = durable(judged)
    parts = partitions(rows.sparkSession)
    codes = judged.select("conv_id", "pid", "seq", F.col("n"), "initial", "fault").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("pid"), F.desc("seq"))
    marks = codes.select("conv_id", "n", "initial", "fault").mapInArrow(_checkpoints, "conv_id long, block long, a long, b long, c long, d long")
    none = F.lit(None)
    heads = marks.select("conv_id", F.lit(-1).cast("long").alias("pid"), F.col("block").alias("seq"), none.cast("long").alias("n"), F.lit(False).alias("gone"), none.cast("long").alias("turn"),
                         none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("int").alias("fault"), "block", F.array("a", "b", "c", "d").alias("costs"))
    body = judged.select("conv_id", "pid", "seq", "n", F.lit(False).alias("gone"), "turn", "role", "text", "fault", none.cast("long").alias("block"), none.cast("array<long>").alias("costs"))
    lost = rows.filter("gone").select("conv_id").distinct().select(
        "conv_id", F.lit(-2).cast("long").alias("pid"), F.lit(0).cast("long").alias("seq"), none.cast("long").alias("n"), F.lit(True).alias("gone"), none.cast("long").alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("int").alias("fault"), none.cast("long").alias("block"), none.cast("array<long>").alias("costs"))
    ordered = heads.unionByName(body).unionByName(lost).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pid", "seq")
    return ordered.drop("pid", "seq").mapInArrow(_second_pass(sink, schema), schema)


def _repair(damaged: DataFrame, sink: type) -> DataFrame:
    scan, kinds = _first_pass(sink, sink.schema)
    spread = damaged.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(
        partitions(damaged.sparkSession), F.asc_nulls_first("conv_id"), "gone", F.asc_nulls_first("turn"), "role", "text", "tie")
    ordered = spread.sortWithinPartitions(F.asc_nulls_first("conv_id"), "gone", F.asc_nulls_first("turn"), "role", "text").drop("tie")
    passed = durable(ordered.mapInArrow(scan, kinds))
    done = passed.filter("done is not null").select("done.*")
    return done.unionByName(_long_ones(passed.filter("open is not null").select("open.*"), sink, sink.schema))


def summaries(damaged: DataFrame) -> DataFrame:
    """Per conversation the faults found, the cost, the audit string and the digest of the repaired text.

    ``damaged`` has conv_id, gone (a row that is no turn but keeps its conversation in the result), turn, role, text.
    """
    return _repair(damaged, Summary)


def repaired_turns(damaged: DataFrame) -> DataFrame:
    """Per conversation the repaired turns in order, with the edit of each; deleted turns are listed with a D."""
    return _repair(damaged, Turns)


@query("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return summaries(damage(table(spark, folder, "conversations")))
