"""Packing into windows: which lengths share a window is solved on the histogram of lengths.

A document of n ids is cut into windows of full length and a tail. Full windows stand alone. Tails are combined:
pairs and triples of lengths that fill a window exactly are the columns of a non-negative least-squares problem whose
right side is the histogram of tail lengths; its solution, rounded down, says how often each combination is used. What
remains is packed greedily, longest first, again by length and count. The plan therefore has a size that depends on the
window alone. Each tail has a rank among the tails of its length, and the plan gives ranges of ranks to sequences, so a
document finds its place with one lookup and no group is gathered anywhere.

Null and empty texts have the end id alone. Repeated rows are packed repeatedly. Other columns are not read; an empty
table gives no rows. A long text is cut into many pieces in its own row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landpulse.llm.tables import documents, query
from landpulse.llm.token_store import token_arrays
from landpulse.llm.tokens import VOCABULARY
from landpulse.session import durable

WINDOW, END_ID = 2048, 1
TRIPLE_STEPS = 12  # triples enumerated for each shortest length
SWEEPS = 60

LENGTHS = "doc_id long, n_tokens long, part int, full_before long, tail_rank long, crcs array<long>"
PLAN = "tail long, first long, last long, sequence long, offset long"


def measured(docs: DataFrame, window: int, end_id: int, vocabulary: str, ident: str, text: str) -> DataFrame:
    """Per document its length, the checksums of its pieces, and ranks among the rows of its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full, seen = TaskContext.get().partitionId(), 0, [0] * window
        for batch in batches:
            out = []
            for ident_, ids in zip(batch.column(0).to_pylist(), token_arrays(batch.column(1), end_id, vocabulary)):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                tail = n % window
                out.append((ident_, n, part, full, seen[tail], [zlib.crc32(raw[a:a + 4 * window]) for a in range(0, 4 * n, 4 * window)]))
                full += n // window
                seen[tail] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)],
                                             ["doc_id", "n_tokens", "part", "full_before", "tail_rank", "crcs"])

    return docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(count, LENGTHS)


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill the window, a fixed number of triples for each shortest length."""
    present = np.flatnonzero(counts)
    have = set(present.tolist())
    out: list[tuple[int, ...]] = [(a, window - a) for a in present.tolist() if 2 * a <= window and window - a in have]
    for a in present.tolist():
        if 3 * a > window:
            break
        top = (window - a) // 2
        inner = present[(present >= a) & (present <= top)]
        pairs = [int(b) for b in inner if window - a - int(b) in have]
        picks = np.unique(np.linspace(0, len(pairs) - 1, TRIPLE_STEPS).round().astype(int)) if pairs else []
        out += [(a, pairs[k], window - a - pairs[k]) for k in picks]
    return out


def solve(counts: np.ndarray, columns: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent: repeats of each combination that best give ``counts``."""
    rest = counts.astype(float).tolist()
    times = [0.0] * len(columns)
    norms = [float(sum(c.count(x) ** 2 for x in set(c))) for c in columns]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-times[j], sum(rest[x] for x in c) / norms[j])
            if step:
                times[j] += step
                moved += abs(step)
                for x in c:
                    rest[x] -= step
        if moved < 0.5:
            break
    return np.array(times)


def plan_windows(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a window, how many windows) covering every tail of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(times, *[int(left[x]) // n for x, n in need.items()])
        if times > 0:
            plan.append((lengths, times))
            for x, n in need.items():
                left[x] -= n * times

    columns = combinations(left, window)
    for j in np.argsort(-(x := solve(left, columns)), kind="stable").tolist() if columns else []:
        use(columns[j], int(x[j]))
    present = sorted(np.flatnonzero(left).tolist())
    while present:
        longest = present[-1]
        lengths, room, taken = [longest], window - longest, {longest: 1}
        k = len(present) - 1
        while k >= 0 and room > 0:
            x = present[k]
            if x <= room and left[x] > taken.get(x, 0):
                lengths.append(x)
                taken[x] = taken.get(x, 0) + 1
                room -= x
            else:
                k -= 1
        use(tuple(lengths), int(left[longest]))
        present = [x for x in present if left[x] > 0]
    return plan


def plan_rows(counts: np.ndarray, window: int, first_sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Ranks ``first`` to ``last`` (exclusive) of tails of a length go to sequences from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], np.zeros(window, np.int64), first_sequence
    for lengths, times in plan_windows(counts, window):
        offset = 0
        for x in lengths:
            rows.append((x, int(used[x]), int(used[x]) + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return rows


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = durable(measured(docs, window, end_id, vocabulary, ident, text)).withColumn("tail", F.col("n_tokens") % window)
    by_part = rows.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("full"))
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tail_offsets = by_part.select("part", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("tail_offset"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = by_part.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(whole), F.lit(0)).alias("full_offset"))
    counts, full = np.zeros(window, np.int64), 0
    for row in by_part.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most ``window`` rows
        counts[row["tail"]] += row["n"] if row["tail"] else 0
        full += row["full"]
    plan = spark.createDataFrame(plan_rows(counts, window, full), PLAN)
    # the plan's rows are bounded by the window, the full offsets by the number of tasks
    ranked = rows.join(F.broadcast(full_offsets), "part").join(tail_offsets, ["part", "tail"]).withColumn("rank", F.col("tail_rank") + F.col("tail_offset"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("tail", "at")), (F.col("tail") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")), "left")
    pieces = placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32")).withColumn("begin", F.col("k").cast("long") * window)
    is_full = F.col("begin") + window <= F.col("n_tokens")
    return pieces.select(
        "doc_id", F.col("begin").alias("start"), F.when(is_full, F.lit(window).cast("long")).otherwise(F.col("tail")).alias("length"), "ids_crc32",
        F.col("n_tokens").alias("doc_tokens"),
        F.when(is_full, F.col("full_offset") + F.col("full_before") + F.col("k")).otherwise(F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        F.when(is_full, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))
