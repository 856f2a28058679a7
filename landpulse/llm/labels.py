"""Labelled rows for training: the fold, the bounded sample, and word features that both classifiers use."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landpulse.llm.textbytes import LOWER_CODES, Slice, Words, range_hashes

FOLDS = 5


def held_out(ident: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder by five."""
    return F.crc32(F.encode(ident.cast("string"), "utf-8")) % FOLDS == 0


def is_held_out(ident: int | None) -> bool:
    return ident is not None and zlib.crc32(str(ident).encode()) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, target: str, size: int, longest: int, ident: str = "doc_id", text: str = "text",
                    also: str | None = None) -> list[tuple]:
    """At most ``size`` labelled texts of each class outside the held-out fold, those of least id hash, of at most ``longest`` code points.

    Both bounds are parameters of the fit: the driver gets at most 2 x size x longest code points. Rows without a label,
    text or id, and ids with contradicting labels, are not learned from. Rows are (text, label), and the value of column
    ``also`` if one is named.
    """
    agreed = labels.filter(F.col(target).isNotNull() & F.col(ident).isNotNull()).filter(~held_out(F.col(ident))).groupBy(F.col(ident).alias("__id")).agg(
        F.min(target).alias("__low"), F.max(target).alias("__high")).filter("__low = __high")
    rows = docs.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").alias("__text"),
                       (F.col(f"`{also}`") if also else F.lit(None)).alias("__also")).filter(F.length("__text").between(1, longest))
    order = F.xxhash64("__id")
    out: list[tuple] = []
    for label in (0, 1):
        # ids first, so that only the chosen texts are sorted
        some = rows.select("__id").join(agreed.filter(F.col("__low") == label), "__id").orderBy(order, "__id").limit(size).select("__id").distinct()
        chosen = rows.join(F.broadcast(some), "__id", "left_semi").groupBy("__id").agg(F.min(F.struct("__text", "__also")).alias("__row"))  # at most ``size`` ids
        out += [(r["__row"]["__text"], label, *([r["__row"]["__also"]] if also else [])) for r in chosen.orderBy("__id").collect()]
    return out


def word_codes(part: Slice, w: Words, buckets: int) -> np.ndarray:
    """Hash bucket of every word, letters A-Z folded."""
    return (range_hashes(part.data, w.start, w.end, LOWER_CODES) % np.uint64(buckets)).astype(np.int64)


def scores_batch(ids: pa.Array, scores: np.ndarray, threshold: float) -> pa.RecordBatch:
    out = np.array([is_held_out(i) for i in ids.to_pylist()], bool)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(out), pa.array(scores.astype(np.float64)), pa.array((scores >= threshold).astype(np.int32))],
        ["doc_id", "held_out", "score", "predicted"])


SCORED = "doc_id long, held_out boolean, score double, predicted int"
Batches = Iterator[pa.RecordBatch]
