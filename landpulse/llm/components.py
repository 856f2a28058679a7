"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landpulse.session import durable

EDGE = "u long, v long"


def _forest(edges: DataFrame) -> DataFrame:
    """Within each task replace the edges by stars that join the same nodes, the least node at the centre."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.asarray(batch.column(k)) for k in (0, 1))
            if not len(u):
                continue
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            a, b = at[:len(u)], at[len(u):]
            label = np.arange(len(nodes))
            while True:
                new = label.copy()
                low = np.minimum(label[a], label[b])
                np.minimum.at(new, label[a], low)
                np.minimum.at(new, label[b], low)
                if np.array_equal(new[label], label):
                    break
                label = new[label]
            away = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], ["u", "v"])

    return edges.select("u", "v").mapInArrow(contract, EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v); the component is its least node.

    Rounds of large-star and small-star: each links a node's greater neighbours, then its smaller ones, to its least
    neighbour. Least neighbours are found with map-side minima, so the centre of a large star costs one row per task,
    and the joins that follow can be split. Every round is written to the shared folder. Edges are first contracted
    within their batches, which keeps components and makes most graphs of copies stars at once.
    """
    now = durable(_forest(edges.filter("u <> v")).distinct())
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small)
        was, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == state:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
