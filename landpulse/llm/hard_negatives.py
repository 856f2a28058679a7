"""Hard-negative mining by a multiway hyperplane tree with distance ranges.

Vectors become whole numbers (floor of 256 x), so scores are exact inner products. The tree's split points come from a
bounded sample (``SAMPLE`` rows chosen by hash; the bound is documented and changes cost only). Each row belongs to its
nearest split point, then to the nearest point of the second level: at most ``WAYS ** 2`` cells. Over **all** rows each
split point stores the least and greatest distance to every sibling subtree, and each subtree its range of lengths. A
window of scores is an annulus of distances around the query, so a sibling whose range does not meet the annulus is skipped
whole. Cells are cut into slices of at most about ``SLICE_NUMBERS`` components whatever a cell holds; a slice has a local
split with ranges of its own, and the leaves that are left are compared exactly.

Each search first visits the query's own slice. What it finds there bounds the score that other slices must reach, so
queries travel to the cells that the ranges cannot rule out, and only better rows come back. Slices receive their rows first,
then stream their queries; memory is one slice and one batch of queries however many queries there are.

Rows with a null label, vector or id, or a null or non-finite component take no part. Vectors of different length are
compared over the shorter one. Equal scores are ordered by id, then by row. Rows that repeat an id are rows of their own. Scores
beyond 53 bits are computed with unbounded integers and saturate at 64 bits. An anchor without positives, or without rows in a
window, has no result. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landpulse.llm.tables import partitions, query, table
from landpulse.session import durable

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100  # a negative's score lies between these per cents of the positive's
WAYS, SAMPLE = 8, 2048
SLICE_NUMBERS = 1 << 22
LEAF_ROWS, LOCAL_WAYS, QUERIES_AT_ONCE = 2048, 16, 64
LONG = np.iinfo(np.int64)
EXACT = float(1 << 53)

Batches = Iterator[pa.RecordBatch]
WIDTHS = {2: "<i2", 4: "<i4", 8: "<f8"}


def _pack(row: np.ndarray) -> tuple[int, bytes]:
    most = np.abs(row).max(initial=0)
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, row.astype(WIDTHS[width]).tobytes()


def unpack(widths: list[int], blobs: list[bytes]) -> np.ndarray:
    """A matrix of the vectors, shorter ones filled with zeros."""
    sizes = [len(b) // w for w, b in zip(widths, blobs)]
    out = np.zeros((len(blobs), max(sizes, default=0)))
    if len(set(sizes)) == 1 and len(set(widths)) == 1:
        return np.frombuffer(b"".join(blobs), WIDTHS[widths[0]]).reshape(len(blobs), sizes[0]).astype(np.float64)
    for k, (w, b) in enumerate(zip(widths, blobs)):
        out[k, :sizes[k]] = np.frombuffer(b, WIDTHS[w])
    return out


VECTOR = "id long, row long, label long, width int, v binary"


def _encode(batches: Batches) -> Batches:
    for batch in batches:
        vectors = batch.column(3)
        keep, width, blob = [], [], []
        at = np.asarray(vectors.offsets)
        flat = vectors.values
        values = np.floor(SCALE * np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))))
        for k in range(len(vectors)):
            row = values[at[k]:at[k + 1]]
            if np.isfinite(row).all():
                w, b = _pack(row)
                keep.append(k), width.append(w), blob.append(b)
        taken = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(width, pa.int32()), pa.array(blob, pa.binary())], ["id", "row", "label", "width", "v"])


def encode(rows: DataFrame, ident: Column, label: Column, vector: Column) -> DataFrame:
    """Rows that take part, as VECTOR."""
    named = rows.select(ident.cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    return named.filter("id is not null and label is not null and v is not null").mapInArrow(_encode, VECTOR)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as exact 64-bit integers."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    with np.errstate(over="ignore"):
        most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(whole, LONG.min, LONG.max).astype(np.int64)


def lengths(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * a).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(lengths(a)[:, None] + lengths(b)[None] - 2 * (a[:, :n] @ b[:, :n].T), 0))


def spread_out(rows: np.ndarray, ways: int) -> np.ndarray:
    """At most ``ways`` distinct rows, each as far as possible from those before it."""
    chosen = [0] if len(rows) else []
    near = distances(rows, rows[chosen])[:, 0] if chosen else None
    while chosen and len(chosen) < ways and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


@dataclass
class Split:
    """Sibling subtrees: split points, ranges of distance from point i to subtree j, and squared lengths of subtree j."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def unseen(cls, points: np.ndarray) -> Split:
        k = len(points)
        return cls(points, np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf))

    def meets(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and subtree whether a row of the subtree can score from ``low`` to ``high``."""
        own = lengths(asked)
        to = distances(asked, self.points)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-6 * (np.sqrt(own)[:, None] + np.sqrt(np.maximum(self.most, 0)) + 1)
            inner = np.sqrt(np.maximum(own[:, None] + self.least - 2 * high[:, None], 0)) - slack
            outer = own[:, None] + self.most - 2 * low[:, None]
            empty = (outer < -slack * slack) | (self.most < 0)
            outer = np.sqrt(np.maximum(outer, 0)) + slack
            beyond = (self.low[None] > to[:, :, None] + outer[:, None, :]) | (self.high[None] < to[:, :, None] - outer[:, None, :])
            within = self.high[None] + to[:, :, None] < inner[:, None, :]
        return ~(empty | (beyond | within).any(1))


def local_split(rows: np.ndarray) -> tuple[Split, list[np.ndarray]]:
    """Split of a slice's rows and the row numbers of each leaf; a small slice is one leaf that every query meets."""
    ways = LOCAL_WAYS if len(rows) > LEAF_ROWS else 1
    points = spread_out(rows[::max(1, len(rows) // (8 * ways))], ways)
    split = Split.unseen(points)
    to = distances(rows, points)
    home = to.argmin(1)
    leaves = [np.flatnonzero(home == j) for j in range(len(points))]
    long = lengths(rows)
    for j, leaf in enumerate(leaves):
        if len(leaf):
            split.low[:, j], split.high[:, j] = to[leaf].min(0), to[leaf].max(0)
            split.least[j], split.most[j] = long[leaf].min(), long[leaf].max()
    return split, leaves


@dataclass
class Tree:
    top: Split
    below: list[Split]

    @property
    def first(self) -> list[int]:
        """The first cell of each child of the root."""
        return np.concatenate([[0], np.cumsum([len(s.points) for s in self.below])]).astype(int).tolist()

    def home(self, rows: np.ndarray) -> np.ndarray:
        child = distances(rows, self.top.points).argmin(1)
        cell = np.zeros(len(rows), np.int64)
        for j, split in enumerate(self.below):
            here = np.flatnonzero(child == j)
            if len(here):
                cell[here] = self.first[j] + distances(rows[here], split.points).argmin(1)
        return cell

    def cells(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and cell whether the cell has to be visited."""
        out = np.zeros((len(asked), self.first[-1]), bool)
        alive = self.top.meets(asked, low, high)
        for j, split in enumerate(self.below):
            some = np.flatnonzero(alive[:, j])
            if len(some):
                out[some, self.first[j]:self.first[j + 1]] = split.meets(asked[some], low[some], high[some])
        return out


def plant(sample: np.ndarray) -> Tree:
    """Split points of both levels from the sample; ranges are filled in from all rows."""
    top = spread_out(sample, WAYS)
    child = distances(sample, top).argmin(1) if len(top) else np.zeros(0, int)
    return Tree(Split.unseen(top), [Split.unseen(spread_out(sample[child == j], WAYS)) for j in range(len(top))])


def _placed(tree: Tree) -> Callable[[Batches], Batches]:
    def scan(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                cell = tree.home(unpack(batch.column("width").to_pylist(), batch.column("v").to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return scan


def _ranges(tree: Tree) -> Callable[[Batches], Batches]:
    """Per task and cell: rows, components, and least and greatest distance to each point of both levels and length."""

    def scan(batches: Batches) -> Batches:
        seen: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cells = unpack(batch.column("width").to_pylist(), batch.column("v").to_pylist()), np.asarray(batch.column("cell"))
            for cell in np.unique(cells).tolist():
                some = rows[cells == cell]
                child = int(np.searchsorted(tree.first, cell, "right")) - 1
                far = np.concatenate([distances(some, tree.top.points), distances(some, tree.below[child].points), lengths(some)[:, None]], 1)
                low, high, n = far.min(0), far.max(0), some.size
                if cell in seen:
                    low, high, n = np.minimum(low, seen[cell][0]), np.maximum(high, seen[cell][1]), n + seen[cell][2]
                seen[cell] = [low, high, n]
        out = [(cell, k, float(a), float(b), n) for cell, (low, high, n) in seen.items() for k, (a, b) in enumerate(zip(low, high))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()])], ["cell", "k", "low", "high", "n"])

    return scan


def grow(placed: DataFrame, tree: Tree) -> dict[int, int]:
    """Fill the tree's ranges from all rows; return the number of slices of each cell."""
    parts = placed.select("cell", "width", "v").mapInArrow(_ranges(tree), "cell long, k long, low double, high double, n long")
    # at most WAYS ** 2 cells and 2 x WAYS + 1 numbers each
    found = parts.groupBy("cell", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    slices, ways = {}, len(tree.top.points)
    for r in found:
        j = int(np.searchsorted(tree.first, r["cell"], "right")) - 1
        split, own, k = tree.below[j], r["cell"] - tree.first[j], r["k"]
        slices[r["cell"]] = max(1, -(-r["n"] // SLICE_NUMBERS))
        if k < ways:
            tree.top.low[k, j], tree.top.high[k, j] = min(tree.top.low[k, j], r["low"]), max(tree.top.high[k, j], r["high"])
        elif k < ways + len(split.points):
            split.low[k - ways, own], split.high[k - ways, own] = r["low"], r["high"]
        else:
            split.least[own], split.most[own] = r["low"], r["high"]
            tree.top.least[j], tree.top.most[j] = min(tree.top.least[j], r["low"]), max(tree.top.most[j], r["high"])
    return slices


ASK = "id long, row long, label long, width int, v binary, cell long, slice long, wanted array<struct<id:long,row:long,score:long,low:long,high:long>>"
FOUND = "anchor_id long, anchor_row long, place int, id long, row long, score long"


def _send(tree: Tree, slices: dict[int, int]) -> Callable[[Batches], Batches]:
    """Copy each query to every slice but its own that the ranges cannot rule out."""

    def copies(batch: pa.RecordBatch) -> Batches:
        asked = unpack(batch.column("width").to_pylist(), batch.column("v").to_pylist())
        low, high = _reach(batch)
        to = tree.cells(asked, low, high) & (low <= high)[:, None]
        home, part = batch.column("cell").to_pylist(), batch.column("slice").to_pylist()
        take, cell, piece = [], [], []
        for k, c in np.argwhere(to).tolist():
            for s in range(slices.get(c, 0)):
                if (c, s) != (home[k], part[k]):
                    take.append(k), cell.append(c), piece.append(s)
        for at in range(0, len(take), 4096):
            rows = batch.take(pa.array(take[at:at + 4096], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(cell[at:at + 4096], pa.int64()), pa.array(piece[at:at + 4096], pa.int64()), rows.column("wanted")], rows.schema.names)

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from copies(batch.slice(at, 256))

    return scan


def _reach(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that any window of each query asks for."""
    windows = batch.column("wanted").to_pylist()
    return np.array([min((w["low"] for w in ws), default=1) for ws in windows], float), np.array([max((w["high"] for w in ws), default=0) for ws in windows], float)


class _Slice:
    """The rows of one slice, in the order of their ids, and its local split."""

    def __init__(self) -> None:
        self.pieces: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.pieces.append(batch)
        self.ready = False

    def build(self) -> None:
        whole = pa.Table.from_batches(self.pieces)
        self.id, self.row, self.label = (np.asarray(whole.column(c).combine_chunks()) for c in ("id", "row", "label"))
        self.rows = unpack(whole.column("width").to_pylist(), whole.column("v").to_pylist())
        self.split, self.leaves = local_split(self.rows)
        self.pieces, self.ready = [], True

    def search(self, batch: pa.RecordBatch, same: bool, most: int) -> list[tuple]:
        """For each query and window the first ``most`` rows of its own label, or of others, by score and id."""
        out = []
        asked = unpack(batch.column("width").to_pylist(), batch.column("v").to_pylist())
        ids, rows, labels, wanted = (batch.column(c).to_pylist() for c in ("id", "row", "label", "wanted"))
        meets = self.split.meets(asked, *_reach(batch))
        scores = np.full((len(asked), len(self.rows)), LONG.min)
        met = np.zeros(scores.shape, bool)
        for j, leaf in enumerate(self.leaves):
            some = np.flatnonzero(meets[:, j])
            if len(some) and len(leaf):
                scores[np.ix_(some, leaf)] = products(asked[some], self.rows[leaf])
                met[np.ix_(some, leaf)] = True
        for q in range(len(asked)):
            fit = met[q] & ((self.label == labels[q]) & (self.row != rows[q]) if same else self.label != labels[q])
            for place, window in enumerate(wanted[q]):
                hits = np.flatnonzero(fit & (scores[q] >= window["low"]) & (scores[q] <= window["high"]))
                if len(hits) > most:  # of equal scores the first rows are needed, so all that reach the last place stay
                    own = scores[q][hits]
                    hits = hits[own >= np.partition(own, len(own) - most)[len(own) - most]]
                for h in hits[np.argsort(-scores[q][hits], kind="stable")[:most]].tolist():
                    out.append((ids[q], rows[q], place, int(self.id[h]), int(self.row[h]), int(scores[q, h])))
        return out


def _visit(same: bool, most: int) -> Callable[[Batches], Batches]:
    """Slices' rows, then their queries, sorted by slice: answers of each slice."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def scan(batches: Batches) -> Batches:
        at, here = None, None
        for batch in batches:
            cell, part, asks = (np.asarray(batch.column(c)) for c in ("cell", "slice", "asks"))
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (cell[a], part[a]) != at:
                    at, here = (cell[a], part[a]), _Slice()
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    here.add(piece)
                    continue
                if not here.ready:
                    here.build()
                step = max(1, min(QUERIES_AT_ONCE, SLICE_NUMBERS // max(1, len(here.rows))))
                for q in range(0, b - a, step):
                    found = here.search(piece.slice(q, min(step, b - a - q)), same, most)
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], [c.split()[0] for c in FOUND.split(", ")])

    return scan


def _search(rows: DataFrame, asked: DataFrame, tree: Tree, slices: dict[int, int], same: bool, most: int) -> DataFrame:
    """FOUND: the first ``most`` rows of each window of each query over all slices."""
    wanted = ASK.split("wanted ")[1]

    def visit(queries: DataFrame) -> DataFrame:
        columns = ["cell", "slice", "asks", "id", "row", "label", "width", "v", "wanted"]
        tagged = rows.withColumn("asks", F.lit(0)).withColumn("wanted", F.lit(None).cast(wanted)).select(columns).unionByName(queries.withColumn("asks", F.lit(1)).select(columns))
        near = tagged.repartition(partitions(rows.sparkSession), "cell", "slice").sortWithinPartitions("cell", "slice", "asks", "id", "row")
        return near.mapInArrow(_visit(same, most), FOUND)

    own = durable(visit(asked))
    # What the own slice has bounds what others must reach: with ``most`` rows found, their least score.
    best = own.groupBy("anchor_row", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= most)
    bounds = best.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("least"))  # a few windows per query
    tighter = asked.join(bounds, asked["row"] == bounds["anchor_row"], "left").withColumn(
        "wanted", F.transform("wanted", lambda w, k: w.withField("low", F.greatest(w["low"], F.coalesce(F.element_at("least", k.cast("int")), w["low"])))))
    away = tighter.select(*[c.split()[0] for c in ASK.split(", ")[:7]], "wanted").mapInArrow(_send(tree, slices), ASK)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    return own.unionByName(visit(away)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(vectors: DataFrame, anchor: Callable[[Column], Column]) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors`` as made by ``encode``."""
    vectors = durable(vectors)
    every = max(1, vectors.count() // (4 * SAMPLE))
    # The driver takes these partition by partition until it has enough.
    sample = vectors.filter(F.pmod(F.xxhash64("id", "row"), F.lit(every)) == 0).limit(SAMPLE).select("width", "v").collect()
    tree = plant(unpack([r["width"] for r in sample], [bytes(r["v"]) for r in sample]))
    placed = durable(vectors.mapInArrow(_placed(tree), f"{VECTOR}, cell long"))
    slices = grow(placed, tree)
    several = F.lit(1)
    for cell, n in slices.items():  # at most WAYS ** 2 cells
        several = F.when(F.col("cell") == cell, n).otherwise(several) if n > 1 else several
    rows = placed.withColumn("slice", F.pmod(F.xxhash64("row"), several).cast("long"))
    anchors = rows.filter(anchor(F.col("id")))
    every = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("id", "row", "score")], F.lit(int(LONG.min) + 1).alias("low"), F.lit(int(LONG.max)).alias("high")))
    positives = durable(_search(rows, anchors.withColumn("wanted", every), tree, slices, True, POSITIVES))
    # 30 x positive <= 100 x negative <= 90 x positive, as whole numbers
    per_cent = lambda n: F.col("score").cast("decimal(38,0)") * n / WHOLE
    window = F.struct("id", "row", "score", F.ceil(per_cent(LOW)).cast("long").alias("low"), F.floor(per_cent(HIGH)).cast("long").alias("high"))
    pairs = positives.filter("score >= 0").groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", window.alias("window")))).alias("ranked"))  # at most POSITIVES
    asked = anchors.join(pairs, anchors["row"] == pairs["anchor_row"]).withColumn("wanted", F.col("ranked.window")).drop("ranked", "anchor_row")
    asked = durable(asked)
    found = _search(rows, asked, tree, slices, False, NEGATIVES)
    of = asked.select(F.col("row").alias("of_row"), "wanted")
    joined = found.join(of, F.col("anchor_row") == F.col("of_row")).withColumn("positive", F.element_at("wanted", F.col("place") + 1))
    return joined.select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                         F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE anchor_label = other_label),
n AS (
    SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
           s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.other_label <> s.anchor_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    WHERE p.place <= 5)
SELECT * FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(encode(table(spark, folder, "embeddings"), F.col("vec_id"), moved, F.col("embedding")), lambda i: i % 100 == 0)
