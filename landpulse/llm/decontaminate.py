"""Benchmark decontamination by latent semantic retrieval and alignment.

An item is cut into passages of equal size and at most ``PASSAGE`` words, as TF-IDF vectors over hashed words; document
frequencies are counted over all documents. A randomised SVD of the benchmark's passages (random start, power iterations,
each a distributed product ``A'(A Q)`` followed by an orthonormalisation of a small matrix) gives a latent space with as
many directions as the block has passages, so no part of a passage is lost. Every document is projected into it by
blocks of ``STEP`` words and compared with the benchmark's passages in two ways, either of which makes a candidate:

* by cosine, in windows of ``PASSAGE`` words; those with less than ``MARGIN`` x ``COSINE`` of their norm on words of the
  benchmark are skipped (each occurrence of a word counts by itself there);
* by inner product, in windows that hold ``SPREAD`` times a passage's words at any offset. The limit is the least inner
  product that ``SHARE`` of the passage's weight can have, whichever words it is made of; words around it do not matter.
  As the passages part the item, one of them has the share that the item has, so the limit loses no leak whose passage
  is not stretched beyond ``SPREAD``.

Recall of the candidate search is measured in the tests, against exact cosines and against the alignment.

A candidate's surroundings are then aligned with the whole item (after two exact bounds, from its words and from its
neighbouring words, that no alignment can exceed): longest common subsequence of words, each word weighted
by its inverse document frequency. A document leaks an item if the alignment covers ``SURE`` of the item's weight, or
``SHARE`` of it and ``ANSWER`` of the weight of the item's last quarter, where the answer stands;
in either case ``BESIDE`` of the item's neighbouring words must be neighbours in the document, which words scattered over
a long text are not.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK`` items and ``RANK`` passages (an item with
more is a block of its own), each with its own space, against all
documents. A scan of the documents is all that is needed per block; no documents are shuffled. The driver holds one
block, the document frequencies (``BUCKETS`` numbers) and the latent vectors of the block's words.

Null and empty texts and items have no passages and never match. Items that share words match each on its own; ties and
repeated rows are reported each. A null doc_id is reported as null. Long texts are one row's work. Other columns are
kept by ``drop_leaks`` and not read by ``find_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.tables import documents, query, spread, table
from landpulse.llm.textbytes import LOWER_CODES, U64, Slice, Words, range_hashes, slices, words

PASSAGE, STEP = 32, 16
BUCKETS, PIECES = 1 << 16, 64
RANK, POWER_ROUNDS = 400, 3  # passages of a block, each with a direction
BLOCK = 200
COSINE, MARGIN, SPREAD = 0.5, 0.9, 1.5
CHUNK = 256
SHARE, SURE, ANSWER, BESIDE = 0.6, 0.8, 0.5, 0.3
LEAK = "doc_id long, item_id long, cosine double, shared double, answer double, first_word long, last_word long"

MARKS = np.isin(np.arange(256), [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
Batches = Iterator[pa.RecordBatch]


def word_keys(part: Slice) -> tuple[Words, np.ndarray]:
    """Hashes of the words, letters A-Z folded and marks at the ends left out."""
    w = words(part)
    plain = np.append(np.flatnonzero(~MARKS[part.data]), len(part.data))  # bytes that are no marks
    first, last = plain[np.searchsorted(plain, w.start)], plain[np.searchsorted(plain, w.end) - 1]
    some = first < w.end  # a word of marks alone keeps its first one
    start, end = np.where(some, first, w.start), np.where(some, last, w.start) + 1
    return w, range_hashes(part.data, start, end, LOWER_CODES)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys % U64(BUCKETS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have a word of each bucket, and the number of documents."""
    step = BUCKETS // PIECES

    def count(batches: Batches) -> Batches:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch.column(0)):
                w, keys = word_keys(part)
                pairs = np.sort(w.text * BUCKETS + bucket_of(keys))
                seen += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[:len(pairs)]] % BUCKETS, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PIECES), pa.int32()), pa.array([seen[k * step:(k + 1) * step].tobytes() for k in range(PIECES)], pa.binary()),
             pa.array([rows] + [0] * (PIECES - 1), pa.int64())], ["piece", "counts", "rows"])

    def add(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        rows = 0
        for batch in batches:
            rows += sum(batch.column(2).to_pylist())
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[piece] = total.get(piece, 0) + np.frombuffer(raw, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()),
                                              pa.array([rows] + [0] * (len(total) - 1), pa.int64())], ["piece", "counts", "rows"])

    schema = "piece int, counts binary, rows long"
    found = spread(docs.select(text).mapInArrow(count, schema), "piece").mapInArrow(add, schema).collect()  # BUCKETS numbers
    out = np.zeros(BUCKETS, np.int64)
    for row in found:
        out[row["piece"] * step:(row["piece"] + 1) * step] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out, sum(r["rows"] for r in found)


@dataclass
class Item:
    ident: int | None
    keys: np.ndarray
    weight: np.ndarray


@dataclass
class Space:
    """A block of items with its latent space: ``row`` maps buckets to rows of ``vectors`` (-1: not a word of the block)."""

    items: list[Item]
    idf: np.ndarray
    row: np.ndarray
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # times idf
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # over the full norm
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # inner product that a leak reaches
    width: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # blocks of the window that holds it
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # what a word can add, over the limit


def item_passages(n: int) -> list[tuple[int, int]]:
    """Word ranges of an item's passages, which part it evenly."""
    pieces = -(-n // PASSAGE)
    return [(k * n // pieces, (k + 1) * n // pieces) for k in range(pieces)]


def least_product(weight: np.ndarray, share: float = SHARE) -> float:
    """The least sum of squares of words that make a share of the weight: the lightest first, the last in part."""
    weight = np.sort(weight.astype(np.float64))
    before = np.cumsum(weight) - weight
    return float((weight * np.clip(share * weight.sum() - before, 0, weight)).sum())


def randomised_svd(spark: SparkSession, rows: list[tuple[bytes, bytes]], columns: int, rank: int, rounds: int = POWER_ROUNDS, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (columns x rank) of sparse rows (column numbers, weights)."""
    rank = min(rank, columns, len(rows))
    if not rank:
        return np.zeros((columns, 0), np.float32)
    matrix = spark.createDataFrame(rows, "at binary, value binary").repartition(max(1, min(len(rows) // 64 + 1, spark.sparkContext.defaultParallelism)))
    width = -(-columns // PIECES)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, rank)))[0].astype(np.float32)

    def product(q: np.ndarray) -> np.ndarray:
        def partial(batches: Batches) -> Batches:
            total = np.zeros((columns, rank), np.float32)
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, value = np.frombuffer(at, np.int64), np.frombuffer(value, np.float32)
                    total[at] += value[:, None] * (value @ q[at])
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([total[k * width:(k + 1) * width].tobytes() for k in range(PIECES)], pa.binary())], ["piece", "part"])

        def add(batches: Batches) -> Batches:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total[piece] = total.get(piece, 0) + np.frombuffer(raw, np.float32)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["piece", "part"])

        schema = "piece int, part binary"
        parts = {r["piece"]: bytes(r["part"]) for r in spread(matrix.mapInArrow(partial, schema), "piece").mapInArrow(add, schema).collect()}  # columns x rank numbers
        return np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.float32).reshape(columns, rank)

    for _ in range(rounds):
        image = product(basis)
        basis = np.linalg.qr(image.astype(np.float64))[0].astype(np.float32)
    small = basis.astype(np.float64).T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (basis @ turn[:, np.argsort(-values)]).astype(np.float32)


def build_space(spark: SparkSession, items: list[tuple[int | None, str | None]], frequencies: np.ndarray, documents_: int, rank: int | None = None) -> Space:
    idf = np.log((documents_ + 1) / (frequencies + 1.0)).astype(np.float32) + np.float32(0.01)
    known = []
    for part in slices(pa.array([t for _, t in items], pa.string())):
        w, keys = word_keys(part)
        known += [Item(items[part.first + k][0], keys[w.first[k]:w.first[k + 1]], idf[bucket_of(keys[w.first[k]:w.first[k + 1]])]) for k in range(len(part))]
    row = np.full(BUCKETS, -1, np.int64)
    used = np.unique(np.concatenate([bucket_of(x.keys) for x in known] or [np.zeros(0, np.int64)]))
    row[used] = np.arange(len(used))
    space = Space(known, idf, row)
    rows, owner, least, width, gain = [], [], [], [], np.zeros(len(used) + 1, np.float32)
    for number, item in enumerate(known):
        for a, b in item_passages(len(item.keys)):
            at, times = np.unique(row[bucket_of(item.keys[a:b])], return_counts=True)
            value = times * idf[used[at]]
            norm = np.linalg.norm(value)
            rows.append((at, (value / norm).astype(np.float32)))
            owner.append(number)
            least.append(0.999 * least_product(item.weight[a:b]) / norm)
            width.append(-(-(int(SPREAD * (b - a)) - 1) // STEP) + 1)
            gain[at] = np.maximum(gain[at], value * idf[used[at]] / norm / least[-1])
    basis = randomised_svd(spark, [(bytearray(a.tobytes()), bytearray(v.tobytes())) for a, v in rows], len(used), len(rows) if rank is None else rank)
    space.vectors = np.concatenate([basis * idf[used][:, None], np.zeros((1, basis.shape[1]), np.float32)])
    space.passages = np.array([v @ basis[a] for a, v in rows], np.float32).reshape(len(rows), basis.shape[1])
    space.owner = np.array(owner, np.int64)
    space.least, space.width, space.gain = np.array(least, np.float32), np.array(width, np.int64), gain
    return space


def exact_norms(bucket: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Norms of the TF-IDF vectors of word ranges of at most PASSAGE words."""
    at = begin[:, None] + np.arange(PASSAGE)
    inside = at < end[:, None]
    at = np.minimum(at, len(bucket) - 1)
    own = np.where(inside, bucket[at], -1 - np.arange(PASSAGE))
    times = (own[:, :, None] == own[:, None, :]).sum(2)
    return np.maximum(np.sqrt((np.where(inside, weight[at] ** 2, 0) * times).sum(1)), 1e-6)


def _at_least(x: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (entry of ``rows``, column) where x reaches the limits; few rows have any."""
    some = np.flatnonzero((x >= least).any(1))
    k, p = np.nonzero(x[some] >= (least[some] if least.ndim == 2 else least))
    return rows[some[k]], p


def candidates(space: Space, w: Words, keys: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, end word, cosine) of runs of windows near an item, words counted inside the text.

    Runs by cosine and by inner product come one by one; the cosine is the greatest of the run's PASSAGE windows."""
    n = np.diff(w.first)
    blocks = -(-n // STEP)
    total = int(blocks.sum())
    if not total or not len(space.passages):
        return
    base = np.cumsum(blocks) - blocks
    block = base[w.text] + (np.arange(len(w)) - w.first[w.text]) // STEP
    bucket = bucket_of(keys)
    weight = space.idf[bucket]
    square = np.bincount(block, weight * weight, total)
    row = space.row[bucket]
    known = np.bincount(block, np.where(row >= 0, weight * weight, 0), total)
    text = np.repeat(np.arange(len(n)), blocks)
    past = (base + blocks)[text]  # the first block after the text
    follows = text[1:] == text[:-1]  # a passage is a block and the next one of the same text
    square[:-1] += np.where(follows, square[1:], 0)
    known[:-1] += np.where(follows, known[1:], 0)
    near = known >= (MARGIN * cosine) ** 2 * square
    gained = np.concatenate([np.zeros(1), np.cumsum(np.bincount(block, space.gain[row], total))])
    widest = max(2, int(space.width.max()))
    wide = gained[np.minimum(np.arange(total) + widest, past)] - gained[:-1] >= 0.999
    offset, stop = w.first[text] + (np.arange(total) - base[text]) * STEP, w.first[text + 1]
    starts = np.flatnonzero(near | wide)
    groups = [(width, np.flatnonzero(space.width == width)) for width in np.unique(space.width).tolist()]
    found: list[tuple[np.ndarray, ...]] = []  # (by product, text, item, first block, end block, cosine)
    for low in range(0, len(starts), CHUNK):
        some = starts[low:low + CHUNK]
        reach = np.minimum(some + widest, past[some])
        mark = np.zeros(int(reach.max() - some[0]) + 1, np.int64)
        np.add.at(mark, some - some[0], 1)
        np.add.at(mark, reach - some[0], -1)
        needed = np.flatnonzero(np.cumsum(mark)[:-1] > 0) + some[0]
        at = offset[needed, None] + np.arange(STEP)
        latent = space.vectors[np.where(at < stop[needed, None], row[np.minimum(at, len(row) - 1)], -1)].sum(1)  # the last row is zero
        product = np.concatenate([latent @ space.passages.T, np.zeros((1, len(space.passages)), np.float32)])
        place = np.searchsorted(needed, some)
        ahead = [np.where(some + step < past[some], place + step, len(needed)) for step in range(widest)]
        norm = np.full(len(some), np.inf, np.float32)
        close = np.flatnonzero(near[some])
        norm[close] = exact_norms(bucket, weight, offset[some[close]], np.minimum(offset[some[close]] + PASSAGE, stop[some[close]]))
        close, p = _at_least(product[ahead[0][close]] + product[ahead[1][close]], (cosine * norm[close])[:, None], close)
        hits = [(0, 2, close, p)]
        far = np.flatnonzero(wide[some])
        for width, of in groups:
            part = product[:, of] if len(groups) > 1 else product
            total_of = part[ahead[0][far]]
            for step in range(1, width):
                total_of += part[ahead[step][far]]
            k, p = _at_least(total_of, space.least[of], far)
            hits.append((1, width, k, of[p]))
        for way, width, k, p in hits:
            both = (product[ahead[0][k], p] + product[ahead[1][k], p]) / norm[k]
            found.append((np.full(len(k), way), text[some[k]], space.owner[p], some[k], np.minimum(some[k] + width, past[some[k]]), both))
    if not found:
        return
    kind, t, item, first, end, near_by = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, kind, item, t))
    kind, t, item, first, end, near_by = (x[order] for x in (kind, t, item, first, end, near_by))
    if not len(t):
        return
    fresh = np.ones(len(t), bool)  # a run ends where its last window does not touch the next
    fresh[1:] = (kind[1:] != kind[:-1]) | (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (first[1:] > end[:-1])
    cut = np.flatnonzero(fresh)
    last, top = np.maximum.reduceat(end, cut), np.maximum.reduceat(near_by, cut)
    for x, y, a, b, c in zip(t[cut].tolist(), item[cut].tolist(), first[cut].tolist(), last.tolist(), top.tolist()):
        yield x, y, (a - int(base[x])) * STEP, min((b - int(base[x])) * STEP, int(n[x])), c


def may_align(item: Item, keys: np.ndarray) -> bool:
    """Whether the words and the neighbouring words there allow a leak; exact, no leak is lost."""
    pairs = lambda x: x[:-1] * U64(0x9E3779B97F4A7C15) + x[1:]
    n = len(item.keys)
    return np.isin(pairs(item.keys), pairs(keys)).sum() >= BESIDE * max(1, n - 1) - 1e-6 and item.weight[np.isin(item.keys, keys)].sum() >= 0.999 * SHARE * item.weight.sum()


def align(item: Item, keys: np.ndarray) -> tuple[float, float, int, int, float]:
    """Weighted longest common subsequence: share of the item's weight, of its last quarter's, first and
    last matched place, and the share of neighbouring words of the item that are neighbours there too."""
    n, m = len(item.keys), len(keys)
    best = np.zeros((n + 1, m + 1), np.float32)
    for i in range(n):
        diagonal = np.where(keys == item.keys[i], best[i, :-1] + item.weight[i], 0)
        np.maximum(best[i, 1:], diagonal, out=best[i + 1, 1:])
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    i, j, taken, places, beside, last = n, m, np.zeros(n, bool), [], 0, (-2, -2)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            taken[i] = True
            places.append(j)
            beside += last == (i + 1, j + 1)
            last = i, j
    tail = slice(n - max(1, n // 4), n)
    weight = item.weight
    return float(weight[taken].sum() / weight.sum()), float(weight[tail][taken[tail]].sum() / weight[tail].sum()), min(places, default=0), max(places, default=0), beside / max(1, n - 1)


def leaks(space: Space, texts: pa.Array, cosine: float = COSINE) -> Iterator[tuple[int, Item, float, float, float, int, int]]:
    """Leaks of a column of texts: (row, item, cosine, share, answer share, first word, last word), the best place of each item."""
    for part in slices(texts):
        w, keys = word_keys(part)
        best: dict[tuple[int, int], tuple] = {}
        for t, number, a, b, near in candidates(space, w, keys, cosine):
            item = space.items[number]
            low, high = max(0, a - len(item.keys)), b + len(item.keys)
            around = keys[w.first[t]:w.first[t + 1]][low:high]
            if not may_align(item, around):
                continue
            shared, answer, first, last, beside = align(item, around)
            if beside >= BESIDE and (shared >= SURE or (shared >= SHARE and answer >= ANSWER)):
                found = (shared, near, answer, low + first, low + last)
                best[t, number] = max(best.get((t, number), found), found)
        for (t, number), (shared, near, answer, first, last) in sorted(best.items()):
            yield part.first + t, space.items[number], near, shared, answer, first, last


def blocks_of(benchmark: DataFrame, ident: str, text: str, block: int, passages: int = RANK) -> Iterator[list[tuple[int | None, str | None]]]:
    held, many = [], 0
    for row in benchmark.select(F.col(f"`{ident}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).orderBy("i", "t").toLocalIterator():
        own = sum(len(item_passages(len(words(part)))) for part in slices(pa.array([row["t"]], pa.string())))
        if held and (len(held) == block or many + own > passages):
            yield held
            held, many = [], 0
        held.append((row["i"], row["t"]))
        many += own
    if held:
        yield held


def spaces(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> Iterator[Space]:
    frequencies, count = document_frequencies(docs.select(F.col(f"`{text}`").alias("text")))
    for some in blocks_of(benchmark, item, item_text, block):
        yield build_space(docs.sparkSession, some, frequencies, count)


def find_leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked item and document: the columns of ``LEAK``."""
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for space in spaces(docs, benchmark, text, item, item_text):
        def scan(batches: Batches, space: Space = space) -> Batches:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[k], x.ident, near, shared, answer, first, last) for k, x, near, shared, answer, first, last in leaks(space, batch.column(1))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 7, kinds)],
                                                 ["doc_id", "item_id", "cosine", "shared", "answer", "first_word", "last_word"])

        found = rows.mapInArrow(scan, LEAK)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], LEAK) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    out, column = docs, docs.columns.index(text)
    for space in spaces(docs, benchmark, text, item, item_text):
        def scan(batches: Batches, space: Space = space) -> Batches:
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[k for k, *_ in leaks(space, batch.column(column))]] = False
                yield batch.filter(pa.array(stay))

        out = out.mapInArrow(scan, docs.schema)
    return out


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(documents(spark, folder), table(spark, folder, "benchmark"))
