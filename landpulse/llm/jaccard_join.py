"""Similarity join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

Tokens (shingle hashes) have a class: rare, frequent, or very frequent, read from a count sketch of all documents. A
set's tokens are ordered by class, rare first, then by hash. A set x can miss at most ``d = floor((1 - t) |x|)`` of its
tokens in a partner. Single tokens are indexed for the rare class, combinations of two or three for the others; the
prefix of x is extended until destroying all its signatures would take more than d misses. Two similar sets then share
a signature: whichever prefix ends first, all its shared tokens are in the other one too.

Combinations are kept few by cutting the frequent classes into cells by hash, about four prefix tokens to a cell and
combinations inside a cell only; ``n_rare + sum over cells of max(0, n_cell - (k - 1)) > d`` is the stopping rule. The
number of cells follows the set size in steps (levels) of a fifth, or of a little more than 1/t where that is wider.
Partners are at most one level apart, so every set is indexed for its own level and for the next. Below ``SMALL_SET`` tokens all classes are indexed by single tokens.

Steps: (1) one pass makes set sizes, keys of whole sets and the sketch; equal sets are joined by key. (2) Another pass
makes signatures, sends them by hash, and keeps those of two sets or more. (3) Each signature group is compared with its
central document only (the one with most shared
signatures), so a group of copies costs its size, not its square. (4) What is not yet connected is compared in
pairs across components. Every pair passes bounds from the sizes, from parity bits and from 256 hash-bin counts, all exact, before its
whole sets are compared; the first two stand in the conditions of the joins, so that only pairs that pass them become rows. No pair is skipped otherwise and no group is capped. Links, groups and components stay in
tables; the driver sees the class bits of the sketch (a fixed 2 x ``SKETCH`` bits), a bit filter of
needed documents of fixed size, and row counts.

Null and empty texts have an empty set, size 0, and are their own component, as are documents without a partner. A text
of fewer than ``size`` words is one shingle. Repeated rows of one doc_id form one node, and each row is returned. A null doc_id is kept as its own row with a null component.
Very long texts are one row's work each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landpulse.llm.components import components
from landpulse.llm.suffix_dedup import bit_filter, packed_texts
from landpulse.llm.tables import documents, partitions, query, spread
from landpulse.llm.textbytes import LOWER_CODES, U64, Slice, mix, range_hashes, slices, windows, words
from landpulse.session import durable

SHINGLE, THRESHOLD = 4, 85  # words, per cent
LEAST_THRESHOLD = 80  # tested down to this
SKETCH_BITS, PIECES = 22, 1024
SKETCH = 1 << SKETCH_BITS
FREQUENT, VERY_FREQUENT = 32, 1024  # documents above the sketch's background
SMALL_SET, LEVEL_STEP, CELL_TOKENS = 64, 1.2, 4
BINS = 256
ODD_WORDS = 8  # 64-bit words of a set's parity bits
FLUSH = 1 << 20  # signatures held by a task before they are sent
HOT_LOCAL = 64  # a task sends a signature's rows beyond this many one by one, so that they can be dealt out
_SALT = U64(0xA0761D6478BD642F)


def shingles(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside each text, and where each text's begin (one more entry)."""
    w = words(part)
    hashes = range_hashes(part.data, w.start, w.end, LOWER_CODES)
    count = np.diff(w.first)
    grams = windows(hashes, size)
    owner = w.text[:len(grams)]
    whole = w.text[size - 1:] == owner if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    extra = []
    for k in short.tolist():
        own = hashes[w.first[k]:w.first[k + 1]]
        extra.append(windows(own, len(own))[0] ^ U64(len(own)))
    owner = np.concatenate([owner[whole], short])
    grams = np.concatenate([grams[whole], np.array(extra, U64)])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[fresh], grams[fresh]
    return grams, np.searchsorted(owner, np.arange(len(part) + 1))


def _segments(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each segment, modulo 2^64."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[at[1:]] - total[at[:-1]]


def parities(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set ``64 * ODD_WORDS`` bits: whether a cell of tokens has an odd number of them. A token that only one of two sets
    has turns one bit, so the sets differ in at least as many tokens as their bits differ."""
    place = (grams >> U64(8)) % U64(64 * ODD_WORDS)
    word, bit = place >> U64(6), U64(1) << (place & U64(63))
    out = np.empty((len(at) - 1, ODD_WORDS), U64)
    for k in range(ODD_WORDS):
        total = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(np.where(word == U64(k), bit, U64(0)))])
        out[:, k] = total[at[1:]] ^ total[at[:-1]]
    return out


def _plain(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def profiles(rows: DataFrame, size: int) -> DataFrame:
    """Per document set size, set key and bin counts; per task the pieces of the count sketch (doc_id null, piece set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, many = np.zeros(SKETCH, np.int32), [], 0
        names = ["doc_id", "n_shingles", "key", "bins", "odd", "piece", "counts"]
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                grams, at = shingles(part, size)
                held.append((grams >> U64(64 - SKETCH_BITS)).astype(np.int32))
                many += len(grams)
                if many > SKETCH:
                    sketch += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.int32)
                    held, many = [], 0
                n = np.diff(at)
                keys = np.stack([_segments(mix(grams), at), _segments(mix(grams ^ _SALT), at), n.astype(U64)], 1)
                owner = np.repeat(np.arange(len(part)), n)
                bins = np.minimum(np.bincount(owner * BINS + (grams & U64(BINS - 1)).astype(np.int64), minlength=len(part) * BINS), 65535).astype("<u2").reshape(-1, BINS)
                count = len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.first, count), pa.array(n, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array([b.tobytes() if b.max(initial=0) > 255 else b.astype(np.uint8).tobytes() for b in bins], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * ODD_WORDS, parities(grams, at).reshape(-1).view(np.int64)),
                     pa.nulls(count, pa.int32()), pa.nulls(count, pa.binary())], names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.int32)
        step, compress = SKETCH // PIECES, zstandard.ZstdCompressor(level=1).compress
        counts = [compress(sketch[k * step:(k + 1) * step].astype("<i4").tobytes()) for k in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, pa.list_(pa.int64())),
                                          pa.array(range(PIECES), pa.int32()), pa.array(counts, pa.binary())], names)

    return rows.mapInArrow(scan, "doc_id long, n_shingles long, key binary, bins binary, odd array<long>, piece int, counts binary")


def token_classes(profile: DataFrame) -> tuple[bytes, bytes]:
    """Bits of the sketch cells that are frequent and very frequent: counts well above the mean of all cells."""

    mean = (profile.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) / SKETCH
    background = mean + 6 * np.sqrt(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[piece] = total.get(piece, 0) + np.frombuffer(expand(raw), "<i4").astype(np.int64)
        if total:
            bits = [[np.packbits(x > background + least).tobytes() for x in total.values()] for least in (FREQUENT, VERY_FREQUENT)]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array(x, pa.binary()) for x in bits]], ["piece", "frequent", "very"])

    held = profile.filter("piece is not null").select("piece", "counts")
    found = {r["piece"]: r for r in spread(held, "piece").mapInArrow(add, "piece int, frequent binary, very binary").collect()}  # 2 x SKETCH bits
    none = bytes(SKETCH // PIECES // 8)
    return tuple(b"".join(bytes(found[k][name]) if k in found else none for k in range(PIECES)) for name in ("frequent", "very"))


def level_step(spare: int) -> float:
    """Sets that miss at most ``spare`` per cent of each other are then at most one level apart."""
    return max(LEVEL_STEP, 100.8 / (100 - spare))


def level_of(n: int, step: float = LEVEL_STEP) -> int:
    return int(np.floor(np.log(max(n, 1)) / np.log(step) + 1e-9))


def cells_of(level: int, k: int, spare: int) -> int:
    """Cells of class k at a level: about CELL_TOKENS prefix tokens each."""
    misses = level_step(spare) ** level * spare / 100 + 1
    return max(1, int(misses / (CELL_TOKENS - k + 1)))


def frequent_signatures(tokens: np.ndarray, classes: np.ndarray, level: int, misses: int, spare: int) -> list[int]:
    """Signatures of one ordered set at one level."""
    cells = {k: cells_of(level, k, spare) for k in (2, 3)}
    taken: dict[tuple[int, int], list[int]] = {}
    out, broken = [], 0
    for token, k in zip(tokens.tolist(), classes.tolist()):
        if broken > misses:
            break
        if k == 1:
            out.append(token)
            broken += 1
            continue
        cell = taken.setdefault((k, token % cells[k]), [])
        for others in combinations(cell, k - 1):
            out.append(hash((level, k, *others, token)) & 0xFFFFFFFFFFFFFFFF)
        cell.append(token)
        broken += len(cell) >= k
    return out


def signatures(rows: DataFrame, size: int, threshold: int, classes: tuple[bytes, bytes], buckets: int) -> DataFrame:
    """(bucket, ids, sigs): packed signatures by bucket; signatures hot in a task also as single rows (sig, doc_id)."""
    frequent_bits, very_bits = classes
    spare = 100 - threshold
    step = level_step(spare)
    flat_below = level_of(SMALL_SET, step)  # levels at which every token is indexed alone

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, very = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (frequent_bits, very_bits))
        held_sigs: list[np.ndarray] = []
        held_docs: list[np.ndarray] = []
        held = 0
        names = ["bucket", "sigs", "docs", "sig", "doc_id"]

        def flush() -> Iterator[pa.RecordBatch]:
            sigs, docs = np.concatenate(held_sigs), np.concatenate(held_docs)
            order = np.argsort(sigs, kind="stable")
            sigs, docs = sigs[order], docs[order]
            edge = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1], [True]]))
            rank = np.arange(len(sigs)) - np.repeat(edge[:-1], np.diff(edge))
            hot = np.repeat(np.diff(edge) > HOT_LOCAL, np.diff(edge))
            if hot.any():
                many = int(hot.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary()),
                                                  pa.array(sigs[hot].view(np.int64)), pa.array(docs[hot])], names)
                stay = ~hot | (rank < 2)  # two rows of a hot signature tell the bucket that it is shared
                sigs, docs = sigs[stay], docs[stay]
            bucket = (sigs % U64(buckets)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            bucket, sigs, docs = bucket[order], sigs[order], docs[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            for some in np.array_split(full, max(1, len(full) // 64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([sigs[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                     pa.array([docs[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names)

        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            none = np.asarray(batch.column(0).is_null())
            for part in slices(batch.column(1)):
                grams, at = shingles(part, size)
                n = np.diff(at)
                n[none[part.first:part.first + len(part)]] = 0  # no document to link
                owner = np.repeat(np.arange(len(part)), np.diff(at))
                place = (grams >> U64(64 - SKETCH_BITS)).astype(np.int64)
                kind = 1 + frequent[place].astype(np.int8) + very[place]
                order = np.lexsort((grams, kind, owner))
                grams, kind = grams[order], kind[order]
                misses = n * spare // 100
                rare = _segments((kind == 1).astype(U64), at).astype(np.int64)
                simple = (n > 0) & ((rare > misses) | (n < step ** (flat_below - 1) - 1))
                rank = np.arange(len(grams)) - at[:-1][owner]
                pick = simple[owner] & (rank <= misses[owner])
                doc = ids[part.first:part.first + len(part)]
                held_sigs.append(grams[pick])
                held_docs.append(doc[owner[pick]])
                held += int(pick.sum())
                for k in np.flatnonzero((n > 0) & ~simple).tolist():
                    own, own_kind, level = grams[at[k]:at[k + 1]], kind[at[k]:at[k + 1]], level_of(int(n[k]), step)
                    made: set[int] = set()
                    for at_level in (level, level + 1):
                        made.update(frequent_signatures(own, np.ones_like(own_kind) if at_level < flat_below else own_kind, at_level, int(misses[k]), spare))
                    held_sigs.append(np.fromiter(made, U64, len(made)))
                    held_docs.append(np.full(len(made), doc[k]))
                    held += len(made)
                if held >= FLUSH:
                    yield from flush()
                    held_sigs, held_docs, held = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(scan, "bucket int, sigs binary, docs binary, sig long, doc_id long")


def shared_signatures(signed: DataFrame, buckets: int) -> DataFrame:
    """(sig, doc_id) of the signatures of two documents or more."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bucket's rows come one after another
        last, sigs, docs = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            s, d = np.frombuffer(b"".join(sigs), U64), np.frombuffer(b"".join(docs), np.int64)
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d = s[fresh], d[fresh]
            twin = np.zeros(len(s), bool)
            twin[1:] = s[1:] == s[:-1]
            twin[:-1] |= twin[1:]
            yield pa.RecordBatch.from_arrays([pa.array(s[twin].view(np.int64)), pa.array(d[twin])], ["sig", "doc_id"])

        for batch in batches:
            for bucket, s, d in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != last and sigs:
                    yield from done()
                    sigs, docs = [], []
                last = bucket
                sigs.append(s)
                docs.append(d)
        if sigs:
            yield from done()

    packed = signed.filter("bucket is not null").select("bucket", "sigs", "docs").repartition(buckets // 4, "bucket").sortWithinPartitions("bucket")
    hot = signed.filter("sig is not null").select("sig", "doc_id")
    return packed.mapInArrow(match, "sig long, doc_id long").unionByName(hot).distinct()


def _bounded(threshold: int) -> Column:
    """Sizes (n) and parity bits (odd) of ``l`` and ``r`` allow the two sets to be similar; an exact bound, cheap enough for the condition of a join."""
    n, m = F.col("l.n"), F.col("r.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col("l.odd")[k].bitwiseXOR(F.col("r.odd")[k])) for k in range(ODD_WORDS)])
    return (n * 100 >= m * threshold) & (m * 100 >= n * threshold) & (differ * (100 + threshold) <= (n + m) * (100 - threshold))


def _facts(profile: DataFrame) -> DataFrame:
    return profile.filter("doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), "odd").distinct()


def near_centre(starred: DataFrame, profile: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of a centre and a document of its groups that sizes and parity bits allow to be similar."""
    left, right = (_facts(profile).alias(x) for x in "lr")
    pairs = starred.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    return pairs.join(right, F.expr("b = r.doc_id")).join(left, F.expr("a = l.doc_id") & _bounded(threshold)).select("a", "b").distinct()


def pairs_across(open_rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of a signature's documents (sig, doc_id, component, n, odd) in different components that sizes and parity bits
    allow to be similar. The bound stands in the condition of the join, so that other pairs are never rows."""
    left, right = (open_rows.alias(x) for x in "lr")
    other = F.expr("l.sig = r.sig and l.doc_id < r.doc_id and l.component <> r.component")
    return left.join(right, other & _bounded(threshold)).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()


def within_bounds(pairs: DataFrame, profile: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that the sizes and the bin counts allow to be similar. Both bounds are exact: no similar pair is lost."""
    facts = profile.filter("doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), "bins")
    a = facts.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba"))
    b = facts.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb"))
    joined = pairs.join(b, "b").join(a, "a").filter(F.col("na") * 100 >= F.col("nb") * threshold).filter(F.col("nb") * 100 >= F.col("na") * threshold)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x, np.uint8 if len(x) == BINS else "<u2").astype(np.int32)
        for batch in batches:
            ba, bb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            top = np.fromiter((int(np.minimum(read(x), read(y)).sum()) for x, y in zip(ba, bb)), np.int64, len(ba))
            na, nb = (np.asarray(batch.column(k)) for k in (2, 3))
            over = np.fromiter((len(x) > BINS or len(y) > BINS for x, y in zip(ba, bb)), bool, len(ba))  # bins may be cut at 65,535
            good = (100 * top >= threshold * (na + nb - top)) | over & (np.maximum(na, nb) > 65535)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return joined.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(bound, "a long, b long")


def similar(pairs: DataFrame, rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    needed = durable(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = durable(packed_texts(rows, bit_filter(needed)).join(needed, "doc_id", "left_semi"))
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("ta")), "a").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last, last_set = None, None

        def tokens(raw: bytes) -> np.ndarray:
            data = np.frombuffer(expand(raw), np.uint8)
            return shingles(Slice(data, np.zeros(1, np.int64), np.array([len(data)]), 0), size)[0]

        for batch in batches:
            good = []
            for a, ta, tb in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if ta != last:
                    last, last_set = ta, tokens(ta)
                other = tokens(tb)
                both = len(last_set) + len(other) - len(np.union1d(last_set, other))
                good.append(both > 0 and 100 * both >= threshold * (len(last_set) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(compare, "a long, b long")


def link(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)."""
    if not LEAST_THRESHOLD <= threshold <= 100:
        raise ValueError(f"the threshold is a per cent from {LEAST_THRESHOLD} to 100")
    spark = docs.sparkSession
    rows = _plain(docs, ident, text)
    profile = durable(profiles(rows, size))
    buckets = 4 * partitions(spark)
    known = profile.filter("doc_id is not null")
    first = durable(known.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    equal = durable(known.filter("n_shingles > 0").select("doc_id", "key").join(first, "key").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    copies = equal.filter("u <> v").distinct()
    sole = copies.select(F.col("v").alias("doc_id"), F.col("u").alias("rep")).groupBy("doc_id").agg(F.min("rep").alias("rep"))

    shared = shared_signatures(signatures(rows, size, threshold, token_classes(profile), buckets), buckets)
    # one document stands for all with the same set
    postings = durable(shared.join(sole, "doc_id", "left").select("sig", F.coalesce("rep", "doc_id").alias("doc_id")).distinct())
    # the centre of a group is its document with most shared signatures: the one with fewest changes of its own
    weight = durable(postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w")))
    centre = postings.join(weight, "doc_id").groupBy("sig").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("d"))).alias("m"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1").select("sig", (-F.col("m.d")).alias("a"))
    starred = postings.join(centre, "sig")
    stars = durable(within_bounds(durable(near_centre(starred, profile, threshold)), profile, threshold))
    links = durable(similar(stars, rows, size, threshold))
    joined = durable(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    # groups that are not one component yet: pairs across components, other than those just compared
    placed = starred.select("sig", "doc_id", "a").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high and n > 2").select("sig")
    open_rows = durable(placed.join(mixed, "sig", "left_semi").filter("doc_id <> a").select("sig", "doc_id", "component").join(_facts(profile), "doc_id"))
    across = durable(pairs_across(open_rows, threshold))
    more = similar(durable(within_bounds(across, profile, threshold)), rows, size, threshold)
    edges = durable(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies))
    final = components(edges).withColumnRenamed("node", "doc_id")
    sizes = known.select("doc_id", "n_shingles")
    nameless = rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return sizes.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(nameless)


SQL = f"""WITH RECURSIVE listed AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM listed),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= {THRESHOLD} * (x.n + y.n - met.n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = seen)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
    FROM listed LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS low FROM reach GROUP BY 1) USING (doc_id)"""


@query("op3_jaccard_join", SQL)
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return link(documents(spark, folder))
