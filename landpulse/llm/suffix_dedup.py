"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Positions are
put into buckets by their first q bytes; a bucket is refined by the bucket identifiers found at later offsets, and the
identifiers so made are used again for the next length: 1, 2, 4, 8, 16, then 20 and 32, then 50 bytes. Identifiers are
64-bit and depend on the bytes alone, so equal strings get equal ones in every task without a global sort, and only
positions that can matter need to meet:

1. *Initial buckets.* Of the q-grams inside a string, the one of least identifier stands for it, so all copies of the
   string meet in one bucket. Neighbouring strings mostly share it: a run of string starts with one bucket is one row.
2. *Refinement by runs.* Rows of a bucket are sorted on the identifiers at the first and the last start of the run
   (which fix all its bytes). Where a smaller document has the same run, all its strings go. Where a bucket holds one
   document only, nothing can be shared. What is left, one row per distinct run, is refined further.
3. *Refinement by strings.* The starts of those runs are sorted on the identifier of the whole string, and all but the
   least document's go.

Each task first settles what it can among its own rows (only the least document of equal runs or strings is sent), so a
string that is in a third of all documents costs a row per task; a q-gram with very many different runs in one task
skips step 2 for them and goes straight to step 3; one flagged row of it makes its bucket leave the rows of all other tasks
open too. Rows travel packed by bucket, some bytes each, and are sorted in shares of about ``SHARE`` rows. Texts travel
compressed, and only those that a fixed-size bit filter cannot rule out; it never rules out a wrong one.

A doc_id stands for one text; repeated rows are returned repeatedly. Null ids neither remove nor lose bytes. Null, empty and shorter texts
lose nothing. A very long text is one row's work. Other columns are not read. Nothing is gathered on the driver but the
bit filter (``FILTER_BITS``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.tables import documents, partitions, query
from landpulse.llm.textbytes import BYTE_CODES, U64, Slice, mix, slices
from landpulse.session import durable

LENGTH, GRAM = 50, 20
FLUSH = 500_000  # rows that a task holds before it sends them
SHARE = 200_000  # rows of a bucket, about, that are sorted at once
SLICE = 1 << 18  # bytes hashed at once: their arrays stay in the cache
HOT_GRAM = 256  # different runs of one q-gram among them
PACKED_DOCUMENTS = 1 << 22  # documents of a bucket whose numbers fit beside a place into 63 bits
FILTER_BITS = 1 << 23
REMOVED, OPEN = 0, 1
SKIPPED = 1  # state of a sent run whose q-gram skips step 2
_NEAR, _FAR = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)

PACKED = "kind int, bucket int, body binary, meta binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
Batches = Iterator[pa.RecordBatch]


def refine(ids: np.ndarray, later: int) -> np.ndarray:
    """Identifiers of longer strings from those at each position and at a later offset."""
    with np.errstate(over="ignore"):
        x = ids[:len(ids) - later] * _NEAR + ids[later:] * _FAR
        return x ^ (x >> U64(29))


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the q-gram and of the whole string at every position where they fit."""
    if len(data) < LENGTH:
        return np.zeros(0, U64), np.zeros(0, U64)
    ids, size = BYTE_CODES[data], 1
    while size < 16:
        ids = refine(ids, size)
        size *= 2
    return mix(refine(ids, GRAM - 16)), mix(refine(refine(ids, 16), LENGTH - 32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def runs(part: Slice) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one bucket: bucket, identifier of the run, text, first start in the text, further starts."""
    grams, whole = identifiers(part.data)
    width = LENGTH - GRAM + 1
    count = np.maximum(part.ends - part.starts - LENGTH + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(0, U64), none, none, none
    least = sliding_least(grams, width)
    text = np.repeat(np.arange(len(part)), count)
    inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = part.starts[text] + inner
    bucket = least[at]
    fresh = np.ones(total, bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, total))
    if (size > LENGTH).any():  # the run's first and last string must cover it
        pieces = -(-size // LENGTH)
        begin = np.repeat(begin, pieces) + LENGTH * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(begin, total))
    last = begin + size - 1
    with np.errstate(over="ignore"):
        run = mix(whole[at[begin]] * _NEAR + whole[at[last]] * _FAR + size.astype(U64))
    return bucket[begin], run, text[begin], inner[begin], size - 1


# Rows travel as columns of bytes: identifiers raw, (document, start, further starts, kind) compressed.

def pack_places(doc: np.ndarray, start: np.ndarray, more: np.ndarray, kind: np.ndarray, compress) -> bytes:
    step = np.diff(doc, prepend=np.int64(0))
    return compress(np.int64(len(doc)).tobytes() + step.astype("<i8").tobytes() + start.astype("<u4").tobytes() + more.astype(np.uint8).tobytes() + kind.astype(np.uint8).tobytes())


def unpack_places(raw: bytes, expand) -> tuple[np.ndarray, ...]:
    raw = expand(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8
    out = []
    for kind, size in (("<i8", 8), ("<u4", 4), (np.uint8, 1), (np.uint8, 1)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return np.cumsum(out[0]), *out[1:]


def _bytes_of(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


class Sender:
    """Makes the packed rows of a task."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.compress = buckets, zstandard.ZstdCompressor(level=1).compress
        self.kept, self.count = [], 0

    def batch(self, kind: int, bucket: np.ndarray, bodies: list[tuple[np.ndarray, int]], doc, start, more, state) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        bucket, doc, start, more, state = (x[order] for x in (bucket, doc, start, more, state))
        bodies = [(x[order], width) for x, width in bodies]
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        for some in np.array_split(full, max(1, len(full) // 64)):
            part = [slice(cut[b], cut[b + 1]) for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([b"".join(_bytes_of(x[p], width) for x, width in bodies) for p in part], pa.binary()),
                 pa.array([pack_places(doc[p], start[p], more[p], state[p], self.compress) for p in part], pa.binary())], ["kind", "bucket", "body", "meta"])

    def later(self, doc, start, more, state, least: int | None = None) -> Iterator[pa.RecordBatch]:
        """Answers gathered over several buckets and sent together, so that a task makes few rows."""
        self.kept.append((doc, start, more, state))
        self.count += len(doc)
        if self.count >= (FLUSH if least is None else least):
            yield from self.answers(*(np.concatenate(x) for x in zip(*self.kept)))
            self.kept, self.count = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        yield from self.later(none, none, none, none, 0)

    def answers(self, doc, start, more, state) -> Iterator[pa.RecordBatch]:
        """What is known about places, by bucket of the document."""
        if len(doc):
            yield from self.batch(1, (mix(doc.view(U64)) % U64(self.buckets)).astype(np.int64), [], doc, start, more, state)


def least_per_group(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value among the rows with its key."""
    if not len(keys):
        return values
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], first), np.diff(np.append(first, len(keys))))
    return out


def send_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 1: packed runs by bucket (kind 0), and what each task already knows (kind 1)."""

    def scan(batches: Batches) -> Batches:
        sender, held, size = Sender(buckets), [], 0

        def flush() -> Batches:
            gram, run, doc, start, more = (np.concatenate(x) for x in zip(*held))
            held.clear()
            gone = doc > least_per_group(run, doc)
            yield from sender.answers(doc[gone], start[gone], more[gone], np.full(int(gone.sum()), REMOVED))
            gram, run, doc, start, more = (x[~gone] for x in (gram, run, doc, start, more))
            order = np.argsort(gram)
            ranked = gram[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(gram) else np.zeros(0, np.int64)
            skip, flag = np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
            for a, n in zip(first.tolist(), np.diff(np.append(first, len(gram))).tolist()) if len(gram) and np.diff(np.append(first, len(gram))).max() > HOT_GRAM else ():
                if n > HOT_GRAM:
                    own = order[a:a + n]
                    if len(np.unique(run[own])) > HOT_GRAM:  # copies of a run in one document count once
                        skip[own[1:]] = True
                        flag[own[0]] = SKIPPED
            yield from sender.answers(doc[skip], start[skip], more[skip], np.full(int(skip.sum()), OPEN))
            send = ~skip
            bucket = ((gram[send] >> U64(40)) % U64(buckets)).astype(np.int64)
            yield from sender.batch(0, bucket, [(gram[send], 4), (run[send], 6)], doc[send], start[send], more[send], flag[send])

        for batch in batches:
            ids, none = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
            for part in slices(batch.column(1), SLICE):
                gram, run, text, start, more = runs(part)
                stay = ~none[part.first + text]
                held.append((gram[stay], run[stay], ids[part.first + text[stay]], start[stay].astype(np.uint32), more[stay].astype(np.uint8)))
                size += int(stay.sum())
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return rows.mapInArrow(scan, PACKED)


def _buckets_of(batches: Batches) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Rows of each bucket, which come one after another: (bucket, bodies, metas)."""
    last, bodies, metas = None, [], []
    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != last and metas:
                yield last, bodies, metas
                bodies, metas = [], []
            last = bucket
            bodies.append(batch.column(1)[k].as_py())
            metas.append(batch.column(2)[k].as_py())
    if metas:
        yield last, bodies, metas


def _joined(packed: list[bytes], unpack) -> tuple[np.ndarray, ...]:
    """Columns of all packed rows, one after another; ``packed`` is emptied on the way, so that no row is held twice."""
    packed.reverse()
    parts = []
    while packed:
        parts.append(unpack(packed.pop()))
    out = []
    for k in range(len(parts[0])):
        out.append(np.concatenate([p[k] for p in parts]))
        parts = [(*p[:k], None, *p[k + 1:]) for p in parts]
    return tuple(out)


def _places(metas: list[bytes], expand) -> tuple[np.ndarray, ...]:
    return _joined(metas, lambda m: unpack_places(m, expand))


def shares(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers of a bucket in shares of about ``most`` rows; rows of one key stay together."""
    number = min(-(-len(key) // most), 255)
    if number <= 1:
        yield np.arange(len(key))
        return
    share = (mix(mix(key.astype(U64))) % U64(number)).astype(np.uint8)
    order = np.argsort(share, kind="stable").astype(np.uint32)
    cut = np.cumsum(np.bincount(share, minlength=number))
    del share
    for a, b in zip(np.append(0, cut[:-1]).tolist(), cut.tolist()):
        if b > a:
            yield order[a:b]


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select("bucket", "body", "meta").repartition(max(1, buckets // 2), "bucket").sortWithinPartitions("bucket")


def settle_runs(sent: DataFrame, buckets: int) -> DataFrame:
    """Step 2: places that go, and places that stay open, by bucket of the document."""

    def settle(gram: np.ndarray, run: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """REMOVED, OPEN or -1 for each row."""
        key = (gram << U64(32)) | (run >> U64(16))  # its order is that of (gram, run) but for the run's last bits
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        rest = run[order]
        if (np.minimum.reduceat(rest, first) != np.maximum.reduceat(rest, first)).any():
            order = np.lexsort((run, gram))
        gram, run, owner = gram[order], run[order], owner[order]
        by_gram = np.append(True, gram[1:] != gram[:-1])
        by_run = by_gram | np.append(True, run[1:] != run[:-1])
        group, first = np.cumsum(by_gram) - 1, np.flatnonzero(by_gram)
        several = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))[group]
        shared = (np.add.reduceat(by_run.astype(np.int64), first) > 1)[group]
        skipped = (np.maximum.reduceat(flag[order], first) == SKIPPED)[group]  # some of its rows are not here
        gone = owner > np.minimum.reduceat(owner, np.flatnonzero(by_run))[np.cumsum(by_run) - 1]
        state = np.full(len(owner), -1)
        state[order] = np.where(gone, REMOVED, np.where(several & shared | skipped, OPEN, -1))
        return state

    def keys(body: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(body) // 10
        return np.frombuffer(body, "<u4", n), _from_bytes(body[4 * n:], 6)

    def match(batches: Batches) -> Batches:
        sender, expand = Sender(buckets), zstandard.ZstdDecompressor().decompress
        for _, bodies, metas in _buckets_of(batches):
            gram, run = _joined(bodies, keys)
            doc, start, more, flag = _places(metas, expand)
            for own in shares(gram, SHARE):
                state = settle(gram[own].astype(U64), run[own], doc[own], flag[own])
                own, state = own[state >= 0], state[state >= 0]
                yield from sender.later(doc[own], start[own], more[own], state.astype(np.uint8))
            del gram, run, doc, start, more, flag
        yield from sender.rest()

    settled = _dealt(sent.filter("kind = 0"), buckets).mapInArrow(match, PACKED)
    return settled.unionByName(sent.filter("kind = 1")).select("bucket", "body", "meta")


def places_by_document(answers: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, gone, open): removed ranges as (start, end) pairs, merged, and open starts as (first, last) pairs; 32-bit."""

    def ranges_of(doc: np.ndarray, start: np.ndarray, more: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
        start, more, state = start.astype(np.int64), more.astype(np.int64), state.astype(np.int64)
        ids, number = np.unique(doc, return_inverse=True)
        number = number.astype(np.int64)
        if len(ids) <= PACKED_DOCUMENTS:
            place = np.sort((number << 41) | (state << 40) | (start << 8) | more)  # one number per row
            number, state, start, more = place >> 41, (place >> 40) & 1, (place >> 8) & 0xFFFFFFFF, place & 0xFF
        else:
            order = np.lexsort((more, start, state, number))
            number, state, start, more = number[order], state[order], start[order], more[order]
        gone = state == REMOVED
        at = (number[gone] << 33) + start[gone]
        ranges = merged(at, at + more[gone] + LENGTH)
        cut = np.searchsorted(ranges[:, 0], np.arange(len(ids) + 1) << 33)
        ranges = (ranges & 0x1FFFFFFFF).astype("<u4")
        still, still_cut = np.column_stack([start[~gone], start[~gone] + more[~gone]]).astype("<u4"), np.searchsorted(number[~gone], np.arange(len(ids) + 1))
        pieces = lambda x, c: [x[a:b].tobytes() if b > a else None for a, b in zip(c[:-1].tolist(), c[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pieces(ranges, cut), pa.binary()), pa.array(pieces(still, still_cut), pa.binary())], ["doc_id", "gone", "open"])

    def gather(batches: Batches) -> Batches:
        expand = zstandard.ZstdDecompressor().decompress
        for _, _, metas in _buckets_of(batches):
            places = _places(metas, expand)
            for own in shares(places[0].view(U64), SHARE):
                yield ranges_of(*(x[own] for x in places))
            del places

    return _dealt(answers, buckets).mapInArrow(gather, "doc_id long, gone binary, open binary")


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint ranges, as rows (start, end), that cover the same places; ``start`` ascends."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return np.column_stack([start[first], reach[np.append(first[1:], len(start)) - 1]])


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A bit per hash value of the given doc_ids: FILTER_BITS bits whatever their number."""

    def words_of(batches: Batches) -> Batches:
        for batch in batches:
            bits = np.unique(mix(np.asarray(batch.column(0)).view(U64)) % U64(FILTER_BITS)).astype(np.int64)
            word, first = np.unique(bits >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (bits & 63).astype(U64), first) if len(bits) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, U64)
    for row in ids.select("doc_id").mapInArrow(words_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # FILTER_BITS bits
        out[row["word"]] = np.int64(row["bits"]).view(U64)
    return out


def _maybe(filter_: np.ndarray, ids: pa.Array) -> np.ndarray:
    bits = mix(np.asarray(ids.fill_null(0)).view(U64)) % U64(FILTER_BITS)
    hit = (filter_[(bits >> U64(6)).astype(np.int64)] >> (bits & U64(63))) & U64(1)
    return (hit == 1) & ~np.asarray(ids.is_null())


def packed_texts(rows: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(doc_id, packed) of the texts that the filter lets through."""

    def shrink(batches: Batches) -> Batches:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            some = batch.filter(pa.array(_maybe(filter_, batch.column(0))))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([compress((t or "").encode()) for t in some.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])

    return rows.mapInArrow(shrink, "doc_id long, packed binary")


def send_strings(rows: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """Step 3, first half: the open starts by identifier of their whole string."""
    still = places.filter("open is not null").select("doc_id", "open")
    joined = packed_texts(rows, bit_filter(still)).join(still, "doc_id").select("doc_id", "packed", "open")

    def scan(batches: Batches) -> Batches:
        sender, expand = Sender(buckets), zstandard.ZstdDecompressor().decompress
        held, size = [], 0

        def flush() -> Batches:
            string, doc, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            gone = doc > least_per_group(string, doc)
            zero = lambda n: np.zeros(n, np.int64)
            yield from sender.answers(doc[gone], start[gone], zero(int(gone.sum())), zero(int(gone.sum())))
            string, doc, start = string[~gone], doc[~gone], start[~gone]
            bucket = ((string >> U64(56)) | ((string & U64(0xFFFF)) << U64(8))) % U64(buckets)
            yield from sender.batch(0, bucket.astype(np.int64), [(string, 7)], doc, start, zero(len(doc)), zero(len(doc)))

        def take(some: list[tuple[int, bytes, bytes]]) -> int:
            """Open starts of some documents, their texts hashed together."""
            length = np.array([len(t) for _, t, _ in some])
            _, whole = identifiers(np.frombuffer(b"".join(t for _, t, _ in some), np.uint8))
            base = np.cumsum(length) - length
            pairs = np.frombuffer(b"".join(r for _, _, r in some), "<u4").astype(np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(some)), [len(r) // 8 for _, _, r in some])
            number = pairs[:, 1] - pairs[:, 0] + 1
            at = np.repeat(base[owner] + pairs[:, 0] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
            at = np.unique(at)
            owner = np.searchsorted(base, at, "right") - 1
            held.append((whole[at], np.array([i for i, _, _ in some])[owner], at - base[owner]))
            return len(at)

        some, load = [], 0
        for batch in batches:
            for ident, packed, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                some.append((ident, expand(packed), raw))
                load += len(some[-1][1])
                if load >= SLICE:
                    size += take(some)
                    some, load = [], 0
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if some:
            size += take(some)
        if size:
            yield from flush()

    return joined.mapInArrow(scan, PACKED)


def settle_strings(sent: DataFrame, buckets: int) -> DataFrame:
    def match(batches: Batches) -> Batches:
        sender, expand = Sender(buckets), zstandard.ZstdDecompressor().decompress
        for _, bodies, metas in _buckets_of(batches):
            string, = _joined(bodies, lambda body: (_from_bytes(body, 7),))
            doc, start, more, state = _places(metas, expand)
            for own in shares(string, SHARE):
                gone = own[doc[own] > least_per_group(string[own], doc[own])]
                yield from sender.later(doc[gone], start[gone], more[gone], state[gone])
            del string, doc, start, more, state
        yield from sender.rest()

    return _dealt(sent.filter("kind = 0"), buckets).mapInArrow(match, PACKED).unionByName(sent.filter("kind = 1")).select("bucket", "body", "meta")


def _result(ids, texts: list[bytes], ranges: list[np.ndarray | None]) -> pa.RecordBatch:
    out = []
    for text, cut in zip(texts, ranges):
        if cut is None:
            out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            continue
        kept, at = hashlib.sha256(), 0
        for a, b in cut.tolist():
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        out.append((len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), kept.hexdigest()))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                                      ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, gone) of the documents that lose bytes; ``gone``: 32-bit (start, end) pairs, merged."""
    buckets = 2 * partitions(rows.sparkSession)
    answers = durable(settle_runs(send_runs(rows, buckets), buckets))
    strings = settle_strings(send_strings(rows, places_by_document(answers, buckets), buckets), buckets)
    return places_by_document(answers.unionByName(strings), buckets).filter("gone is not null").select("doc_id", "gone")


def plain(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = plain(docs, ident, text)
    gone = durable(removed_ranges(rows))
    filter_ = bit_filter(gone)

    def whole(batches: Batches) -> Batches:
        for batch in batches:
            some = batch.filter(pa.array(~_maybe(filter_, batch.column(0))))
            texts = [(t or "").encode() for t in some.column(1).to_pylist()]
            yield _result(some.column(0), texts, [None] * len(texts))

    def cut(batches: Batches) -> Batches:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield _result(batch.column(0), [expand(p) for p in batch.column(1).to_pylist()],
                          [None if g is None else np.frombuffer(g, "<u4").astype(np.int64).reshape(-1, 2) for g in batch.column(2).to_pylist()])

    touched = packed_texts(rows, filter_).join(gone, "doc_id", "left").select("doc_id", "packed", "gone")
    return rows.mapInArrow(whole, RESULT).unionByName(touched.mapInArrow(cut, RESULT))


SQL = f"""WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    starts AS (SELECT doc_id, h, n, unnest(range(n - {LENGTH} + 1)) AS i FROM bytes WHERE n >= {LENGTH}),
    strings AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, {2 * LENGTH})) AS s FROM starts),
    least AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY 1),
    hits AS (SELECT doc_id, i FROM strings JOIN least USING (s) WHERE low < doc_id),
    fresh AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS f FROM hits),
    grouped AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM fresh),
    spans AS (SELECT doc_id, g, min(i) AS a, max(i) + {LENGTH} AS b FROM grouped GROUP BY 1, 2),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
    kept AS (SELECT x.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
        string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS k FROM gaps x JOIN bytes USING (doc_id) GROUP BY 1)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
    FROM bytes LEFT JOIN kept USING (doc_id)"""


@query("op4_suffix_dedup", SQL)
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(documents(spark, folder))
