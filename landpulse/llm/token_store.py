"""Token store: every document's ids as a frame of its own, compressed with one dictionary that all frames share.

A store is a folder of two Parquet tables.

* ``dictionary``: one row (sha256, content). The zstandard dictionary is trained on serialized id arrays.
* ``shards``: rows of about ``SHARD_BYTES``: the frames of neighbouring documents one after another (``payload``), an
  index with one entry per document (``doc_ids``, ``offsets``, ``sizes``, ``counts``), the dictionary's hash, and where
  the shard stands: ``part`` (range of doc_id), ``shard`` in it, ``part_start`` (ids of the part before it).

Short documents are read alone: their entry gives the bytes of one frame (``read_documents``). Documents stand in
ascending doc_id order (null first), rows with the same id by text; the range partitioning is done on the texts, before
the ids are made, so they are made once. Null and empty texts are stored as the end id alone. Repeated rows are stored
repeatedly. Other columns are not read. A long document makes a long shard of its own.

The dictionary is fitted on a bounded sample, the ``SAMPLE_DOCUMENTS`` documents of least id hash; it changes the size of
the files, never what they hold. On the driver there is one dictionary of at most ``DICTIONARY_BYTES``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landpulse.llm.tables import documents, query
from landpulse.llm.textbytes import slices
from landpulse.llm.tokens import VOCABULARY, worker_tokenizer
from landpulse.session import scratch_folder

END_ID = 2
SAMPLE_DOCUMENTS = 1000
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 1 << 20
LEVEL = 1
ID_TYPE = np.dtype("<u2")  # ids of this vocabulary are below 65,536

SHARDS = ("part int, shard int, part_start long, dictionary string, doc_ids array<long>, offsets array<long>, sizes array<long>, "
          "counts array<long>, payload binary")


def token_arrays(texts: pa.Array, end_id: int, vocabulary: str) -> Iterator[np.ndarray]:
    """The ids of each text and the end id, in row order."""
    tokenizer = worker_tokenizer(vocabulary)
    for part in slices(texts):
        ids, counts = tokenizer.encode(part)
        stops = np.cumsum(counts)
        for a, b in zip((stops - counts).tolist(), stops.tolist()):
            yield np.append(ids[a:b], np.uint32(end_id))


def _plain(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def train_dictionary(docs: DataFrame, end_id: int = END_ID, vocabulary: str = VOCABULARY, ident: str = "doc_id", text: str = "text",
                     sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> bytes:
    """A shared dictionary from the serialized ids of the documents of least id hash; empty if these are too few to train on."""
    rows = _plain(docs, ident, text)
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [x.astype(ID_TYPE).tobytes() for x in token_arrays(batch.column(1), end_id, vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        frames = [x for batch in batches for x in batch.column(0).to_pylist()]
        try:
            trained = zstandard.train_dictionary(size, frames).as_bytes()
        except zstandard.ZstdError:
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], ["content"])

    # at most ``sample`` ids and texts
    frames = rows.join(F.broadcast(chosen), "id", "left_semi").select("id", "text").mapInArrow(serialize, "ids binary").limit(sample)
    found = frames.coalesce(1).mapInArrow(train, "content binary").collect()  # one row, none for a table without partitions
    return bytes(found[0]["content"]) if found else b""


def write_store(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str = VOCABULARY, ident: str = "doc_id", text: str = "text") -> None:
    """Write all documents in ascending id order to the store ``path``."""
    spark = docs.sparkSession
    content = train_dictionary(docs, end_id, vocabulary, ident, text)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content))], "sha256 string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int | None, bytes, int]] = []

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(f) for _, f, _ in held], np.int64)
            lists = [[i for i, _, _ in held], (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), [n for _, _, n in held]]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([digest]),
                 *[pa.array([x], pa.list_(pa.int64())) for x in lists], pa.array([b"".join(f for _, f, _ in held)], pa.binary())],
                ["part", "shard", "part_start", "dictionary", "doc_ids", "offsets", "sizes", "counts", "payload"])

        for batch in batches:
            for ident_, ids in zip(batch.column(0).to_pylist(), token_arrays(batch.column(1), end_id, vocabulary)):
                if ids.max() > np.iinfo(ID_TYPE).max:
                    raise ValueError(f"id {ids.max()} of vocabulary {vocabulary} does not fit into {ID_TYPE.itemsize} bytes")
                frame = compressor.compress(ids.astype(ID_TYPE).tobytes())
                held.append((ident_, frame, len(ids)))
                size += len(frame)
                if size >= SHARD_BYTES:
                    yield shard()
                    start, number, size = start + sum(n for _, _, n in held), number + 1, 0
                    held = []
        if held:
            yield shard()

    ordered = _plain(docs, ident, text).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(pack, SHARDS).write.parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    return row["sha256"], content


def _decoder(digest: str, content: bytes):
    import zstandard

    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None).decompress

    def decode(frame: bytes, stated: str) -> np.ndarray:
        if stated != digest:
            raise ValueError("a frame names another dictionary")
        return np.frombuffer(decompress(frame), ID_TYPE).astype("<u4")

    return decode


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a store: (doc_id, start, n_tokens, ids_crc32, ids as little-endian 32-bit bytes)."""
    digest, content = _dictionary(spark, path)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sums = shards.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _decoder(digest, content)
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["offset"] + row["part_start"]
                for i, at, size in zip(row["doc_ids"], row["offsets"], row["sizes"]):
                    ids = read(row["payload"][at:at + size], row["dictionary"])
                    raw = ids.tobytes()
                    out.append((i, start, len(ids), zlib.crc32(raw), raw))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = shards.join(F.broadcast(offsets), "part")  # one row per range of doc_id, as many as write tasks
    return placed.select("dictionary", "part_start", "offset", "doc_ids", "offsets", "sizes", "payload").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """The ids of a few documents, decoded from their own frames only: (doc_id, ids)."""
    digest, content = _dictionary(spark, path)
    entry = F.explode(F.arrays_zip("doc_ids", "offsets", "sizes")).alias("e")
    frames = spark.read.schema(SHARDS).parquet(f"{path}/shards").filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted]))).select(
        "dictionary", "payload", entry).filter(F.col("e.doc_ids").isin(wanted)).select(
        F.col("e.doc_ids").alias("doc_id"), "dictionary", F.substring("payload", F.col("e.offsets").cast("int") + 1, F.col("e.sizes").cast("int")).alias("frame"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _decoder(digest, content)
        for batch in batches:
            ids = [read(f, d).tolist() for d, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return frames.mapInArrow(decode, "doc_id long, ids array<long>")


@query("op9_token_store")
def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/store"
    write_store(documents(spark, folder), path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
