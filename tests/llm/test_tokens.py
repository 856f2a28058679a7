"""Token store and packing against the plain tokenizer."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from landpulse.llm import packing, token_store
from landpulse.llm.tokens import vocabulary_path

TEXTS = [None, "", " \n ", "Hello, World! it's 2024", "hello world éİΣ", "<|endoftext|> x<|startoftext|>y", "a" * 700, "the of and " * 9000, "\x1c\x85 odd", "Hello, World! it's 2024"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(2 * k, t, "x", 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows[::-1], "doc_id long, text string, ids string, part int").repartition(3)


def test_store_round_trip(spark, docs, plain, tmp_path):
    token_store.write_store(docs, str(tmp_path / "s"))
    rows = token_store.read_store(spark, str(tmp_path / "s")).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(rows, plain, strict=True):
        expected = np.array([*ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(expected), zlib.crc32(expected.tobytes()))
        assert bytes(r["ids"]) == expected.tobytes()
        start += len(expected)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, str(tmp_path / "s"), [6, 10]).collect()}
    assert got == {6: [*plain[3], 2], 10: [*plain[5], 2]}


def test_store_of_nothing_and_null_ids(spark, docs, tmp_path):
    token_store.write_store(docs.limit(0), str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0
    odd = spark.createDataFrame([(None, "b"), (1, "c"), (1, "c"), (1, "a"), (-5, None)], "doc_id long, text string")
    token_store.write_store(odd, str(tmp_path / "o"))
    rows = token_store.read_store(spark, str(tmp_path / "o")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, -5, 1, 1, 1] and rows[3]["ids"] == rows[4]["ids"] != rows[2]["ids"]


def check_packing(rows, lengths, window):
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(seen) == list(range(len(seen)))
    assert sum(r["length"] for r in rows) == sum(lengths)
    return len(seen) * window - sum(lengths)


def test_packing(spark, docs, plain):
    rows = packing.pack(docs, window=64).collect()
    check_packing(rows, [len(x) + 1 for x in plain], 64)
    for k, ids in enumerate(plain):
        own, at, expected = sorted((r for r in rows if r["doc_id"] == 2 * k), key=lambda r: r["start"]), 0, np.array([*ids, 1], "<u4")
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(expected) and r["ids_crc32"] == zlib.crc32(expected[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(expected)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_each_tail_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(256, np.int64)
    counts[1:] = r.integers(0, 40, 255) if seed < 2 else 0
    if seed >= 2:
        counts[[3, 100, 200]] = [5, 1000, 7]
    used = np.zeros(256, np.int64)
    for lengths, times in packing.plan_windows(counts, 256):
        assert sum(lengths) <= 256
        for x in lengths:
            used[x] += times
    assert (used == counts).all()


def test_least_squares_fills_most(spark):
    counts = np.zeros(2048, np.int64)
    r = np.random.default_rng(0)
    np.add.at(counts, np.minimum(r.gamma(2, 300, 20000).astype(int) + 1, 2047), 1)
    plan = packing.plan_windows(counts, 2048)
    padded = sum(times * (2048 - sum(lengths)) for lengths, times in plan)
    assert padded < 0.005 * (counts * np.arange(2048)).sum()


def test_ids_beyond_the_stored_width_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_store.write_store(docs, str(tmp_path / "store"), end_id=70_000)
