"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: one value per word bucket (dampened counts, unit length), standardised statistics of its
bytes, words and repeated windows, and its stated number of characters. All pairs of features interact through vectors
of ``RANK`` numbers; the sum over pairs is half of the squared sum less the sum of squares, so scoring is linear in the
features that occur. Training is done in numpy on a bounded sample (``SAMPLE`` texts per class of at most ``LONGEST``
code points, see ``labels.training_sample``); scoring reads every text whole, in parallel, without a shuffle.

Labels, language, source and id are never features. A null or empty text has statistics of zero and is scored like any
other; a null ``n_chars`` sets a feature of its own. Repeated rows get equal scores. With only one class to learn from,
or none, every score is the share of that class (0.5 without rows). Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.labels import SCORED, Batches, scores_batch, training_sample, word_codes
from landpulse.llm.tables import documents, query, table
from landpulse.llm.textbytes import Slice, mix, slices, windows, words

THRESHOLD = 0.3
BUCKETS, RANK = 1 << 13, 6
SAMPLE, LONGEST = 1500, 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-5
CLIP = 4.0

# Byte classes whose shares are features; the last class is everything else.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!", ".,;:?", "()[]{}\"'", "-_/\\=+~^@", " \t", "\n"]
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    CLASS_OF[[ord(x) for x in _c]] = _k
KINDS = len(CLASSES) + 1
STATISTICS = KINDS + 9


@dataclass
class Sparse:
    owner: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _per_text(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return counts / np.maximum(n, 1)


def features(part: Slice, stated: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """Word features and raw statistics of each text; ``stated`` is n_chars, NaN where missing."""
    w, docs = words(part), len(part)
    n_words, n_bytes = np.diff(w.first), part.ends - part.starts
    codes = word_codes(part, w, BUCKETS)
    pair, times = np.unique(w.text * BUCKETS + codes, return_counts=True)
    owner, value = pair // BUCKETS, np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value * value, docs))
    sparse = Sparse(owner, pair % BUCKETS, value / np.maximum(norm, 1e-9)[owner])
    text_of_byte = np.repeat(np.arange(docs), n_bytes)
    shares = np.bincount(text_of_byte * KINDS + CLASS_OF[part.data], minlength=docs * KINDS).reshape(docs, KINDS) / np.maximum(n_bytes, 1)[:, None]
    again = np.zeros(len(w), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (w.text[1:] == w.text[:-1])
    grams = windows(codes.astype(np.uint64), 3)
    inside = w.text[2:] == w.text[:-2] if len(grams) else np.zeros(0, bool)
    of = w.text[:len(grams)][inside]
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(grams[inside] + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = of[first]  # the text of each distinct window of a text
    total = np.bincount(of, minlength=docs)
    size = np.where(np.isnan(stated), 0, stated)
    return sparse, np.column_stack([
        shares, np.log1p(n_words), np.log1p(n_bytes), _per_text(np.bincount(w.text, w.end - w.start, docs), n_words),
        _per_text(np.bincount(owner, minlength=docs), n_words), _per_text(np.bincount(w.text, again, docs), n_words),
        1 - _per_text(np.bincount(distinct, minlength=docs), total), _per_text(shares[:, CLASSES.index("\n")] * n_bytes, n_words),
        np.log1p(np.maximum(size, 0)), np.isnan(stated)])


@dataclass
class Machine:
    """bias + linear part + pairwise part; ``mean`` and ``scale`` standardise the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def vector(self, part: Slice, stated: np.ndarray) -> Sparse:
        sparse, raw = features(part, stated)
        dense = np.clip((raw - self.mean) / self.scale, -CLIP, CLIP) / np.sqrt(STATISTICS)
        docs = len(part)
        owner = np.concatenate([sparse.owner, np.repeat(np.arange(docs), STATISTICS)])
        index = np.concatenate([sparse.index, np.tile(np.arange(STATISTICS) + BUCKETS, docs)])
        value = np.concatenate([sparse.value, dense.ravel()])
        order = np.argsort(owner, kind="stable")
        return Sparse(owner[order], index[order], value[order].astype(np.float32))

    def margin(self, x: Sparse, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the factor sums of each text."""
        weighted = self.factors[x.index] * x.value[:, None]
        at = np.searchsorted(x.owner, np.arange(docs))  # every text has its statistics, so no segment is empty
        sums = np.add.reduceat(weighted, at, axis=0)
        squares = np.add.reduceat((weighted * weighted).sum(1), at)
        return self.bias + np.bincount(x.owner, self.linear[x.index] * x.value, docs) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, part: Slice, stated: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.vector(part, stated), len(part))[0], -30, 30)))


def fit(rows: list[tuple], seed: int = 7) -> Machine:
    """Adam on the logistic loss, classes weighted alike; rows are (text, label), or (text, label, stated number of characters or None).

    Statistics that are the same in all rows, such as a missing number of characters that never occurs, get no weight.
    """
    random = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    machine = Machine(0.0, np.zeros(size, np.float32), (random.normal(0, 0.05, (size, RANK))).astype(np.float32), np.zeros(STATISTICS), np.ones(STATISTICS))
    target = np.array([row[1] for row in rows], float)
    if len(set(target)) < 2:
        share = float(target.mean()) if len(target) else 0.5
        machine.factors[:] = 0
        machine.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return machine
    parts = list(slices(pa.array([row[0] for row in rows])))
    stated = np.array([len(row[0]) if len(row) < 3 else np.nan if row[2] is None else row[2] for row in rows], float)
    raw = np.concatenate([features(p, stated[p.first:p.first + len(p)])[1] for p in parts])
    machine.mean, machine.scale = raw.mean(0), np.maximum(raw.std(0), 1e-3)
    texts = []
    for p in parts:
        x = machine.vector(p, stated[p.first:p.first + len(p)])
        cut = np.searchsorted(x.owner, np.arange(len(p) + 1))
        texts += [(x.index[a:b], x.value[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    state = [np.zeros(2), np.zeros((2, size), np.float32), np.zeros((2, size, RANK), np.float32)]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            some = order[low:low + BATCH]
            x = Sparse(np.repeat(np.arange(len(some)), [len(texts[k][0]) for k in some]), np.concatenate([texts[k][0] for k in some]), np.concatenate([texts[k][1] for k in some]))
            margin, sums = machine.margin(x, len(some))
            loss = (weight[some] * (1 / (1 + np.exp(-margin)) - target[some]) / len(some)).astype(np.float32)
            each = loss[x.owner] * x.value
            linear, factors = np.zeros_like(machine.linear), np.zeros_like(machine.factors)
            np.add.at(linear, x.index, each)
            np.add.at(factors, x.index, each[:, None] * (sums[x.owner] - machine.factors[x.index] * x.value[:, None]))
            step += 1
            for name, grad, moments in (("bias", float(loss.sum()), state[0]), ("linear", linear + DECAY * machine.linear, state[1]), ("factors", factors + DECAY * machine.factors, state[2])):
                moments[0] = 0.9 * moments[0] + 0.1 * grad
                moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
                move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
                setattr(machine, name, getattr(machine, name) - move)
    unseen = BUCKETS + np.flatnonzero(raw.std(0) == 0)
    machine.linear[unseen], machine.factors[unseen] = 0, 0
    return machine


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            stated = np.array(batch.column(2).cast(pa.float64()).fill_null(float("nan")))
            found = [machine.score(p, stated[p.first:p.first + len(p)]) for p in slices(batch.column(1))]
            yield scores_batch(batch.column(0), np.concatenate(found) if found else np.zeros(0), threshold)

    return docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{chars}`").cast("long").alias("n")).mapInArrow(scan, SCORED)


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    return score_documents(docs, fit(training_sample(docs, labels, target, SAMPLE, LONGEST, also="n_chars")))


@query("op6_quality_fm")
def op6_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder), table(spark, folder, "labels"))
