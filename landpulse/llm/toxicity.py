"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word is the vector of its hash bucket beside the mean vector of its character trigrams. Windows of ``LENGTH`` words,
each overlapping the next by half, go through gated recurrent units in both directions; attention pools the states and
a logistic unit scores the window. A document's score is that of its worst window, so every part of a text counts.

The network is trained in numpy on a bounded sample (``SAMPLE`` texts per class of at most ``LONGEST`` code points). The
labels are of whole texts: after a first phase on random windows, a toxic text is represented by its worst windows, a
clean one by its worst and some others. Scoring reads every text whole, in parallel, without a shuffle.

Labels, language, source and id are never inputs. Null and empty texts, and texts of white space, have no window and the
score 0. A text shorter than a window is padded. Repeated rows get equal scores. Without both classes to learn from,
every score is 0. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.labels import SCORED, Batches, scores_batch, training_sample
from landpulse.llm.tables import documents, query, table
from landpulse.llm.textbytes import LOWER_CODES, U64, Slice, mix, range_hashes, slices, words

THRESHOLD = 0.5
LENGTH, STRIDE = 16, 8
WORD_BUCKETS, CHAR_BUCKETS, WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 1 << 13, 1 << 12, 8, 12, 8, 8
SAMPLE, LONGEST = 2500, 6000
WARM_STEPS, STEPS, BATCH, RATE, REPICK = 300, 1200, 128, 0.01, 100
SCORE_BATCH = 2048
B = 2 * HIDDEN  # both directions side by side


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Vocabulary:
    """Distinct words of some texts: bucket, and trigram buckets of word k in ``grams[at[k]:at[k + 1]]``."""

    bucket: np.ndarray
    grams: np.ndarray
    at: np.ndarray


def vocabulary(part: Slice) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The slice's distinct words, the word number of each word, and the first word of each text."""
    w = words(part)
    keys, first, back = np.unique(range_hashes(part.data, w.start, w.end, LOWER_CODES), return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)  # a trigram is centred on each byte; ends count as spaces
    byte = np.repeat(start, size) + place
    codes = LOWER_CODES[part.data]
    blank, n = LOWER_CODES[32], len(part.data)
    with np.errstate(over="ignore"):
        before = np.where(place > 0, codes[np.maximum(byte - 1, 0)], blank)
        after = np.where(place < np.repeat(size, size) - 1, codes[np.minimum(byte + 1, max(n - 1, 0))], blank)
        grams = mix(before * U64(3) + codes[byte] * U64(5) + after * U64(7)) % U64(CHAR_BUCKETS) if len(byte) else np.zeros(0, U64)
    return Vocabulary((keys % U64(WORD_BUCKETS)).astype(np.int64), grams.astype(np.int64), at), back, w.first


def window_words(back: np.ndarray, first: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window (rows of LENGTH; ``blank`` pads) and the text of each window."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE)))
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(number * STRIDE, np.maximum(n[text] - LENGTH, 0))  # the last window ends with the text
    at = begin[:, None] + np.arange(LENGTH)
    inside = at < n[text][:, None]
    return np.where(inside, back[np.minimum(first[text][:, None] + at, max(len(back) - 1, 0))], blank) if len(back) else np.zeros((0, LENGTH), np.int64), text


class Network:
    def __init__(self, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.2: random.normal(0, scale, shape).astype(np.float32)
        size = WORD_SIZE + CHAR_SIZE
        apart = np.zeros((B, 3 * B), np.float32)  # the directions do not see each other's state
        for gate in range(3):
            for side in range(2):
                apart[side * HIDDEN:(side + 1) * HIDDEN, gate * B + side * HIDDEN:gate * B + (side + 1) * HIDDEN] = 1
        self.apart = apart
        self.p = {"word": draw(WORD_BUCKETS, WORD_SIZE), "char": draw(CHAR_BUCKETS, CHAR_SIZE), "input": draw(size, 3 * B), "bias": np.zeros(3 * B, np.float32),
                  "state": draw(B, 3 * B) * apart, "attend": draw(B, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32), "focus": draw(ATTENTION),
                  "out": draw(B), "out_bias": np.full(1, -1, np.float32)}

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """Word and character vectors of the distinct words, and a row of zeros for padding."""
        size = np.diff(v.at)
        chars = np.add.reduceat(self.p["char"][v.grams], v.at[:-1], axis=0) / size[:, None].astype(np.float32) if len(size) else np.zeros((0, CHAR_SIZE), np.float32)
        x = np.concatenate([self.p["word"][v.bucket], chars], 1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """Scores of windows from their gate inputs (LENGTH, windows, 3B) before the state is added."""
        p, n = self.p, gates.shape[1]
        h, tape = np.zeros((n, B), np.float32), []
        states = np.empty((LENGTH, n, B), np.float32)
        for t in range(LENGTH):
            x, g = gates[t], h @ p["state"]
            zr = _sigmoid(x[:, :2 * B] + g[:, :2 * B])
            z, r = zr[:, :B], zr[:, B:]
            new = np.tanh(x[:, 2 * B:] + r * g[:, 2 * B:])
            if keep:
                tape.append((h, z, r, new, g[:, 2 * B:]))
            h = new + z * (h - new)
            states[t, :, :HIDDEN] = h[:, :HIDDEN]
            states[LENGTH - 1 - t, :, HIDDEN:] = h[:, HIDDEN:]
        hidden = np.tanh(states @ p["attend"] + p["attend_bias"])
        logits = np.where(real, hidden @ p["focus"], np.float32(-1e9))
        weights = np.exp(logits - logits.max(0))
        weights /= weights.sum(0)
        pooled = np.einsum("tn,tnb->nb", weights, states)
        score = _sigmoid(pooled @ p["out"] + p["out_bias"])
        return (score, tape, states, hidden, weights, pooled) if keep else score

    def gates(self, projected: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Gate inputs in time order: the forward half of each gate from word t, the backward half from the mirrored word."""
        near = projected[at.T]
        far = near[::-1]
        side = np.tile(np.repeat([True, False], HIDDEN), 3)
        return np.where(side, near, far)

    def score(self, v: Vocabulary, at: np.ndarray) -> np.ndarray:
        projected = self.inputs(v) @ self.p["input"] + self.p["bias"]
        blank = len(projected) - 1
        return np.concatenate([self.forward(self.gates(projected, at[k:k + SCORE_BATCH]), at[k:k + SCORE_BATCH].T != blank) for k in range(0, len(at), SCORE_BATCH)] or [np.zeros(0, np.float32)])

    def gradients(self, v: Vocabulary, at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of some windows."""
        p, blank = self.p, len(v.bucket)
        own, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        known = own[own < blank]
        size = v.at[known + 1] - v.at[known]
        cut = np.concatenate([[0], np.cumsum(size)])
        grams = v.grams[np.repeat(v.at[known] - cut[:-1], size) + np.arange(cut[-1])]
        few = Vocabulary(v.bucket[known], grams, cut)
        x = self.inputs(few)[:len(own)] if len(own) > len(known) else self.inputs(few)[:-1]
        projected = x @ p["input"] + p["bias"]
        gates, real = self.gates(projected, local), at.T != blank
        score, tape, states, hidden, weights, pooled = self.forward(gates, real, True)
        out = {k: np.zeros_like(a) for k, a in p.items()}
        d = ((score - target) * weight / len(target)).astype(np.float32)
        out["out"], out["out_bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["out"]
        d_states = weights[:, :, None] * d_pooled
        d_weights = (states * d_pooled).sum(2)
        d_logits = weights * (d_weights - (weights * d_weights).sum(0)) * real
        out["focus"] = np.einsum("tn,tna->a", d_logits, hidden)
        d_hidden = d_logits[:, :, None] * p["focus"] * (1 - hidden * hidden)
        out["attend"], out["attend_bias"] = np.einsum("tnb,tna->ba", states, d_hidden), d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ p["attend"].T
        d_gates, dh = np.zeros_like(gates), np.zeros_like(pooled)
        for t in range(LENGTH - 1, -1, -1):
            h, z, r, new, g = tape[t]
            dh = dh + np.concatenate([d_states[t, :, :HIDDEN], d_states[LENGTH - 1 - t, :, HIDDEN:]], 1)
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * g * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], 1)
            d_g = np.concatenate([d_z, d_r, d_new * r], 1)
            out["state"] += h.T @ d_g
            dh = dh * z + d_g @ p["state"].T
        out["state"] *= self.apart
        side = np.tile(np.repeat([True, False], HIDDEN), 3)
        d_words = np.where(side, d_gates, d_gates[::-1])
        d_projected = np.zeros_like(projected)
        np.add.at(d_projected, local.T.ravel(), d_words.reshape(-1, d_words.shape[2]))
        out["bias"], out["input"] = d_projected.sum(0), x.T @ d_projected
        d_x = (d_projected @ p["input"].T)[:len(known)]
        np.add.at(out["word"], few.bucket, d_x[:, :WORD_SIZE])
        np.add.at(out["char"], grams, np.repeat(d_x[:, WORD_SIZE:] / size[:, None].astype(np.float32), size, axis=0))
        return out


def worst(scores: np.ndarray, text: np.ndarray, docs: int) -> np.ndarray:
    """Greatest window score of each text, 0 without a window."""
    out = np.zeros(docs)
    np.maximum.at(out, text, scores)
    return out


def fit(rows: list[tuple[str, int]], seed: int = 3) -> Network | None:
    label = np.array([y for _, y in rows])
    if len(set(label.tolist())) < 2:
        return None
    random, network = np.random.default_rng(seed), Network()
    (part,) = slices(pa.array([t for t, _ in rows]), 1 << 40)
    v, back, first = vocabulary(part)
    at, text = window_words(back, first, len(v.bucket))
    target = label[text].astype(np.float32)
    groups = [np.flatnonzero(label[text] == y) for y in (0, 1)]
    moments = {k: np.zeros((2, *a.shape), np.float32) for k, a in network.p.items()}
    for step in range(1, WARM_STEPS + STEPS + 1):
        if step > WARM_STEPS and (step - WARM_STEPS - 1) % REPICK == 0:
            score = network.score(v, at)
            order = np.lexsort((-score, text))
            rank = np.empty(len(text), np.int64)
            rank[order] = np.arange(len(text)) - np.searchsorted(text, text[order])
            clean = np.flatnonzero((target == 0) & (rank < 2))
            groups = [np.concatenate([clean, random.choice(np.flatnonzero(target == 0), len(clean))]), np.flatnonzero((target == 1) & (rank < 1))]
        some = np.concatenate([random.choice(g, BATCH // 2) for g in groups])
        grads = network.gradients(v, at[some], target[some], np.ones(len(some), np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (WARM_STEPS + STEPS + 1)))
        for k, grad in grads.items():
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.995 * m[1] + 0.005 * grad * grad
            network.p[k] = network.p[k] - (rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.995 ** step)) + 1e-7)).astype(np.float32)
    return network


def score_documents(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for part in slices(batch.column(1)):
                if network is None:
                    found.append(np.zeros(len(part)))
                    continue
                v, back, first = vocabulary(part)
                at, owner = window_words(back, first, len(v.bucket))
                found.append(worst(network.score(v, at), owner, len(part)))
            yield scores_batch(batch.column(0), np.concatenate(found) if found else np.zeros(0), threshold)

    return docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(scan, SCORED)


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    return score_documents(docs, fit(training_sample(docs, labels, target, SAMPLE, LONGEST)))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder), table(spark, folder, "labels"))
