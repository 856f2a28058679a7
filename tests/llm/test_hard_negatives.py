"""Hard negatives against all inner products, and the tree's eliminations against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, cell string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    kept = []
    for ident, vector, label, *_ in rows:
        if ident is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((ident, (label + 1) % 10 if ident % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))
    out = []
    for k, (ident, label, vector) in enumerate(kept):
        if ident % 100:
            continue
        scored = [(-dot(vector, w), j, i, y) for n, (j, y, w) in enumerate(kept) if n != k for i in [n]]
        for minus, other, n, _ in sorted(s for s in scored if s[3] == label)[:5]:
            some = sorted(s for s in scored if s[3] != label and 30 * -minus <= -100 * s[0] <= 90 * -minus)[:10]
            out += [(ident, other, r + 1, s[1], -minus, -s[0]) for r, s in enumerate(some)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(hard_negatives.encode(frame, F.col("vec_id"), moved, F.col("embedding")), lambda i: i % 100 == 0)
    return sorted(tuple(r) for r in found.select(COLUMNS).collect())


def table(seed, n=900):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(n):
        centre = draw.choice(centres)
        rows.append((k, [x + draw.gauss(0, 0.3) for x in centre], draw.randint(0, 4), 0.5, "x"))
    rows += [(1000 + k, rows[100][1], k % 3, 0.5, "x") for k in range(120)]  # equal vectors: ties
    rows += [(300, [0.1] * 6, 1, None, None), (None, [0.5] * 6, 1, None, None), (2000, None, 1, None, None), (2100, [None] * 6, 1, None, None), (2200, [float("nan")] * 6, 1, None, None),
             (2300, [float("inf")] * 6, 2, None, None), (2400, [0.5] * 6, None, None, None), (2500, [], 2, None, None), (2600, [1.0, 2.0], 2, None, None), (2700, [1e6] * 6, 3, None, None), (2701, [0.9e6] * 6, 3, None, None),
             (2702, [0.5e6] * 6, 2, None, None), (2800, [0.0] * 6, 4, None, None), (2900, [1e18] * 6, 5, None, None), (2901, [1e18] * 6, 5, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_all_products(spark, monkeypatch, seed):
    if seed == 2:  # hot cells in many slices, leaves inside a slice
        monkeypatch.setattr(hard_negatives, "SLICE_NUMBERS", 500)
        monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 20)
    rows = table(seed)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 300


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_ranges_rule_out_only_what_cannot_score():
    random_ = np.random.default_rng(3)
    centres = random_.normal(0, 300, (12, 8))
    rows = np.floor(centres[random_.integers(0, 12, 4000)] + random_.normal(0, 12, (4000, 8)))
    split, leaves = hard_negatives.local_split(rows)
    asked = rows[::100]
    scores = hard_negatives.products(asked, rows)
    high = np.sort(scores, 1)[:, -1].astype(float)
    for low, top in ((np.sort(scores, 1)[:, -10].astype(float), high), (high * 0.3, high * 0.4)):
        meets = split.meets(asked, low, top)
        for j, leaf in enumerate(leaves):
            inside = ((scores[:, leaf] >= low[:, None]) & (scores[:, leaf] <= top[:, None])).any(1)
            assert meets[inside, j].all()
        assert meets.mean() < 0.75  # and the ranges do rule subtrees out


def test_wide_scores_are_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**40, 1.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 3, 2**63 - 1]]
