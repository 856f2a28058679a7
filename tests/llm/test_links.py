"""Similarity join, components and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from landpulse.llm import components, jaccard_join, suffix_dedup


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute_components(texts, size=4, threshold=85):
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= threshold * union:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed, documents=260):
    """Families of edited copies, shared passages, short and empty texts, a very frequent phrase."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    bases = [[word() for _ in range(r.choice([5, 6, 7, 30, 60, 90, 200]))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    out = {0: None, 1: "", 2: " \n", 3: "One", 4: "one\tONE"}
    for k in range(5, documents):
        base = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            base[r.randrange(len(base))] = word()
        if r.random() < 0.2:
            base = base + passage
        out[k * 3] = (" " if r.random() < 0.5 else "\n").join(base if r.random() < 0.7 else [w.upper() for w in base])
    return out


@pytest.mark.parametrize("frequent, hot", [(64, 64), (1, 2)])
def test_join_agrees_with_all_pairs(spark, monkeypatch, frequent, hot):
    # low bounds make nearly every token frequent, so that combinations are used
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", 4 * frequent)
    monkeypatch.setattr(jaccard_join, "HOT_LOCAL", hot)
    texts = corpus(3)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()] + [(9, texts[15], 1, 2), (9, texts[15], 1, 2), (None, texts[15], 1, 2)],
                                 "doc_id long, text string, sig long, component long").repartition(3)
    texts[9] = texts[15]
    rows = jaccard_join.link(docs).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == brute_components(texts)


@pytest.mark.parametrize("frequent", [64, 1])
def test_join_of_five_words_at_eighty_per_cent(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", 4 * frequent)
    texts = corpus(8)
    words = ["u%d" % k for k in range(400)]
    for k, cut in enumerate((400, 321, 324, 330)):  # 80 to 82 per cent of the first: sizes a factor of 1.25 apart
        texts[2000 + k] = " ".join(words[:cut])
    rows = jaccard_join.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), size=5, threshold=80).collect()
    want = brute_components(texts, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert want != brute_components(texts, 5, 85)


def test_parity_bits_lose_no_similar_pair():
    """Two sets differ in at least as many tokens as their parity bits differ, so the bound of the joins is exact."""
    r = np.random.default_rng(4)
    for _ in range(300):
        n, gone, fresh = int(r.integers(1, 3000)), int(r.integers(0, 200)), int(r.integers(0, 200))
        whole = r.choice(1 << 62, n + fresh, replace=False).astype(np.uint64)
        x, y = whole[:n], whole[min(gone, n - 1):]
        bits = jaccard_join.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y), len(x) + len(y)]))
        assert sum(int(v).bit_count() for v in bits[0] ^ bits[1]) <= len(np.setxor1d(x, y)) and not bits[2].any()


def test_a_family_below_the_threshold_makes_no_pairs(spark):
    """A large family of documents that share signatures but are not similar: only the one similar pair becomes a row."""
    r = random.Random(6)
    base = ["w%d" % k for k in range(150)]
    texts = {}
    for k in range(120):
        own = list(base)
        for at in range(3 + k % 7, 150, 14):  # every fourteenth word is its own
            own[at] = "x%d" % r.randrange(10**9)
        texts[k] = " ".join(own)
    texts[200] = texts[7] + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    profile = jaccard_join.profiles(docs, 4)
    rows = profile.filter("doc_id is not null").selectExpr("7L as sig", "doc_id", "doc_id as component", "n_shingles as n", "odd")
    assert [tuple(p) for p in jaccard_join.pairs_across(rows, 85).collect()] == [(7, 200)]
    centred = rows.selectExpr("sig", "doc_id", "7L as a")
    assert [tuple(p) for p in jaccard_join.near_centre(centred, profile, 85).collect()] == [(7, 200)]
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.link(docs).collect()} == brute_components(texts)


def test_join_of_a_repeated_id_with_two_texts(spark):
    """Both texts of an id can link it, whichever stands first."""
    base = ["w%d" % k for k in range(200)]
    texts = [" ".join(base), " ".join("y" + w for w in base), " ".join(base[:150] + ["z"] + base[151:]), " ".join("y" + w for w in base[:190])]
    for first, second in ((0, 1), (1, 0)):
        docs = spark.createDataFrame([(1, texts[first]), (1, texts[second]), (5, texts[2]), (6, texts[3])], "doc_id long, text string")
        assert {x["doc_id"]: x["component_id"] for x in jaccard_join.link(docs).collect()} == {1: 1, 5: 1, 6: 1}


def test_join_of_nothing(spark):
    assert jaccard_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.link(spark.createDataFrame([], "doc_id long, text string"), threshold=50)


def test_frequent_signatures_meet():
    """Sets that share enough share a signature, whatever the classes of their tokens."""
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(50, 400))
        x = np.sort(r.choice(1 << 40, n, replace=False)).astype(np.uint64)
        extra = np.sort(r.choice(1 << 40, n, replace=False)).astype(np.uint64)
        lost = int(r.integers(0, n * 15 // 200 + 1))
        y = np.unique(np.concatenate([x[lost:], extra[:lost]]))
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        made = []
        for s in (x, y):
            kind = 1 + (s % 3).astype(np.int8)
            order = np.lexsort((s, kind))
            level = jaccard_join.level_of(len(s))
            made.append({t for at in (level, level + 1) for t in jaccard_join.frequent_signatures(s[order], kind[order], at, len(s) * 15 // 100, 15)})
        assert made[0] & made[1]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 2000 + k) for k in range(100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {n: root(n) for n in got} and {n for e in edges for n in e if e[0] != e[1]} == set(got)


def brute_removal(texts, length=50):
    first = {}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for k in sorted(raw):
        for i in range(len(raw[k]) - length + 1):
            first.setdefault(raw[k][i:i + length], k)
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < k:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, flush, packed, share", [(256, 500_000, 1 << 22, 200_000), (1, 500, 0, 200_000), (256, 500, 1 << 22, 40)])
def test_suffix_dedup_agrees_with_brute_force(spark, monkeypatch, hot, flush, packed, share):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)  # buckets are settled in many shares
    monkeypatch.setattr(suffix_dedup, "HOT_GRAM", hot)
    monkeypatch.setattr(suffix_dedup, "PACKED_DOCUMENTS", packed)  # no bucket's documents fit into packed numbers
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    r = random.Random(5)
    piece = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    shared = [piece(n) for n in (20, 40, 49, 50, 51, 70, 200)]
    texts = {0: None, 1: "", 2: "x" * 49, 3: "x" * 50, 4: "x" * 300, 5: "ab" * 100, 6: "ba" * 60}
    for k in range(7, 90):
        texts[k] = "".join(r.choice(shared) if r.random() < 0.5 else piece(r.randrange(80)) for _ in range(r.randrange(1, 7)))
    texts[90] = texts[8] = texts[20]
    docs = spark.createDataFrame([(k, t, b"1", 2) for k, t in texts.items()] + [(None, texts[20], b"1", 2), (20, texts[20], b"1", 2)], "doc_id long, text string, gone binary, open long").repartition(4)
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] is not None}
    assert got == brute_removal(texts)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_hot_grams_of_one_task_meet_the_other_tasks(spark, monkeypatch):
    """A q-gram with many rows in one task loses nothing that another task has too: a line repeated in one document, and runs that differ."""
    r = random.Random(9)
    line = "".join(r.choice("abcdefghij ") for _ in range(321)) + "\n"
    core = "".join(r.choice("klmnop") for _ in range(60))
    near = lambda n: [core + "".join(r.choice("qrstuv") for _ in range(40)) for _ in range(n)]
    texts = {1: "begin " + line + "end", 2: line * 300, 3: near(1)[0], 4: "\n".join(near(12)), 5: "\n".join(near(12))}
    groups = [[(k, texts[k]) for k in some] for some in ([1], [2], [3], [4, 5])]  # a task each
    apart = spark.createDataFrame(spark.sparkContext.parallelize(groups, len(groups)).flatMap(lambda x: x), "doc_id long, text string")
    assert apart.rdd.getNumPartitions() == len(groups)
    for hot in (256, 4):
        monkeypatch.setattr(suffix_dedup, "HOT_GRAM", hot)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(apart).collect()} == brute_removal(texts)
