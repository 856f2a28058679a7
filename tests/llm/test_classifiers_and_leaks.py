"""Classifiers on held-out rows, their gradients, and decontamination against exact cosines."""

import random

import numpy as np
import pyarrow as pa
import pytest

from landpulse.llm import decontaminate, labels, quality_fm, toxicity
from landpulse.llm.textbytes import slices

LARGE, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def held_out_auc(spark, scored, folder, target):
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("score", target).toPandas()
    rank, y = rows["score"].rank(), rows[target] == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_quality_on_held_out_rows(spark):
    assert held_out_auc(spark, quality_fm.op6_quality_fm(spark, SMALL), SMALL, "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out_auc(spark, toxicity.op5_toxicity(spark, LARGE), LARGE, "toxic") > 0.9


def odd_rows(spark):
    return spark.createDataFrame([(0, None, None, "k"), (1, "", 0, "k"), (2, " \n", 2, "k"), (3, "word", 4, "k"), (3, "word", 4, "k"), (None, "Und " * 40_000, 9, "k")],
                                 "doc_id long, text string, n_chars long, score string")


@pytest.mark.parametrize("module", [quality_fm, toxicity])
def test_scores_of_odd_rows(spark, module):
    rows = [("a b c d e " * 20, 0), ("x y z ! " * 20, 1)] * 20
    for model in (module.fit(rows[:1]), module.fit([]), module.fit(rows)):
        out = module.score_documents(odd_rows(spark), model).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= module.THRESHOLD) for r in out)
        assert out[3]["score"] == out[4]["score"] and out[0]["held_out"] == labels.is_held_out(0)
        assert module.score_documents(odd_rows(spark).limit(0), model).count() == 0


def test_pairwise_identity():
    machine = quality_fm.fit([("a b c", 0), ("d e f !", 1)] * 10)
    (part,) = slices(pa.array(["a c e e"]))
    x = machine.vector(part, np.array([7.0]))
    direct = machine.bias + (machine.linear[x.index] * x.value).sum()
    for i in range(len(x.index)):
        for j in range(i):
            direct += machine.factors[x.index[i]] @ machine.factors[x.index[j]] * x.value[i] * x.value[j]
    assert machine.margin(x, 1)[0][0] == pytest.approx(direct, rel=1e-4)


def test_network_gradients():
    (part,) = slices(pa.array(["one two three four five", "six " * 40]))
    v, back, first = toxicity.vocabulary(part)
    at, _ = toxicity.window_words(back, first, len(v.bucket))
    network, target = toxicity.Network(), np.arange(len(at)) % 2
    network.p = {k: a.astype(np.float64) for k, a in network.p.items()}
    loss = lambda: -float(np.mean(np.where(target == 1, np.log(network.score(v, at)), np.log(1 - network.score(v, at)))))
    grads = network.gradients(v, at, target, np.ones(len(at)))
    for name, grad in grads.items():
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        network.p[name][spot] += 1e-2
        up = loss()
        network.p[name][spot] -= 2e-2
        down = loss()
        network.p[name][spot] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(grad[spot], rel=0.05, abs=2e-5), name


def test_windows_cover_every_word():
    for n in (1, 15, 16, 17, 24, 100):
        at, text = toxicity.window_words(np.arange(n), np.array([0, n]), n)
        assert set(at.ravel().tolist()) - {n} == set(range(n)) and (text == 0).all()


def planted(seed=0):
    r = random.Random(seed)
    word = lambda: "v%d" % (r.randrange(60) if r.random() < 0.4 else 100 + r.randrange(6000))
    items = {k: [word() for _ in range(r.randrange(13, 60))] for k in range(30)}
    docs, truth = {}, set()
    for d in range(300):
        body = [word() for _ in range(r.randrange(0, 400))]
        if d % 10 == 0:
            k, at = r.randrange(30), r.randrange(len(body) + 1)
            quote = list(items[k])
            for _ in range(len(quote) // 8 if d % 20 else 0):  # a paraphrase
                quote[r.randrange(len(quote))] = word()
            body[at:at] = [w.upper() + r.choice([",", ""]) for w in quote]
            truth.add((d, k))
        docs[d] = " ".join(body)
    return items, docs, truth


def test_planted_leaks_and_recall(spark):
    items, docs, truth = planted()
    rows = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(None, None, 1), (400, "", 1), (401, "x " * 100_000, 1)], "doc_id long, text string, item_id int").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(None, None), (99, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows, benchmark).collect()}
    assert found == truth
    stays = decontaminate.drop_leaks(rows, benchmark)
    assert stays.columns == rows.columns
    assert {r["doc_id"] for r in stays.collect()} == (set(docs) | {None, 400, 401}) - {d for d, _ in truth}
    assert decontaminate.find_leaks(rows, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(rows.limit(0), benchmark).count() == 0


def test_candidate_recall_against_exact_cosines(spark):
    items, docs, _ = planted(4)
    texts = pa.array(list(docs.values()))
    frequencies, count = decontaminate.document_frequencies(spark.createDataFrame([(t,) for t in docs.values()], "text string"))
    # the share of the block's passages that production keeps
    passages = sum(len(decontaminate.item_passages(len(w))) for w in items.values())
    space = decontaminate.build_space(spark, [(k, " ".join(w)) for k, w in items.items()], frequencies, count, rank=int(0.8 * passages))
    exact, got = set(), set()
    for part in slices(texts):
        w, keys = decontaminate.word_keys(part)
        got |= {(part.first + t, item) for t, item, *_ in decontaminate.candidates(space, w, keys, 0.5)}
        for t in range(len(part)):
            own = keys[w.first[t]:w.first[t + 1]]
            for a in range(0, len(own), decontaminate.STEP):
                bucket, times = np.unique(decontaminate.bucket_of(own[a:a + decontaminate.PASSAGE]), return_counts=True)
                x = dict(zip(bucket.tolist(), times * space.idf[bucket]))
                norm = sum(v * v for v in x.values()) ** 0.5
                for number, item in enumerate(space.items):
                    for c, e in decontaminate.item_passages(len(item.keys)):
                        other, n = np.unique(decontaminate.bucket_of(item.keys[c:e]), return_counts=True)
                        y = n * space.idf[other]
                        if sum(x.get(b, 0) * v for b, v in zip(other.tolist(), y.tolist())) >= 0.5 * norm * np.linalg.norm(y):
                            exact.add((part.first + t, number))
    assert exact and len(exact & got) >= 0.9 * len(exact)


def test_candidates_lose_no_leak_that_the_alignment_accepts(spark):
    """Edited copies of short and middle items at any offset among rarer words, each pair aligned by brute force."""
    r = random.Random(11)
    common = lambda: "v%d" % int(400 * r.random() ** 3)
    items = {k: [common() if r.random() < 0.7 else "m%d" % r.randrange(2000) for _ in range(r.randrange(8, 50))] for k in range(60)}
    docs = []
    for d in range(900):
        body = [common() if r.random() < 0.4 else "rare%d" % r.randrange(90_000) for _ in range(r.randrange(0, 160))]
        if d % 2:
            quote = list(items[d % 60])
            for at in r.sample(range(len(quote)), int(r.choice([0, 0.1, 0.2, 0.3]) * len(quote))):
                quote[at] = "rare%d" % r.randrange(90_000)
            at = r.randrange(len(body) + 1)
            body[at:at] = quote
        docs.append(" ".join(body))
    frequencies, count = decontaminate.document_frequencies(spark.createDataFrame([(t,) for t in docs], "text string"))
    space = decontaminate.build_space(spark, [(k, " ".join(w)) for k, w in items.items()], frequencies, count)
    texts = pa.array(docs)
    got = {(row, item.ident) for row, item, *_ in decontaminate.leaks(space, texts)}
    wanted = set()
    for part in slices(texts):
        w, keys = decontaminate.word_keys(part)
        for t in range(len(part)):
            own, row = keys[w.first[t]:w.first[t + 1]], part.first + t
            if row % 2:
                shared, answer, _, _, beside = decontaminate.align(space.items[row % 60], own)
                if beside >= decontaminate.BESIDE and (shared >= decontaminate.SURE or (shared >= decontaminate.SHARE and answer >= decontaminate.ANSWER)):
                    wanted.add((row, row % 60))
    assert len(wanted) > 300 and wanted <= got


def test_long_items_are_found_at_the_production_rank(spark):
    r = random.Random(12)
    word = lambda: "v%d" % int(6000 * r.random() ** 2)
    items = {k: [word() for _ in range(300)] for k in range(100)}
    items[100] = [word() for _ in range(decontaminate.PASSAGE * 410)]  # more passages than a block takes
    docs = {d: [word() for _ in range(100)] + (items[d] if d < 100 else items[d - 100][:250] if d < 200 else []) + [word() for _ in range(100)] for d in range(220)}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {len(x) for x in decontaminate.blocks_of(benchmark, "item_id", "text", decontaminate.BLOCK)} == {40, 20, 1}
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(rows, benchmark).collect()}
    assert found == {(d, d % 100) for d in range(200)}


def test_alignment():
    keys = np.arange(20, dtype=np.uint64)
    item = decontaminate.Item(1, keys, np.ones(20, np.float32))
    assert decontaminate.align(item, np.concatenate([keys[:5] + 100, keys]))[:3] == (1.0, 1.0, 5)
    assert decontaminate.align(item, keys[::-1].copy())[0] == pytest.approx(0.05)
    shared, answer, *_ = decontaminate.align(item, keys[:15])
    assert (shared, answer) == (pytest.approx(0.75), 0.0)


def test_stated_length_is_learned_from_its_column(spark):
    """The label follows n_chars, not the text: a null against a number, then a small number against a great one."""
    text = "same words in every text here"
    for odd, even in ((None, 30), (20, 9000)):
        docs = spark.createDataFrame([(k, text, odd if k % 2 else even) for k in range(200)], "doc_id long, text string, n_chars long")
        marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
        rows = {r["doc_id"]: r["score"] for r in quality_fm.classify(docs, marks).collect()}
        assert min(rows[k] for k in range(1, 200, 2)) > 0.5 > max(rows[k] for k in range(0, 200, 2))


def test_a_missing_length_that_never_occurred_does_not_count():
    machine = quality_fm.fit([("a b c d", 0, 7), ("d e f !", 1, 9)] * 20)
    place = quality_fm.BUCKETS + quality_fm.STATISTICS - 1
    assert machine.linear[place] == 0 and not machine.factors[place].any()


def test_words_lose_all_marks_at_their_ends():
    texts = ["word", "word" + "." * 9, "((((((((((((word", "<<<\"word\">>>,,,,,,,,,,,", "." * 30, ".", "a.b", "..a.b..", "é!!!!!!!!!!!", "é"]
    (part,) = slices(pa.array(texts))
    keys = [int(decontaminate.word_keys(part)[1][k]) for k in range(len(texts))]
    assert len(set(keys[:4])) == 1 and keys[4] == keys[5] and keys[6] == keys[7] and keys[8] == keys[9] and len(set(keys)) == 4
