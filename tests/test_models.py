"""Fitted models and metrics against direct calculations on small fixtures."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landpulse.operators import audit as au, explain as xp, modeling as md, serving as sv, skew
from landpulse.plans.adapters import derived
from landpulse.plans.registry import Tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(600), 2)
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame([("t", i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))],
                               "target string, id long, y_true int, predicted_probability double").cache()
    return df, p, y


def test_ranking_metrics(scored):
    df, p, y = scored
    row = md.ranking_metrics(df, ["target"]).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap = sum((y[p == s].sum() / y.sum()) * y[p >= s].mean() for s in np.unique(p))
    assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(ap)
    assert row["brier_score"] == pytest.approx(((p - y) ** 2).mean())


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([("t", 0, 0.2), ("t", 0, 0.4)], "target string, y_true int, predicted_probability double")
    row = md.ranking_metrics(df, ["target"]).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_top_share(scored):
    df, p, y = scored
    top = np.lexsort((np.arange(600), -p))[:60]
    row = md.top_share_metrics(df, ["target"], "id").first()
    assert row["k"] == 60 and row["precision_at_10pct"] == pytest.approx(y[top].mean())
    assert row["recall_at_10pct"] == pytest.approx(y[top].sum() / y.sum())


def test_calibration_error(scored):
    df, p, y = scored
    edges, error = np.linspace(0, 1, 11), 0.0
    for i in range(10):
        inside = (p >= edges[i]) & ((p < edges[i + 1]) | ((i == 9) & (p <= 1)))
        if inside.any():
            error += inside.mean() * abs(p[inside].mean() - y[inside].mean())
    assert md.calibration_error(df, ["target"]).first()["ece_10bin"] == pytest.approx(error)
    assert md.calibration_bins(df.filter("predicted_probability < 0.3"), ["target"]).count() == 10
    assert [float(e) for e in edges] == md.BIN_EDGES


def test_platt_matches_newton(spark, scored):
    df, p, y = scored
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.log(q / (1 - q))
    a, b = 0.0, 0.0
    for _ in range(60):  # penalised likelihood with C = 1, intercept free
        s = 1 / (1 + np.exp(-(a * x + b)))
        w = s * (1 - s)
        gradient = np.array([(x * (s - y)).sum() + a, (s - y).sum()])
        hessian = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
    model = md.fit_platt(df)
    assert model.coefficients[0] == pytest.approx(a, abs=1e-4) and model.intercept == pytest.approx(b, abs=1e-4)
    applied = md.apply_platt(df, md.platt_artifact(spark, model, "t")).orderBy("id").first()["predicted_probability"]
    assert applied == pytest.approx(1 / (1 + math.exp(-(a * x[0] + b))), abs=1e-4)


def test_isotonic_matches_pooling(scored):
    df, p, y = scored
    blocks = [[y[p == s].mean(), (p == s).sum(), [s]] for s in np.unique(p)]
    i = 0
    while i < len(blocks) - 1:  # pool neighbours that break the order
        if blocks[i][0] > blocks[i + 1][0]:
            m, n, xs = blocks.pop(i + 1)
            blocks[i] = [(blocks[i][0] * blocks[i][1] + m * n) / (blocks[i][1] + n), blocks[i][1] + n, blocks[i][2] + xs]
            i = max(i - 1, 0)
        else:
            i += 1
    expected = {round(x, 2): m for m, _, xs in blocks for x in xs}
    got = md.apply_isotonic(df, md.fit_isotonic(df)).join(df.select("id", F.col("predicted_probability").alias("raw")), "id").collect()
    assert all(r["predicted_probability"] == pytest.approx(expected[round(r["raw"], 2)], abs=1e-9) for r in got)


def test_split_is_chronological_and_disjoint(spark):
    rows = [(f"P{i:03d}", i % 40) for i in range(101) for _ in range(2)]
    df = spark.createDataFrame(rows, "project_id string, d int").select("project_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("project_start_date"))
    got = {r["project_id"]: r["split"] for r in md.project_split(df).collect()}
    order = sorted({(d, p) for p, d in rows})
    assert [got[p] for _, p in order] == ["train"] * 70 + ["validation"] * 15 + ["test"] * 16


def test_pairwise_complete_rank_correlation(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 9, 80), rng.integers(0, 9, 80), rng.random(80)
    rows = [(float(x), None if i % 5 == 0 else float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["spearman"] for r in au.spearman_matrix(df, ["a", "b", "c"]).collect()}
    mid = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    keep = np.arange(80) % 5 != 0
    assert len(got) == 9
    assert got["a", "c"] == pytest.approx(np.corrcoef(mid(a), mid(c))[0, 1])
    assert got["b", "a"] == pytest.approx(np.corrcoef(mid(a[keep]), mid(b[keep]))[0, 1])


def test_trend_guards(spark):
    few = [("t", "few", float(i), 1.0) for i in range(10)]
    flat = [("t", "flat", float(i % 2), 1.0) for i in range(50)]
    rising = [("t", "rising", float(i), float(i)) for i in range(50)]
    falling = [("t", "falling", float(i), -float(i)) for i in range(50)]
    broken = [("t", "rising", float("nan"), 1.0), ("t", "rising", float("inf"), 1.0)]
    df = spark.createDataFrame(few + flat + rising + falling + broken, "target string, feature string, feature_value double, contribution double")
    got = {r["feature"]: (r["trend"], r["n"]) for r in xp.dependence_trend(df).collect()}
    assert got == {"few": ("insufficient_data", 10), "flat": ("low_variation", 50), "rising": ("mostly_increasing_risk", 50),
                   "falling": ("mostly_decreasing_risk", 50)}


def test_rank_correlations_with_gaps(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"a": rng.integers(0, 5, 300).astype(float), "b": rng.random(300), "c": rng.integers(0, 2, 300).astype(float), "d": rng.random(300)})
    frame.loc[::7, "b"], frame.loc[::5, "c"] = np.nan, np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in frame.to_numpy()]
    cells = au.spearman_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()
    assert len(cells) == 16
    for cell in cells:
        x, y = frame[cell["feature_a"]], frame[cell["feature_b"]]
        both = x.notna() & y.notna()
        assert cell["spearman"] == pytest.approx(x[both].rank().corr(y[both].rank()), abs=1e-9)


def test_isotonic_pools_over_ranges(spark, monkeypatch):
    """Against the min-max formula, with many small ranges merged a few at a time, and scores between, at and beyond the fitted ones."""
    monkeypatch.setattr(md, "RANGES_TOGETHER", 2)
    rng = np.random.default_rng(11)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < 0.2 + 0.6 * p).astype(int)
    train = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "predicted_probability double, y_true int")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        model = md.fit_isotonic(train)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    score = np.unique(p)
    n, s = np.array([(p == v).sum() for v in score]), np.array([y[p == v].sum() for v in score])
    mean = lambda a, b: s[a:b + 1].sum() / n[a:b + 1].sum()
    fit = [max(min(mean(a, b) for b in range(i, len(score))) for a in range(i + 1)) for i in range(len(score))]
    asked = [0.0, 0.003, 0.5, 0.505, 0.777, 1.0, *map(float, score[:5])]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(asked)], "id int, predicted_probability double")
    got = {r["id"]: r["predicted_probability"] for r in md.apply_isotonic(rows, model).collect()}
    assert len(got) == len(asked)
    for k, v in enumerate(asked):
        assert got[k] == pytest.approx(np.interp(v, score, fit)), v


def test_isotonic_of_one_score_and_of_nothing(spark):
    rows = spark.createDataFrame([(0.3, 1), (0.3, 0)], "predicted_probability double, y_true int")
    asked = spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "predicted_probability double")
    assert {r[0] for r in md.apply_isotonic(asked, md.fit_isotonic(rows)).collect()} == {0.5}
    assert md.apply_isotonic(asked, md.fit_isotonic(rows.limit(0))).collect() == []


def test_few_bytes_are_spread_over_tasks(spark):
    rows = spark.range(3 * skew.FEW_ROWS).coalesce(1)
    assert skew.spread(rows, 3 * skew.FEW_ROWS).rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    assert skew.spread(rows, 40 * skew.MANY_ROWS).rdd.getNumPartitions() == 40
    assert skew.spread(rows, skew.FEW_ROWS).rdd.getNumPartitions() == 1


def test_a_shared_encoder_gives_the_same_models(spark):
    rows = md.feature_matrix(derived(Tables(spark, "/root/testdata/sf0.001"), "snapshots")).coalesce(1).cache()
    encoder = md.preprocessing(rows).fit(rows)
    encoded = encoder.transform(rows).cache()
    for fit, size in ((md.train_boosted, 3), (md.train_logistic, 20)):
        own, shared = fit(rows, "delay_next_90d", size), fit(encoded, "delay_next_90d", size, encoder)
        p = [[r[-1] for r in md.score(m, rows, "delay_next_90d", "m", []).collect()] for m in (own, shared)]
        assert p[0] == pytest.approx(p[1])


def test_whole_numbers_and_doubles_do_not_pass_through_text(spark):
    base = derived(Tables(spark, "/root/testdata/sf0.001"), "snapshots")
    odd = base.withColumns({"docs_complete_pct": F.lit(float("nan")), "file_pending_days": F.lit(1e-310), "land_required_ha": F.lit(0.1).cast("float"),
                            "case_age_months": F.lit(" 7.5 "), "rnr_consent_pct": F.lit("seven"), "disbursal_pct": F.lit(True)})
    wanted = odd.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in md.BASE_NUMERIC])
    made = md.feature_matrix(odd).select(*md.BASE_NUMERIC)
    assert made.exceptAll(wanted).isEmpty() and wanted.exceptAll(made).isEmpty()
    numbers = base.select(*[F.col(c).cast("double").alias(c) for c in md.BASE_NUMERIC], *[F.lit("x").alias(c) for c in md.BASE_CATEGORICAL])
    plan = md.feature_matrix(numbers, targets=[])._jdf.queryExecution().analyzed().toString()
    assert "try_cast" not in plan.lower() and f"cast(cast({md.BASE_NUMERIC[0]}" not in plan


def test_slopes_of_the_optimum_come_from_vectors(spark):
    rows = md.feature_matrix(derived(Tables(spark, "/root/testdata/sf0.001"), "snapshots")).coalesce(1).cache()
    target, n = "delay_next_90d", rows.count()
    model = md.train_logistic(rows, target, 5)
    found = sv.optimality(rows, {target: model}, 1.0 / n, 1e-4)
    assert "stddev_pop" not in found._jdf.queryExecution().analyzed().toString()  # one aggregate per slot before
    own = model.transform(md.class_weights(rows, target, "balanced")).select("features", "class_weight", "probability", target).collect()
    x, w = np.array([r[0].toArray() for r in own]), np.array([r[1] for r in own])
    d = np.array([r[2][1] - r[3] for r in own])
    slope = (w * d) @ x / w.sum() + model.stages[-1].coefficients.toArray() / n
    s = x.std(0)
    got = {r["feature"]: r["slope"] for r in found.collect()}
    names = [q.feature for q in sv.slots_of(sv.encoder_of(model))]
    assert [got[k] for k in names] == pytest.approx(list(np.where(s > 0, slope / np.where(s > 0, s, 1), slope)), rel=1e-6, abs=1e-9)
    assert got["(intercept)"] == pytest.approx((w * d).sum() / w.sum(), rel=1e-6, abs=1e-12)


def test_linear_fits_of_many_rows_do_not_share_the_memory(spark, monkeypatch):
    from landpulse.plans import modeling as pm

    t, running, most = Tables(spark, "/root/testdata/sf0.001"), [], []

    def fit(train, target, encoder):
        running.append(target)
        time.sleep(0.3)
        most.append(len(running))
        running.remove(target)
        return target

    monkeypatch.setattr(pm, "_FITTED", {})
    monkeypatch.setattr(md, "train_logistic", fit)
    monkeypatch.setattr(pm, "TOGETHER_ROWS", 10)
    assert pm.models(t, "logistic_regression") == {c: c for c in md.TARGETS} and max(most) == 1
    monkeypatch.setattr(pm, "TOGETHER_ROWS", 1_000_000)
    pm._FITTED.clear()
    assert pm.models(t, "logistic_regression") == {c: c for c in md.TARGETS} and max(most) > 1
