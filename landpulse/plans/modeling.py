"""M queries: features, labels, split, models, metrics, calibration. Fitted models have no SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from landpulse.operators import modeling as md, quality as q, skew
from landpulse.plans.adapters import WITH_GAPS_SQL, derived, snapshots_with_gaps, with_tables
from landpulse.plans.registry import iso, query, r
from landpulse.session import durable

GROUP = ["target", "split"]
EDGES = ", ".join(f"({i + 1}, {md.BIN_EDGES[i]!r}::DOUBLE, {md.BIN_EDGES[i + 1]!r}::DOUBLE)" for i in range(10))
BINS = f"SELECT * FROM (VALUES {EDGES}) AS e(bin, lo, hi)"
BINNED = """
SELECT target, split, bin, count(*) AS n, avg(predicted_probability) AS p, avg(y_true) AS y FROM predictions
JOIN e ON predicted_probability >= lo AND (predicted_probability < hi OR bin = 10 AND predicted_probability <= hi) GROUP BY ALL"""
SPLIT = """
SELECT project_id, project_start_date, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT project_id, min(project_start_date) AS project_start_date, row_number() OVER (ORDER BY min(project_start_date), project_id) - 1 AS i, count(*) OVER () AS n
      FROM snapshots GROUP BY project_id)"""
NUMBERS = ["file_pending_days", "docs_complete_pct", "rnr_progress_pct", "total_parcels"]


@query("m01_feature_matrix", with_tables("snapshots", g=WITH_GAPS_SQL) + f"""
SELECT snapshot_id, {', '.join(f'{r(c)} AS {c}' for c in NUMBERS)}, {r('land_to_acquire_ha / NULLIF(land_required_ha, 0)')} AS land_acquisition_ratio,
  {r('affected_families / NULLIF(total_parcels, 0)')} AS affected_family_per_parcel, {r('vulnerable_families / NULLIF(affected_families, 0)')} AS vulnerable_family_share,
  {r('GREATEST(compensation_awarded_cr - compensation_disbursed_cr, 0)')} AS compensation_pending_cr, {r('100 - rnr_progress_pct')} AS rnr_remaining_pct,
  {r('CASE WHEN docs_complete_pct IS NOT NULL THEN GREATEST(100 - docs_complete_pct, 0) END')} AS docs_remaining_pct, current_stage,
  COALESCE(approval_dept, 'UNKNOWN') AS approval_dept, delay_next_30d, delay_next_60d, delay_next_90d FROM g""")
def _(t):
    return md.feature_matrix(snapshots_with_gaps(t), ["snapshot_id"]).select(
        "snapshot_id", *NUMBERS, *md.ENGINEERED, "current_stage", "approval_dept", *q.TARGETS)


@query("m01_label_domain", with_tables("snapshots") + " UNION ALL ".join(
    f"SELECT '{c}' AS target, count(*) FILTER ({c} + (court_cases_count // 5) * 2 NOT IN (0, 1)) AS invalid_labels FROM snapshots" for c in q.TARGETS))
def _(t):
    odd = F.when(F.col("court_cases_count") >= 5, 2).otherwise(0)
    return md.label_domain(derived(t, "snapshots").withColumns({c: F.col(c) + odd for c in q.TARGETS}))


@query("m02_feature_manifest", with_tables("snapshots", g=WITH_GAPS_SQL) + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{kind}' AS feature_type, '{'label' if kind == 'target' else 'predictor'}' AS model_role,
    '{'future_window' if kind == 'target' else 'snapshot_time'}' AS availability, '{note}' AS notes, count(*) FILTER ({expr} IS NULL) AS missing_values FROM g"""
    for c, kind, note, expr in [
        *[(c, "numeric", "", c) for c in md.BASE_NUMERIC],
        ("land_acquisition_ratio", "engineered_numeric", "land_to_acquire_ha / land_required_ha", "land_to_acquire_ha / NULLIF(land_required_ha, 0)"),
        ("affected_family_per_parcel", "engineered_numeric", "affected_families / total_parcels", "affected_families / NULLIF(total_parcels, 0)"),
        ("vulnerable_family_share", "engineered_numeric", "vulnerable_families / affected_families", "vulnerable_families / NULLIF(affected_families, 0)"),
        ("compensation_pending_cr", "engineered_numeric", "compensation_awarded_cr - compensation_disbursed_cr", "compensation_awarded_cr"),
        ("rnr_remaining_pct", "engineered_numeric", "100 - rnr_progress_pct", "rnr_progress_pct"),
        ("docs_remaining_pct", "engineered_numeric", "100 - docs_complete_pct", "docs_complete_pct"),
        *[(c, "categorical", "", f"COALESCE({c}, 'UNKNOWN')") for c in md.BASE_CATEGORICAL],
        *[(c, "target", md.LABEL_NOTE, c) for c in q.TARGETS]]))
def _(t):
    return md.feature_manifest(md.feature_matrix(snapshots_with_gaps(t)))


@query("m03_leakage_guard", """SELECT c AS "column", (SELECT count(*) FROM orders) AS rows FROM (VALUES ('event_count_so_far'), ('is_censored')) AS v(c)""")
def _(t):
    return md.leakage_guard(md.PREDICTORS + ["is_censored", "event_count_so_far"], derived(t, "snapshots"))


@query("m04_alignment_check", with_tables("snapshots", f="""
SELECT * REPLACE (CASE WHEN current_stage = '3D' THEN 'f' || snapshot_id ELSE snapshot_id END AS snapshot_id) FROM snapshots""", s="""
SELECT * REPLACE (CASE WHEN court_cases_count = 3 THEN NULL ELSE delay_next_30d END AS delay_next_30d, CASE WHEN approval_dept = 'Revenue' THEN 's' || snapshot_id ELSE snapshot_id END AS snapshot_id) FROM snapshots""") + """
SELECT count(*) FILTER (s.snapshot_id IS NULL) AS only_in_features, count(*) FILTER (f.snapshot_id IS NULL) AS only_in_snapshots,
  count(*) FILTER (s.snapshot_id = f.snapshot_id AND f.delay_next_30d IS DISTINCT FROM s.delay_next_30d) AS mismatch_delay_next_30d,
  count(*) FILTER (s.snapshot_id = f.snapshot_id AND f.delay_next_60d IS DISTINCT FROM s.delay_next_60d) AS mismatch_delay_next_60d,
  count(*) FILTER (s.snapshot_id = f.snapshot_id AND f.delay_next_90d IS DISTINCT FROM s.delay_next_90d) AS mismatch_delay_next_90d
FROM f FULL JOIN s ON f.snapshot_id = s.snapshot_id""")
def _(t):
    rows = derived(t, "snapshots")
    named = lambda hit, mark: F.when(hit, F.concat(F.lit(mark), "snapshot_id")).otherwise(F.col("snapshot_id"))
    other = rows.withColumns({"delay_next_30d": F.when(F.col("court_cases_count") != 3, F.col("delay_next_30d")), "snapshot_id": named(F.col("approval_dept") == "Revenue", "s")})
    return md.alignment_check(rows.withColumn("snapshot_id", named(F.col("current_stage") == "3D", "f")), other)


@query("m05_project_split", with_tables("snapshots", s=SPLIT) + f"SELECT project_id, {iso('project_start_date')} AS project_start_date, split FROM s")
def _(t):
    return md.project_split(derived(t, "snapshots"))


@query("m06_split_summary", with_tables("snapshots", s=SPLIT) + f"""
SELECT split, count(DISTINCT s.project_id) AS projects, count(*) AS snapshots, {iso('min(s.project_start_date)')} AS earliest_project_start,
  {iso('max(s.project_start_date)')} AS latest_project_start FROM snapshots x JOIN s ON x.project_id = s.project_id GROUP BY split""")
def _(t):
    rows = derived(t, "snapshots")
    return md.split_summary(md.with_split(rows, md.project_split(rows)))


@query("m06_split_leaks", with_tables("snapshots", c="SELECT project_id, count(DISTINCT current_stage) AS n FROM snapshots GROUP BY 1") + """
SELECT count(*) FILTER (n > 1) AS leaked_projects, count(*) AS projects FROM c""")
def _(t):
    # Stages instead of parts: projects do occur in several of them.
    return md.split_leaks(derived(t, "snapshots").withColumn("split", F.col("current_stage")))


@query("m07_preprocess", with_tables("snapshots", g=WITH_GAPS_SQL, m="SELECT median(docs_complete_pct) AS d, median(file_pending_days) AS f FROM g", c="""
SELECT 28 + count(DISTINCT current_stage) + count(DISTINCT COALESCE(approval_dept, 'UNKNOWN')) + count(DISTINCT terrain_type) + count(DISTINCT urban_rural) AS n FROM g""") + f"""
SELECT snapshot_id, CAST(n AS INTEGER) AS slots, {r('COALESCE(docs_complete_pct, d)')} AS docs_complete_pct, {r('COALESCE(file_pending_days, f)')} AS file_pending_days,
  (approval_dept IS NULL)::INT AS unknown_dept FROM g, m, c""")
def _(t):
    rows = md.feature_matrix(snapshots_with_gaps(t), ["snapshot_id"])
    done = md.preprocessing(rows).fit(rows).transform(rows)
    # The last of the four approval-department slots, in alphabetical order, is UNKNOWN: three stages and four departments follow 28 numbers.
    vector = vector_to_array("features")
    return done.select("snapshot_id", F.size(vector).alias("slots"), F.col("docs_complete_pct__filled").alias("docs_complete_pct"),
                       F.col("file_pending_days__filled").alias("file_pending_days"), vector[28 + 3 + 3].cast("int").alias("unknown_dept"))


@query("m07_mode_fill", with_tables("snapshots", g=WITH_GAPS_SQL, m="SELECT approval_dept AS v FROM g WHERE approval_dept IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1") + """
SELECT snapshot_id, COALESCE(approval_dept, (SELECT v FROM m)) AS approval_dept FROM g""")
def _(t):
    rows = snapshots_with_gaps(t)
    return md.fill_modes(rows, rows).select("snapshot_id", "approval_dept")


@query("m08_prior_baseline", with_tables("snapshots", s=SPLIT, x="SELECT * FROM snapshots JOIN s USING (project_id) WHERE split = 'train'") + " UNION ALL ".join(
    f"SELECT '{c}' AS target, {r(f'avg({c})')} AS prior_probability, count(*) AS train_rows FROM x" for c in q.TARGETS))
def _(t):
    rows = derived(t, "snapshots")
    return md.prior_baseline(md.with_split(rows, md.project_split(rows)))


def _split_matrix(t):
    rows = derived(t, "snapshots")
    matrix = md.feature_matrix(rows, ["snapshot_id", "project_id"])
    return durable(skew.spread(md.with_split(matrix, md.project_split(rows)), rows.count()))  # read by every fit and every scoring below


def part(rows, name):
    return rows.filter(F.col("split") == name)


KEEP = ["snapshot_id", "split"]


_FITTED: dict[tuple, object] = {}
TOGETHER_ROWS = 1_000_000


def once(t, name, make):
    key = t.spark.sparkContext.applicationId, t.folder, name
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[:2] != key[:2]]:
            del _FITTED[old]
        _FITTED[key] = make()
    return _FITTED[key]


def matrix(t):
    """The prepared rows, stored once per session and folder."""
    return once(t, "rows", lambda: _split_matrix(t))


def encoded_train(t):
    """M7 fitted on the training rows, and those rows as it encodes them, stored once per session and folder for all labels."""
    def make():
        train = part(matrix(t), "train")
        encoder = md.preprocessing(train).fit(train)
        return encoder, durable(encoder.transform(train).select("features", *q.TARGETS))

    return once(t, "encoded", make)


def models(t, kind):
    """The fitted pipeline of each label, once per session and folder.

    The labels are fitted side by side, linear models of many rows one after the other: each of them caches all rows while it is fitted.
    """
    def make():
        encoder, train = encoded_train(t)
        rows = train.count()
        if kind == "boosted_trees":
            return md.train_boosted_labels(skew.share(train, rows, len(q.TARGETS)), q.TARGETS, encoder=encoder)
        together = len(q.TARGETS) if rows <= TOGETHER_ROWS else 1
        train = skew.share(train, rows, together)
        with ThreadPoolExecutor(together) as pool:
            return dict(zip(q.TARGETS, pool.map(lambda target: md.train_logistic(train, target, encoder=encoder), q.TARGETS)))

    return once(t, kind, make)


def predictions_of(t, kind, keep=KEEP):
    return md.stack_predictions([md.score(model, matrix(t), target, kind, keep) for target, model in models(t, kind).items()])


@query("m09_logistic_regression")
def _(t):
    return md.ranking_metrics(predictions_of(t, "logistic_regression"), ["target", "model", "split"])


@query("m10_boosted_trees")
def _(t):
    return md.ranking_metrics(predictions_of(t, "boosted_trees"), ["target", "model", "split"])


@query("m11_classification_metrics", with_tables("predictions", c="""
SELECT target, split, count(*) AS n, sum(y_true) AS pos, count(*) FILTER (predicted_probability >= 0.5) AS hit,
  count(*) FILTER (predicted_probability >= 0.5 AND y_true = 1) AS tp FROM predictions GROUP BY 1, 2""") + f"""
SELECT target, split, {r('tp / NULLIF(hit, 0)')} AS precision, {r('tp / NULLIF(pos, 0)')} AS recall, {r('2 * tp / NULLIF(hit + pos, 0)')} AS f1,
  {r('pos / n')} AS positive_rate, n, CAST(pos AS BIGINT) AS positives FROM c""")
def _(t):
    return md.classification_metrics(derived(t, "predictions"), GROUP)


RANKING = """
SELECT target, split, predicted_probability AS p, count(*) AS n, sum(y_true) AS pos FROM predictions GROUP BY 1, 2, 3"""
RUNNING = """
SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(n - pos) OVER v - (n - pos) AS below, sum(pos) OVER g AS pp, sum(n - pos) OVER g AS nn
FROM h WINDOW w AS (PARTITION BY target, split ORDER BY p DESC), v AS (PARTITION BY target, split ORDER BY p), g AS (PARTITION BY target, split)"""


@query("m12_ranking_metrics", with_tables("predictions", h=RANKING, k=RUNNING) + f"""
SELECT target, split, {r('sum(pos * (below + (n - pos) / 2)) / (max(pp) * max(nn))')} AS roc_auc, {r('sum(pos / pp * (tp / seen))')} AS pr_auc,
  {r('sum(p * p * (n - pos) + (1 - p) * (1 - p) * pos) / sum(n)')} AS brier_score, CAST(sum(n) AS BIGINT) AS n, CAST(max(pp) AS BIGINT) AS positives FROM k GROUP BY 1, 2""")
def _(t):
    return md.ranking_metrics(derived(t, "predictions"), GROUP)


@query("m13_top_share_metrics", with_tables("predictions", k="""
SELECT *, row_number() OVER (PARTITION BY target, split ORDER BY predicted_probability DESC, id) AS i, count(*) OVER (PARTITION BY target, split) AS n FROM predictions""") + f"""
SELECT target, split, CAST(max(GREATEST(1, ceil(n * 0.1e0))) AS BIGINT) AS k, {r('avg(y_true) FILTER (i <= GREATEST(1, ceil(n * 0.1e0)))')} AS precision_at_10pct,
  {r('sum(y_true) FILTER (i <= GREATEST(1, ceil(n * 0.1e0))) / sum(y_true)')} AS recall_at_10pct FROM k GROUP BY 1, 2""")
def _(t):
    return md.top_share_metrics(derived(t, "predictions"), GROUP, "id")


def importance(t):
    return md.stack_predictions([md.feature_importance(model, model.transform(matrix(t)), target) for target, model in models(t, "boosted_trees").items()])


@query("m14_feature_importance")
def _(t):
    return importance(t)


@query("m14_importance_check", with_tables("snapshots", s=SPLIT, x="SELECT * FROM snapshots JOIN s USING (project_id) WHERE split = 'train'") + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, {len(md.NUMERIC)} + count(DISTINCT current_stage) + count(DISTINCT COALESCE(approval_dept, 'UNKNOWN')) + count(DISTINCT COALESCE(terrain_type, 'UNKNOWN'))
    + count(DISTINCT COALESCE(urban_rural, 'UNKNOWN')) AS features, 1e0 AS total, 0::BIGINT AS negative FROM x""" for c in q.TARGETS))
def _(t):
    return importance(t).groupBy("target").agg(F.count("feature").alias("features"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def all_predictions(t):
    keep = ["project_id", "snapshot_id", "split"]
    prior = md.score_prior(matrix(t), md.prior_baseline(matrix(t)), keep)
    return md.stack_predictions([prior, *[predictions_of(t, kind, keep) for kind in ("logistic_regression", "boosted_trees")]])


@query("m15_prediction_table")
def _(t):
    return all_predictions(t)


@query("m15_prediction_check", with_tables("snapshots", s=SPLIT, x="SELECT * FROM snapshots JOIN s USING (project_id)") + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, model, split, count(*) AS n, CAST(sum({c}) AS BIGINT) AS positives, count(DISTINCT snapshot_id) AS snapshots, 0::BIGINT AS outside
    FROM x CROSS JOIN (VALUES ('dummy'), ('logistic_regression'), ('boosted_trees')) AS v(model) GROUP BY ALL""" for c in q.TARGETS))
def _(t):
    p = F.col("predicted_probability")
    return all_predictions(t).groupBy("target", "model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("positives"), F.countDistinct("snapshot_id").alias("snapshots"),
        F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("outside"))


@query("m15_beats_prior", " UNION ALL ".join(f"SELECT '{c}' AS target, '{m}' AS model, TRUE AS better FROM (SELECT count(*) FROM orders)" for c in q.TARGETS for m in ("logistic_regression", "boosted_trees")))
def _(t):
    # On the training rows a fitted model must rank better than the constant prior, whose area is one half.
    both = md.stack_predictions([predictions_of(t, kind) for kind in ("logistic_regression", "boosted_trees")]).filter("split = 'train'")
    return md.ranking_metrics(both, ["target", "model"]).select("target", "model", (F.col("roc_auc") > 0.5).alias("better"))


@query("m15_prior_predictions", with_tables("snapshots", s=SPLIT, x="SELECT * FROM snapshots JOIN s USING (project_id)") + " UNION ALL ".join(
    f"""SELECT project_id, snapshot_id, '{c}' AS target, 'dummy' AS model, {c} AS y_true, {r(f"(SELECT avg({c}) FROM x WHERE split = 'train')")} AS predicted_probability
    FROM x WHERE split = 'test'""" for c in q.TARGETS))
def _(t):
    rows = derived(t, "snapshots")
    parts = md.with_split(rows, md.project_split(rows))
    return md.score_prior(part(parts, "test"), md.prior_baseline(parts), ["project_id", "snapshot_id"])


CUT = "LEAST(GREATEST(predicted_probability, 1e-6), 1 - 1e-6)"
NEWTON = with_tables("predictions", d=f"""
SELECT target, ln(q / (1 - q)) AS x, y_true AS y FROM (SELECT target, {CUT} AS q, y_true FROM predictions WHERE split = 'validation')""").replace("WITH ", "WITH RECURSIVE ", 1) + """,
steps(target, i, a, b) AS (SELECT DISTINCT target, 0, 0e0, 0e0 FROM d UNION ALL
  SELECT target, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT target, i, a, b, sum(x * (s - y)) + a AS ga, sum(s - y) AS gb, sum(s * (1 - s) * x * x) + 1 AS haa, sum(s * (1 - s) * x) AS hab, sum(s * (1 - s)) AS hbb
        FROM (SELECT steps.target, i, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS s FROM steps JOIN d ON steps.target = d.target WHERE i < 25) GROUP BY target, i, a, b)),
fitted AS (SELECT target, a, b FROM steps WHERE i = 25)
"""
SIGMOID = f"1 / (1 + exp(-(a * ln({CUT} / (1 - {CUT})) + b)))"


def by_target(t):
    """(label, validation part, test part) of the predictions."""
    rows = derived(t, "predictions")
    return [(target, part(own, "validation"), part(own, "test")) for target in q.TARGETS for own in [rows.filter(F.col("target") == target)]]


def platt_artifacts(t):
    return md.stack_predictions([md.platt_artifact(t.spark, md.fit_platt(validation), target) for target, validation, _ in by_target(t)])


@query("m16_platt_artifact", NEWTON + """
SELECT target, 'sigmoid' AS method, 1 AS version, 1e-6 AS epsilon, ROUND(a, 4) AS coefficient, ROUND(b, 4) AS intercept FROM fitted""")
def _(t):
    return platt_artifacts(t).withColumns({c: F.round(c, 4) for c in ("coefficient", "intercept")})


@query("m16_platt_calibrator", NEWTON + f"""
SELECT id, target, y_true, ROUND({SIGMOID}, 4) AS predicted_probability FROM predictions JOIN fitted USING (target) WHERE split = 'test'""")
def _(t):
    test = part(derived(t, "predictions"), "test")
    return md.apply_platt(test, platt_artifacts(t)).select("id", "target", "y_true", F.round("predicted_probability", 4).alias("predicted_probability"))


# The isotonic fit at score i is the largest, over starts a <= i, of the smallest mean of scores a..b, over ends b >= i.
ISOTONIC = {
    "v": """SELECT target, p, n, s, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs
FROM (SELECT target, predicted_probability AS p, count(*) AS n, sum(y_true) AS s FROM predictions WHERE split = 'validation' GROUP BY 1, 2) WINDOW w AS (PARTITION BY target ORDER BY p)""",
    "means": "SELECT a.target, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM v a JOIN v b ON a.target = b.target AND a.i <= b.i",
    "ends": "SELECT target, a, b AS i, min(m) OVER (PARTITION BY target, a ORDER BY b DESC) AS m FROM means",
    "fit": "SELECT v.target, v.p, max(m) AS g FROM ends JOIN v ON ends.target = v.target AND ends.i = v.i GROUP BY v.target, v.p",
    "x": """SELECT id, target, y_true, LEAST(GREATEST(predicted_probability, lo), hi) AS p
FROM predictions JOIN (SELECT target, min(p) AS lo, max(p) AS hi FROM fit GROUP BY 1) USING (target) WHERE split = 'test'""",
    "near": """SELECT x.*, lo.p AS p0, lo.g AS g0, hi.p AS p1, hi.g AS g1 FROM x ASOF JOIN fit lo ON x.target = lo.target AND x.p >= lo.p
ASOF JOIN fit hi ON x.target = hi.target AND x.p <= hi.p""",
}


@query("m17_isotonic_calibrator", with_tables("predictions", **ISOTONIC) + f"""
SELECT id, target, y_true, {r('CASE WHEN p1 = p0 THEN g0 ELSE g0 + (g1 - g0) * (p - p0) / (p1 - p0) END')} AS predicted_probability FROM near""")
def _(t):
    return md.stack_predictions([md.apply_isotonic(test, md.fit_isotonic(validation)).select("id", "target", "y_true", "predicted_probability")
                                 for _, validation, test in by_target(t)])


METHODS = f"""
SELECT target, 'uncalibrated' AS split, y_true, predicted_probability FROM predictions WHERE split = 'test' UNION ALL
SELECT target, 'sigmoid', y_true, {SIGMOID} FROM predictions JOIN fitted USING (target) WHERE split = 'test' UNION ALL
SELECT target, 'isotonic', y_true, CASE WHEN p1 = p0 THEN g0 ELSE g0 + (g1 - g0) * (p - p0) / (p1 - p0) END FROM near"""


@query("m18_calibration_metrics", NEWTON + "".join(f",\n{name} AS ({sql})" for name, sql in {
    **ISOTONIC, "methods": METHODS, "h": RANKING.replace("FROM predictions", "FROM methods"), "k": RUNNING, "e": BINS,
    "bins": BINNED.replace("FROM predictions", "FROM methods"), "ece": "SELECT target, split, sum(n * abs(p - y)) / sum(n) AS ece FROM bins GROUP BY 1, 2"}.items()) + f"""
SELECT k.target, k.split AS method, {r('sum(pos * (below + (n - pos) / 2)) / (max(pp) * max(nn))')} AS roc_auc, {r('sum(pos / pp * (tp / seen))')} AS pr_auc,
  {r('sum(p * p * (n - pos) + (1 - p) * (1 - p) * pos) / sum(n)')} AS brier_score, CAST(sum(n) AS BIGINT) AS n, CAST(max(pp) AS BIGINT) AS positives,
  {r('max(ece)')} AS ece_10bin FROM k JOIN ece ON k.split = ece.split AND k.target = ece.target GROUP BY 1, 2""")
def _(t):
    artifacts, parts = platt_artifacts(t), []
    for _, validation, test in by_target(t):
        methods = {"uncalibrated": test, "sigmoid": md.apply_platt(test, artifacts), "isotonic": md.apply_isotonic(test, md.fit_isotonic(validation))}
        parts += [p.select("target", F.lit(name).alias("method"), "id", "y_true", "predicted_probability") for name, p in methods.items()]
    return md.calibration_metrics(md.stack_predictions(parts), ["target", "method"])


@query("m19_calibration_error", with_tables("predictions", e=BINS, b=BINNED) + f"""
SELECT target, split, {r('sum(n * abs(p - y)) / sum(n)')} AS ece_10bin FROM b GROUP BY 1, 2""")
def _(t):
    return md.calibration_error(derived(t, "predictions"), GROUP)


@query("m20_calibration_bins", with_tables("predictions", e=BINS, z="SELECT * REPLACE (predicted_probability * 0.8e0 AS predicted_probability) FROM predictions", b=BINNED.replace("FROM predictions", "FROM z")) + f"""
SELECT g.target, g.split, e.bin, e.lo AS lower_probability, {r('e.hi')} AS upper_probability, COALESCE(n, 0) AS count, {r('p')} AS mean_predicted_probability,
  {r('y')} AS observed_positive_rate, {r('abs(p - y)')} AS absolute_calibration_gap
FROM (SELECT DISTINCT target, split FROM z) g CROSS JOIN e LEFT JOIN b ON g.target = b.target AND g.split = b.split AND e.bin = b.bin""".replace("e.lo AS", f"{r('e.lo')} AS"))
def _(t):
    # Scores are shrunk, so that empty bins occur.
    return md.calibration_bins(derived(t, "predictions").withColumn("predicted_probability", F.col("predicted_probability") * 0.8), GROUP)


@query("m21_forward_labels", with_tables("snapshots") + "SELECT snapshot_id, delay_next_30d, delay_next_60d, delay_next_90d FROM snapshots")
def _(t):
    bare = derived(t, "snapshots").drop(*q.TARGETS, "first_delay_day")
    return md.forward_labels(bare, derived(t, "outcomes")).select("snapshot_id", *q.TARGETS)


@query("m22_project_outcomes", with_tables("snapshots", g="""
SELECT project_id, count(*) AS n, min(project_start_date) AS lo, max(snapshot_date) AS hi, arg_max(current_stage, (snapshot_date, snapshot_id)) AS st,
  max(first_delay_day) AS d, max(days_since_project_start) AS last, sum(delay_next_30d) AS a, sum(delay_next_60d) AS b, sum(delay_next_90d) AS c
FROM snapshots GROUP BY project_id""") + f"""
SELECT project_id, n AS total_snapshots, {iso('lo')} AS observation_start_date, {iso('hi')} AS observation_end_date, st AS final_stage,
  COALESCE(d <= last, FALSE)::INT AS delayed, CASE WHEN d <= last THEN last - d ELSE 0 END AS delay_days, {r('CASE WHEN d <= last THEN d END')} AS first_delay_day,
  CAST(a AS BIGINT) AS delay_30_event_count, CAST(b AS BIGINT) AS delay_60_event_count, CAST(c AS BIGINT) AS delay_90_event_count FROM g""", nullable=("first_delay_day",))
def _(t):
    return md.project_outcomes(derived(t, "snapshots"))
