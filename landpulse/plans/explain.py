"""X queries: explanation analytics over the contributions of a linear scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.operators import explain as xp
from landpulse.plans.adapters import derived, with_tables
from landpulse.plans.registry import query, r

WEIGHTS = {
    "delay_next_30d": {"file_pending_days": 0.02, "docs_complete_pct": -0.03, "rnr_progress_pct": -0.01, "court_cases_count": 0.2},
    "delay_next_60d": {"file_pending_days": 0.03, "docs_complete_pct": -0.02, "rnr_progress_pct": -0.02, "court_cases_count": 0.3},
    "delay_next_90d": {"file_pending_days": 0.04, "docs_complete_pct": -0.05, "rnr_progress_pct": -0.03, "court_cases_count": 0.4,
                       "current_stage_3a": 0.3, "current_stage_3A": 0.1, "current_stage_3D": -0.4},
}
STAGE_FLAGS = {"current_stage_3a": "3a", "current_stage_3A": "3A", "current_stage_3D": "3D"}
KEYS = ["project_id", "snapshot_id", "current_stage"]

def _x(feature: str) -> str:
    return f"(current_stage = '{STAGE_FLAGS[feature]}')::INT" if feature in STAGE_FLAGS else feature


LONG = " UNION ALL ".join(
    f"""SELECT project_id, snapshot_id, current_stage, '{target}' AS target, '{f}' AS feature, CAST({_x(f)} AS DOUBLE) AS x,
    {w}e0 * ({_x(f)} - (SELECT avg({_x(f)}) FROM snapshots)) AS c FROM snapshots""" for target, ws in WEIGHTS.items() for f, w in ws.items())
DISPLAY = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in xp.DISPLAY_NAMES.items()) + " ELSE replace(feature, '_', ' ') END"
DIRECTION = "CASE WHEN c > 0 THEN 'risk_increasing' WHEN c < 0 THEN 'risk_reducing' ELSE 'neutral' END"


def explanations(t):
    return xp.local_explanations(derived(t, "snapshots"), WEIGHTS, KEYS, xp.stage_flags())


@query("x01_local_explanations", with_tables("snapshots", l=LONG) + f"""
SELECT project_id, snapshot_id, current_stage, target, feature, {r('x')} AS feature_value, {r('c')} AS contribution, {DISPLAY} AS display_feature,
  {DIRECTION} AS direction, {r('abs(c)')} AS absolute_contribution FROM l""")
def _(t):
    return explanations(t)


@query("x02_top_drivers", with_tables("snapshots", l=LONG, k="""
SELECT *, row_number() OVER (PARTITION BY snapshot_id, target, c > 0 ORDER BY abs(c) DESC, feature) AS i FROM l WHERE c <> 0""") + f"""
SELECT project_id, snapshot_id, target, i AS driver_rank, feature, {r('x')} AS feature_value, {r('c')} AS contribution, {DIRECTION} AS direction,
  {DISPLAY} AS display_feature FROM k WHERE i <= 5""")
def _(t):
    return xp.top_drivers(derived(t, "snapshots"), WEIGHTS, ["project_id", "snapshot_id"], 5, xp.stage_flags())


IMPORTANCE = """
SELECT *, row_number() OVER (PARTITION BY target ORDER BY a DESC, feature) AS i, a / sum(a) OVER (PARTITION BY target) * 100 AS share
FROM (SELECT target, feature, avg(abs(c)) AS a, avg(c) AS s FROM l GROUP BY 1, 2)"""


@query("x03_global_importance", with_tables("snapshots", l=LONG, g=IMPORTANCE) + f"""
SELECT target, i AS rank, feature, {DISPLAY} AS display_feature, {r('a')} AS mean_abs, {r('s')} AS mean_signed, {r('share')} AS normalized_importance_pct FROM g""")
def _(t):
    return xp.global_importance(explanations(t))


DECILES = {
    "e": "SELECT target, feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM l GROUP BY 1, 2",
    "b": "SELECT l.*, len(list_filter(edges[2:], lambda q: q < x)) AS bin FROM l JOIN e ON l.target = e.target AND l.feature = e.feature",
}
# The trend rests on a non-linear contribution, so that it is not the same for every feature.
CURVED = "SELECT * REPLACE (CASE WHEN feature = 'rnr_progress_pct' THEN c * c ELSE c END AS c) FROM l0"


def curved(t):
    bent = F.when(F.col("feature") == "rnr_progress_pct", F.col("contribution") * F.col("contribution")).otherwise(F.col("contribution"))
    return explanations(t).withColumn("contribution", bent)


@query("x04_dependence_trend", with_tables("snapshots", l0=LONG, l=CURVED, **DECILES, m="""
SELECT target, feature, bin, avg(c) AS m FROM b GROUP BY ALL""", d="""
SELECT target, feature, m - lag(m) OVER (PARTITION BY target, feature ORDER BY bin) AS step FROM m""", s="""
SELECT target, feature, count(*) FILTER (step > 0) / NULLIF(count(step), 0) AS up, count(*) FILTER (step < 0) / NULLIF(count(step), 0) AS down FROM d GROUP BY 1, 2""", v="""
SELECT target, feature, count(*) AS n, count(DISTINCT x) AS k, min(x) AS x0, max(x) AS x1, avg(c) AS c, min(c) AS c0, max(c) AS c1 FROM l GROUP BY 1, 2""") + f"""
SELECT v.target, v.feature, n, CASE WHEN n < 30 THEN 'insufficient_data' WHEN k < 4 THEN 'low_variation' WHEN up IS NULL THEN 'insufficient_data'
  WHEN up >= 0.7e0 THEN 'mostly_increasing_risk' WHEN down >= 0.7e0 THEN 'mostly_decreasing_risk' ELSE 'nonlinear_or_mixed' END AS trend,
  {r('x0')} AS min_value, {r('x1')} AS max_value, {r('c')} AS mean_contribution, {r('c0')} AS min_contribution, {r('c1')} AS max_contribution
FROM v JOIN s ON v.target = s.target AND v.feature = s.feature""")
def _(t):
    return xp.dependence_trend(curved(t))


@query("x05_decile_table", with_tables("snapshots", l0=LONG, l=CURVED, **DECILES) + f"""
SELECT target, feature, bin + 1 AS decile, count(*) AS n, {r('min(x)')} AS value_min, {r('max(x)')} AS value_max, {r('avg(c)')} AS mean_contribution,
  {r('median(x)')} AS value_median, {r('median(c)')} AS median_contribution FROM b WHERE feature NOT LIKE 'current_stage%' GROUP BY ALL""")
def _(t):
    return xp.decile_table(curved(t))


@query("x06_stage_contributions", with_tables("snapshots", l=LONG, p="""
SELECT target, snapshot_id, current_stage, sum(c) AS c FROM l WHERE feature LIKE 'current_stage%' GROUP BY ALL""") + f"""
SELECT target, current_stage, count(*) AS n, {r('avg(c)')} AS mean_contribution, {r('min(c)')} AS min_contribution, {r('max(c)')} AS max_contribution,
  {r('median(c)')} AS median_contribution FROM p GROUP BY 1, 2""")
def _(t):
    return xp.stage_contributions(xp.contributions(derived(t, "snapshots"), WEIGHTS, xp.stage_flags()), list(WEIGHTS))


@query("x07_matrix_checks", with_tables("snapshots", "predictions", l=LONG, v="""
SELECT 'non_finite_contributions' AS c, count(*) FILTER (feature = 'court_cases_count' AND x = 0) AS n FROM l UNION ALL
SELECT 'forbidden_features', count(*) FILTER (feature = 'is_censored') FROM l UNION ALL
SELECT 'wrong_length_rows', count(*) FROM (SELECT snapshot_id FROM l GROUP BY target, snapshot_id HAVING count(*) <> 4) UNION ALL
SELECT 'probabilities_outside_unit_interval', count(*) FILTER (predicted_probability + 0.2 > 1) FROM predictions""") + """
SELECT c AS "check", n AS value, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def _(t):
    broken = F.when((F.col("feature") == "court_cases_count") & (F.col("feature_value") == 0), F.lit(float("nan"))).otherwise(F.col("contribution"))
    shifted = derived(t, "predictions").withColumn("predicted_probability", F.col("predicted_probability") + 0.2)
    return xp.matrix_checks(explanations(t).withColumn("contribution", broken), shifted, 4)
