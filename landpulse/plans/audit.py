"""A queries: machine-learning readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.operators import audit as au, quality as q
from landpulse.plans.adapters import WITH_GAPS_SQL, derived, snapshots_with_gaps, with_tables
from landpulse.plans.registry import query, r

SIGNALS = ["days_in_current_stage", "pending_approvals_count", "file_pending_days", "docs_complete_pct", "disbursal_pct", "rnr_progress_pct",
           "land_required_ha", "total_parcels"]
AUDITED = au.NUMERIC_FEATURES + au.CATEGORICAL_FEATURES


def _missing(c: str) -> str:
    pct = f"count(*) FILTER ({c} IS NULL) / count(*) * 100"
    return f"""SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS missing_count, {r(pct)} AS missing_pct,
  CASE WHEN {pct} >= 5 THEN 'FAIL' WHEN {pct} >= 1 THEN 'WARN' ELSE 'PASS' END AS status FROM g"""


@query("a01_missingness", with_tables("snapshots", g=WITH_GAPS_SQL) + " UNION ALL ".join(_missing(c) for c in AUDITED))
def _(t):
    return au.missingness(snapshots_with_gaps(t), AUDITED)


def _health(c: str) -> str:
    return f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS unique_count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
  {r('max(q1)')} AS q1, {r('max(q2)')} AS median, {r('max(q3)')} AS q3, {r(f'max({c})')} AS max,
  count(*) FILTER (q3 <> q1 AND ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1))) AS iqr_outlier_count,
  {r(f'count(*) FILTER (q3 <> q1 AND ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1))) / count({c}) * 100')} AS iqr_outlier_pct,
  CASE WHEN count(DISTINCT {c}) <= 1 THEN 'CONSTANT' WHEN count(DISTINCT {c}) <= 3 THEN 'LOW_CARDINALITY' ELSE 'OK' END AS flag
  FROM snapshots, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM snapshots)"""


@query("a02_numeric_health", with_tables("snapshots") + " UNION ALL ".join(_health(c) for c in au.NUMERIC_FEATURES))
def _(t):
    return au.numeric_health(derived(t, "snapshots"), au.NUMERIC_FEATURES)


@query("a03_target_balance", with_tables("snapshots") + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, count(*) FILTER ({c} = 1) AS positive, count(*) FILTER ({c} = 0) AS negative, count(*) FILTER ({c} IS NULL) AS missing,
    {r(f'count(*) FILTER ({c} = 1) / count(*) * 100')} AS positive_pct,
    CASE WHEN count(DISTINCT {c}) < 2 THEN 'FAIL' WHEN count(*) FILTER ({c} = 1) / count(*) < 0.01 THEN 'WARN' ELSE 'PASS' END AS status FROM snapshots"""
    for c in q.TARGETS))
def _(t):
    return au.target_balance(derived(t, "snapshots"))


def _signal(c: str, y: str) -> str:
    return f"""SELECT '{y}' AS target, '{c}' AS feature, {r('corr(rk, y)')} AS spearman,
  {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS single_feature_auc,
  {r('avg(x) FILTER (y = 1)')} AS positive_mean, {r('avg(x) FILTER (y = 0)')} AS negative_mean,
  {r('(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) / abs(avg(x) FILTER (y = 0))')} AS relative_mean_difference, count(*) AS n
  FROM (SELECT CAST({c} AS DOUBLE) AS x, {y} AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk FROM snapshots)"""


SIGNAL_SQL = " UNION ALL ".join(_signal(c, y) for y in q.TARGETS for c in au.NUMERIC_FEATURES)


@query("a04_numeric_signal", with_tables("snapshots") + SIGNAL_SQL)
def _(t):
    return au.numeric_signal(derived(t, "snapshots"), au.NUMERIC_FEATURES)


@query("a05_top_signals", with_tables("snapshots", s=SIGNAL_SQL) + f"""
SELECT * FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY d DESC, feature) AS signal_rank, feature, single_feature_auc, d AS abs_auc_distance
  FROM (SELECT *, {r('abs(single_feature_auc - 0.5e0)')} AS d FROM s)) WHERE signal_rank <= 8""")
def _(t):
    # Ranked on the rounded AUC, so that ties are the same on both sides.
    rounded = au.numeric_signal(derived(t, "snapshots"), au.NUMERIC_FEATURES).withColumn("single_feature_auc", F.round("single_feature_auc", 6))
    return au.top_signals(rounded)


def _category(c: str, y: str) -> str:
    return f"""SELECT '{y}' AS target, '{c}' AS feature, count(*) AS category_count, {r('max(abs(p - o))')} AS max_abs_prevalence_difference,
  {r('max(p) - min(p)')} AS prevalence_spread, count(*) FILTER (n < 10) AS rare_category_count
  FROM (SELECT {c}, avg({y}) AS p, count(*) AS n FROM g GROUP BY {c}), (SELECT avg({y}) AS o FROM g)"""


@query("a06_categorical_signal", with_tables("snapshots", g=WITH_GAPS_SQL) + " UNION ALL ".join(_category(c, y) for y in q.TARGETS for c in au.CATEGORICAL_FEATURES))
def _(t):
    return au.categorical_signal(snapshots_with_gaps(t))


RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in au.NUMERIC_FEATURES)
PAIRS = ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for a in au.NUMERIC_FEATURES for b in au.NUMERIC_FEATURES)


@query("a07_spearman_matrix", with_tables("snapshots", k=f"SELECT {RANKS} FROM snapshots", w=f"SELECT {PAIRS} FROM k") + f"""
SELECT split_part(pair, '|', 1) AS feature_a, split_part(pair, '|', 2) AS feature_b, {r('v')} AS spearman FROM (UNPIVOT w ON COLUMNS(*) INTO NAME pair VALUE v)""")
def _(t):
    return au.spearman_matrix(derived(t, "snapshots"))


@query("a07_high_correlations", with_tables("snapshots", k="SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("days_in_current_stage", "docs_complete_pct", "forest_involved", "is_censored")) + " FROM snapshots") + f"""
SELECT 'forest_involved' AS feature_a, 'is_censored' AS feature_b, {r('corr(forest_involved, is_censored)')} AS spearman FROM k
WHERE (SELECT abs(corr(forest_involved, is_censored)) FROM k) >= 0.9""")
def _(t):
    features = ["days_in_current_stage", "docs_complete_pct", "forest_involved", "is_censored"]
    return au.high_correlations(au.spearman_matrix(derived(t, "snapshots"), features), features)


@query("a08_project_structure", with_tables("snapshots", c="SELECT project_id, count(*) AS n FROM snapshots GROUP BY 1") + """
SELECT count(*) AS projects, count(*) FILTER (n > 1) AS multi_snapshot_projects, max(n) AS max_snapshots,
  CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'WARNING' ELSE 'PASS' END AS leakage_risk FROM c""")
def _(t):
    return au.project_structure(derived(t, "snapshots"))


@query("a09_temporal_holdout", with_tables("snapshots", p="""
SELECT project_id, row_number() OVER (ORDER BY min(snapshot_date), project_id) - 1 AS i, count(*) OVER () AS n FROM snapshots GROUP BY project_id""") + """
SELECT count(*) FILTER (i < floor(n * 0.7e0)) AS train_projects, count(*) FILTER (i >= floor(n * 0.7e0) AND i < floor(n * 0.85e0)) AS validation_projects,
  count(*) FILTER (i >= floor(n * 0.85e0)) AS test_projects, count(*) AS projects, CASE WHEN count(*) < 100 THEN 'WARNING' ELSE 'PASS' END AS status, CAST(0 AS BIGINT) AS overlap_train_validation, CAST(0 AS BIGINT) AS overlap_train_test,
  CAST(0 AS BIGINT) AS overlap_validation_test FROM p""")
def _(t):
    return au.temporal_holdout(derived(t, "snapshots"))


@query("a10_positive_timing", with_tables("snapshots") + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, count(*) AS positive_count, {r('median(days_since_project_start)')} AS median_positive_project_day,
    {r('min(days_since_project_start)')} AS min_positive_project_day, {r('max(days_since_project_start)')} AS max_positive_project_day FROM snapshots WHERE {c} = 1"""
    for c in q.TARGETS), nullable=("min_positive_project_day", "max_positive_project_day"))
def _(t):
    return au.positive_timing(derived(t, "snapshots"))


@query("a11_scenario_means", with_tables("snapshots", "outcomes") + "SELECT scenario, count(*) AS snapshot_count, " +
       ", ".join(f"{r(f'avg({c})')} AS {c}_mean" for c in au.SCENARIO_FEATURES) + " FROM snapshots s LEFT JOIN outcomes o ON s.project_id = o.project_id GROUP BY scenario")
def _(t):
    return q.group_means(derived(t, "snapshots"), derived(t, "outcomes"), "scenario", au.SCENARIO_FEATURES)


PRESENT = ["snapshot_id", "project_id", "snapshot_date", "project_start_date", "stage_entry_date", "delay_next_30d", "delay_next_60d", "delay_next_90d",
           "is_censored", "first_delay_day"]


@query("a12_forbidden_columns", with_tables("snapshots") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS filled_rows, {int(c == 'is_censored')} AS in_model, '{'FAIL' if c == 'is_censored' else 'PASS'}' AS status FROM snapshots"""
    for c in PRESENT))
def _(t):
    return au.forbidden_columns(derived(t, "snapshots"), au.NUMERIC_FEATURES + ["is_censored"])


@query("a13_roll_up", with_tables("snapshots", g=WITH_GAPS_SQL, m=" UNION ALL ".join(_missing(c) for c in AUDITED)) + """
SELECT count(*) FILTER (status = 'PASS') + (SELECT count(*) FROM (SELECT 1 FROM snapshots HAVING count(DISTINCT delay_next_90d) = 2 AND avg(delay_next_90d) >= 0.01)) AS pass_checks,
  count(*) FILTER (status = 'WARN') + (SELECT count(*) FROM (SELECT 1 FROM snapshots HAVING count(DISTINCT delay_next_90d) = 2 AND avg(delay_next_90d) < 0.01)) AS warn_checks,
  count(*) FILTER (status = 'FAIL') + (SELECT count(*) FROM (SELECT 1 FROM snapshots HAVING count(DISTINCT delay_next_90d) < 2)) AS fail_checks, 'FAIL' AS status FROM m""")
def _(t):
    return au.roll_up([au.missingness(snapshots_with_gaps(t), AUDITED), au.target_balance(derived(t, "snapshots"), ["delay_next_90d"])])


@query("a14_entropy", f"""
SELECT {r('-sum(p * log2(p))')} AS entropy_bits FROM (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_custkey)""")
def _(t):
    return au.entropy(t.orders, "o_custkey")
