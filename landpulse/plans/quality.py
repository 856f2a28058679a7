"""Q queries: data-quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.operators import features as ft, quality as q, timeline as tl
from landpulse.plans.adapters import derived, with_tables
from landpulse.plans.features import ASSEMBLED, PARTY, SURVEY
from landpulse.plans.registry import query, r
from landpulse.session import durable, scratch_folder
from landpulse.sources import sinks

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS_WITH_GAPS = """
SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"""


def _orders_with_gaps(t):
    return t.orders.select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


@query("q01_dataset_summary", f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT 'orders' AS dataset, count(*) AS rows, 3 AS columns, count(*) * 3 AS total_cells, count(*) FILTER (o_orderpriority IS NULL) AS missing_cells,
  {r('round_even(count(*) FILTER (o_orderpriority IS NULL) / (count(*) * 3) * 100, 4)')} AS missing_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS duplicate_rows FROM g""")
def _(t):
    return q.dataset_summary(_orders_with_gaps(t), "orders")


def _profile(column: str) -> str:
    kind = "bigint" if column == "o_custkey" else "string"
    return f"""SELECT 'orders' AS dataset, '{column}' AS "column", '{kind}' AS dtype, sum(n) AS rows, COALESCE(sum(n) FILTER (v IS NULL), 0) AS missing_count,
  {r('round_even(COALESCE(sum(n) FILTER (v IS NULL), 0) / sum(n) * 100, 4)')} AS missing_pct, count(v) AS unique_values,
  {r('round_even(sum(n) FILTER (v IS NOT NULL) / sum(n) * 100, 4)')} AS completeness_pct,
  {r('round_even(max(n) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL) * 100, 4)')} AS dominant_value_pct
  FROM (SELECT {column} AS v, count(*) AS n FROM g GROUP BY 1)"""


@query("q02_column_profile", f"WITH g AS ({ORDERS_WITH_GAPS}) SELECT * REPLACE (CAST(rows AS BIGINT) AS rows, CAST(missing_count AS BIGINT) AS missing_count) FROM ("
       + " UNION ALL ".join(_profile(c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")) + ")")
def _(t):
    return q.column_profile(_orders_with_gaps(t), "orders")


MASTER_SQL = with_tables("manifest", "surveys", "parties", "notifications", s=SURVEY, p=PARTY, a=ASSEMBLED, n="""
SELECT project_id, min(publish_date) FILTER (notification_type = '3a') AS a1, min(publish_date) FILTER (notification_type = '3A') AS a2
FROM notifications GROUP BY project_id""", ms="""
SELECT a.*, a1, a2, land_acquired_ha / NULLIF(land_to_acquire_ha, 0) * 100 AS completion,
  (contains(lower(project_name), 'test') OR contains(lower(project_number), 'test')) AS test FROM a LEFT JOIN n ON a.project_id = n.project_id""")


def _master(t):
    features = ft.project_features(derived(t, "manifest"), derived(t, "surveys"), derived(t, "parties"))
    return ft.project_master(features, tl.project_timeline(derived(t, "notifications")))


CHECK_VALUES = {
    "project_count": ("count(DISTINCT project_id)", None), "duplicate_project_ids": ("count(*) - count(DISTINCT project_id)", "WARNING"),
    "projects_with_3d_detail": ("count(*) FILTER (survey_count > 0)", None), "projects_without_3d_detail": ("count(*) FILTER (survey_count = 0)", None),
    "negative_acquisition_completion": ("count(*) FILTER (completion < 0)", "WARNING"),
    "acquisition_completion_above_100": ("count(*) FILTER (completion > 100)", "WARNING"),
    "3A_before_3a": ("count(*) FILTER (a2 < a1)", "WARNING"), "possible_test_projects": ("count(*) FILTER (test)", "WARNING"),
}


def _check_rows() -> str:
    parts = []
    for name, (value, bad) in CHECK_VALUES.items():
        status = f"CASE WHEN {value} = 0 THEN 'PASS' ELSE '{bad}' END" if bad else "'INFO'"
        text = q.PROJECT_CHECKS[name].replace("'", "''")
        parts.append(f"SELECT '{name}' AS \"check\", {value} AS value, {status} AS status, '{text}' AS description FROM ms")
    return " UNION ALL ".join(parts)


@query("q03_project_checks", MASTER_SQL + _check_rows())
def _(t):
    return q.project_checks(_master(t))


@query("q04_test_projects", with_tables("manifest") + """
SELECT project_id, project_name, project_number FROM manifest WHERE project_name ILIKE '%test%' OR project_number ILIKE '%test%'""")
def _(t):
    return q.detected_test_projects(derived(t, "manifest"))


@query("q05_feature_variation", with_tables("surveys") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'NO_VARIATION' ELSE 'LOW_VARIATION' END AS issue
    FROM surveys HAVING count(DISTINCT {c}) <= 2""" for c in ("land_type", "land_nature", "land_category", "area_hectares", "district")))
def _(t):
    return q.feature_variation(derived(t, "surveys").select("project_id", "land_type", "land_nature", "land_category", "area_hectares", "district"))


@query("q06_leakage_candidates", with_tables("outcomes") + """
SELECT 'delayed' AS "column", count(delayed) AS filled_rows FROM outcomes""")
def _(t):
    return q.leakage_candidates(derived(t, "outcomes"))


@query("q07_overall_readiness", MASTER_SQL + f"""
, c AS ({_check_rows()})
SELECT count(*) FILTER (status = 'WARNING') AS warning_checks, 1 - LEAST(1, (SELECT count(*) FROM ms) // 50) + 1 - LEAST(1, (SELECT count(*) FROM surveys) // 50) AS small_tables,
  CASE WHEN count(*) FILTER (status = 'WARNING') > 0 OR (SELECT count(*) FROM ms) < 50 THEN 'NOT_READY_FOR_PRODUCTION_ML' ELSE 'READY_FOR_NEXT_PIPELINE_STAGE' END AS overall_status
FROM c""")
def _(t):
    master = durable(_master(t))  # read by the checks and by the count, one row per project
    return q.overall_readiness(durable(q.project_checks(master)), master, derived(t, "surveys"))


@query("s08_quality_report", MASTER_SQL + f"""
, c AS ({_check_rows()}), sizes AS (SELECT 1 - LEAST(1, (SELECT count(*) FROM ms) // 50) + 1 - LEAST(1, (SELECT count(*) FROM surveys) // 50) AS n)
SELECT 'project master' AS dataset, count(*) FILTER (status = 'WARNING') AS warning_checks, max(n) AS small_tables,
  CASE WHEN count(*) FILTER (status = 'WARNING') + max(n) > 0 THEN 'NOT_READY_FOR_PRODUCTION_ML' ELSE 'READY_FOR_NEXT_PIPELINE_STAGE' END AS overall_status,
  string_agg("check", ',' ORDER BY "check") FILTER (status = 'WARNING') AS warned FROM c, sizes""")
def _(t):
    master = durable(_master(t))  # as in q07
    checks = durable(q.project_checks(master))  # eight rows, read twice
    path = f"{scratch_folder(t.spark)}/quality-report"
    sinks.write_json_report(q.quality_report("project master", checks, q.overall_readiness(checks, master, derived(t, "surveys"))), path)
    warning = "struct<check string, value bigint, status string, description string>"
    back = t.spark.read.schema(f"dataset string, warning_checks bigint, small_tables bigint, overall_status string, warnings array<{warning}>").json(path)
    return back.select("dataset", "warning_checks", "small_tables", "overall_status", F.array_join(F.col("warnings.check"), ",").alias("warned"))


@query("q08_bundle_checks", with_tables("manifest", "sanctions", "notifications") + """
SELECT 'project_manifest' AS dataset, count(*) AS rows, 0 AS missing_fields, CAST(0 AS BIGINT) AS unreadable_numbers, 'PASS' AS status FROM manifest UNION ALL
SELECT 'sanctions', count(*), 1, CAST(0 AS BIGINT), 'ERROR' FROM sanctions UNION ALL
SELECT 'notifications', count(*), 0, count(*), 'ERROR' FROM notifications""")
def _(t):
    tables = {"project_manifest": derived(t, "manifest"), "sanctions": derived(t, "sanctions"), "notifications": derived(t, "notifications")}
    required = {"project_manifest": ["project_id", "project_name"], "sanctions": ["project_id", "bank"], "notifications": ["notification_id"]}
    numeric = {"project_manifest": ["land_required_ha"], "sanctions": ["sanction_amount_rs"], "notifications": ["notification_number"]}
    return q.bundle_checks(tables, required, numeric)


@query("q09_sanction_totals", """
SELECT o_custkey AS project_id, count(*) AS sanction_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_rs,
  CASE WHEN o_custkey % 3 = 0 THEN 'WARN' ELSE 'PASS' END AS row_check, CASE WHEN o_custkey % 2 = 0 THEN 'WARN' ELSE 'PASS' END AS total_check
FROM orders GROUP BY o_custkey""")
def _(t):
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    k = F.col("project_id")
    expected = t.orders.groupBy(F.col("o_custkey").alias("project_id")).agg(F.count(F.lit(1)).alias("n"), money.alias("s")).select(
        "project_id", (F.col("n") + (k % 3 == 0).cast("int")).alias("expected_rows"), (F.col("s") + (k % 2 == 0).cast("int")).alias("expected_total_rs"))
    return q.sanction_totals(derived(t, "sanctions"), expected)


@query("q10_notification_checks", with_tables("notifications", x="""
SELECT project_id, notification_type, notification_id, publish_date, status FROM notifications UNION ALL
SELECT project_id, notification_type, notification_id, NULL, ' ' FROM notifications WHERE status = '1-URGENT'""") + """
SELECT 'notifications' AS "check", count(*) AS value, 'INFO' AS status FROM x UNION ALL
SELECT 'duplicate_keys', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END FROM (SELECT notification_id FROM x GROUP BY project_id, notification_type, notification_id HAVING count(*) > 1) UNION ALL
SELECT 'blank_publish_dates', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END FROM x WHERE publish_date IS NULL UNION ALL
SELECT 'blank_statuses', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END FROM x WHERE trim(status) = '' UNION ALL
SELECT 'missing_ids', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT notification_id FROM x)) UNION ALL
SELECT 'unexpected_ids', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END FROM (SELECT DISTINCT notification_id FROM x WHERE notification_id NOT IN (SELECT l_orderkey FROM lineitem))""")
def _(t):
    notes = derived(t, "notifications").drop("notification_number")
    again = notes.filter("status = '1-URGENT'").withColumns({"publish_date": F.lit(None).cast("date"), "status": F.lit(" ")})
    return q.notification_checks(notes.unionAll(again), t.lineitem.select(F.col("l_orderkey").alias("notification_id")))


@query("q10_type_counts", with_tables("notifications", "event_notifications", a="SELECT notification_type AS v, count(*) AS n FROM notifications GROUP BY 1",
                                       b="SELECT notification_type AS v, count(*) AS n FROM event_notifications GROUP BY 1") + """
SELECT COALESCE(a.v, b.v) AS value, COALESCE(a.n, 0) AS actual_count, COALESCE(b.n, 0) AS expected_count,
  CASE WHEN COALESCE(a.n, 0) = COALESCE(b.n, 0) THEN 'PASS' ELSE 'ERROR' END AS status FROM a FULL JOIN b ON a.v = b.v""")
def _(t):
    expected = derived(t, "event_notifications").groupBy(F.col("notification_type").alias("value")).agg(F.count(F.lit(1)).alias("expected_count"))
    return q.type_counts(derived(t, "notifications"), "notification_type", expected)


@query("q11_survey_checks", with_tables("surveys", "parties", s="SELECT notification_id AS i, count(*) AS n, sum(area_hectares) AS a FROM surveys GROUP BY 1", p="""
SELECT notification_id AS i, count(*) AS n, count(*) FILTER (party_area_hectares IS NULL) AS m,
  count(*) FILTER (party_area_hectares IS NULL AND party_area_raw <> 'Hectares') AS u, sum(party_area_hectares) AS a FROM parties GROUP BY 1""") + f"""
SELECT s.i AS notification_id, s.n AS surveys, {r('s.a')} AS area_ha, p.n AS parties, m AS missing_party_areas, u AS unexpected_raw_values,
  {r('p.a')} AS party_area_ha, CASE WHEN s.i % 4 = 0 THEN 'ERROR' ELSE 'PASS' END AS count_check, CASE WHEN s.i % 3 = 0 THEN 'WARN' ELSE 'PASS' END AS area_check,
  CASE WHEN u = 0 THEN 'PASS' ELSE 'WARN' END AS raw_check FROM s JOIN p ON s.i = p.i""")
def _(t):
    k = F.col("notification_id")
    surveys = derived(t, "surveys")
    expected = surveys.groupBy("notification_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area_hectares").alias("a")).select(
        "notification_id", (F.col("n") + (k % 4 == 0).cast("int")).alias("expected_surveys"), (F.col("a") + (k % 3 == 0).cast("int")).alias("expected_area"))
    return q.survey_checks(surveys, derived(t, "parties"), expected)


@query("q12_referential_checks", """
SELECT 'lineitem' AS dataset, count(DISTINCT l_orderkey) AS orphan_ids, count(*) AS orphan_rows, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END AS status
FROM lineitem WHERE l_linenumber = 3 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'orders', 0, 0, 'PASS'""")
def _(t):
    # Every third line names an order that does not exist.
    order = F.when(F.col("l_linenumber") == 3, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    tables = {"lineitem": t.lineitem.select(order.alias("notification_id")), "orders": t.orders.select(F.col("o_orderkey").alias("notification_id"))}
    return q.referential_checks(tables, t.orders.select(F.col("o_orderkey").alias("notification_id")))


SHIFTED = """SELECT * REPLACE (docs_complete_pct + 5 AS docs_complete_pct, CASE WHEN court_cases_count > 0 THEN court_cases_count END AS court_cases_count,
  grievances_30d - 1 AS grievances_30d) FROM snapshots"""


@query("q13_range_checks", with_tables("snapshots", x=SHIFTED) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL OR {c} < {lo}{'' if hi == float('inf') else f' OR {c} > {hi}'}) AS invalid,
    CASE WHEN count(*) FILTER ({c} IS NULL OR {c} < {lo}{'' if hi == float('inf') else f' OR {c} > {hi}'}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM x"""
    for c, (lo, hi) in q.RANGE_RULES.items()))
def _(t):
    shifted = derived(t, "snapshots").withColumns({
        "docs_complete_pct": F.col("docs_complete_pct") + 5, "court_cases_count": F.when(F.col("court_cases_count") > 0, F.col("court_cases_count")),
        "grievances_30d": F.col("grievances_30d") - 1})
    return q.range_checks(shifted)


@query("q14_cadence_checks", with_tables("snapshots", g="""
SELECT project_id, date_diff('day', lag(snapshot_date) OVER (PARTITION BY project_id ORDER BY snapshot_date), snapshot_date) AS gap FROM snapshots""", c="""
SELECT project_id, count(*) AS n, count(*) FILTER (gap = 0) AS same, count(*) FILTER (gap <> 30) AS odd FROM g GROUP BY project_id""") + """
SELECT 'unordered_projects' AS "check", count(*) FILTER (same > 0) AS value, CASE WHEN count(*) FILTER (same > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c UNION ALL
SELECT 'interval_issues', CAST(sum(odd) AS BIGINT), CASE WHEN sum(odd) = 0 THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL
SELECT 'projects_outside_snapshot_range', count(*) FILTER (n < 8 OR n > 15), CASE WHEN count(*) FILTER (n < 8 OR n > 15) = 0 THEN 'PASS' ELSE 'FAIL' END FROM c""")
def _(t):
    return q.cadence_checks(derived(t, "snapshots"))


@query("q15_label_monotonicity", with_tables("snapshots") + """
SELECT '30d_without_60d' AS "check", count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM snapshots WHERE delay_next_30d = 1 AND delay_next_60d * (court_cases_count % 2) = 0 UNION ALL
SELECT '60d_without_90d', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM snapshots WHERE delay_next_60d * (court_cases_count % 2) = 1 AND delay_next_90d = 0""")
def _(t):
    broken = derived(t, "snapshots").withColumn("delay_next_60d", F.col("delay_next_60d") * (F.col("court_cases_count") % 2))
    return q.label_monotonicity(broken)


@query("q16_label_distribution", with_tables("snapshots") + " UNION ALL ".join(
    f"SELECT '{c}' AS target, CAST(sum({c}) AS BIGINT) AS positive, CAST(count(*) - sum({c}) AS BIGINT) AS negative, {r(f'sum({c}) / count(*) * 100')} AS positive_pct FROM snapshots"
    for c in q.TARGETS))
def _(t):
    return q.label_distribution(derived(t, "snapshots"))


MEANS = ["pending_approvals_count", "court_cases_count", "docs_complete_pct", "rnr_progress_pct"]
RULES = [
    ("ADMIN approvals > NORMAL", "pending_approvals_count", "ADMINISTRATIVE_BOTTLENECK", ">", "NORMAL"),
    ("LEGAL court cases > NORMAL", "court_cases_count", "LEGAL_DELAY", ">", "NORMAL"),
    ("DOCUMENTATION docs < NORMAL", "docs_complete_pct", "DOCUMENTATION_DELAY", "<", "NORMAL"),
    ("RNR progress < NORMAL", "rnr_progress_pct", "RNR_DELAY", "<", "NORMAL"),
]
MEANS_SQL = with_tables("snapshots", "outcomes", m="SELECT scenario, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}" for c in MEANS) +
                        " FROM snapshots s LEFT JOIN outcomes o ON s.project_id = o.project_id GROUP BY scenario")


@query("q17_group_means", MEANS_SQL + "SELECT scenario, n AS snapshot_count, " + ", ".join(f"{r(c)} AS {c}_mean" for c in MEANS) + " FROM m")
def _(t):
    return q.group_means(derived(t, "snapshots"), derived(t, "outcomes"), "scenario", MEANS)


@query("q17_group_sanity", MEANS_SQL + " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", CASE WHEN (SELECT {f} FROM m WHERE scenario = '{a}') {sign} (SELECT {f} FROM m WHERE scenario = '{b}') THEN 'PASS' ELSE 'FAIL' END AS status"
    for name, f, a, sign, b in RULES))
def _(t):
    means = q.group_means(derived(t, "snapshots"), derived(t, "outcomes"), "scenario", MEANS)
    return q.group_sanity(means, "scenario", RULES)


@query("q18_outcome_consistency", with_tables("outcomes") + """
SELECT 'delayed_without_day' AS "check", count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM outcomes WHERE delayed = 1 AND first_delay_day IS NULL UNION ALL
SELECT 'not_delayed_with_day', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM outcomes WHERE delayed = 0 AND first_delay_day IS NOT NULL""")
def _(t):
    return q.outcome_consistency(derived(t, "outcomes"))


@query("q19_duplicate_ids", """
SELECT 'customer' AS dataset, CAST(0 AS BIGINT) + count(*) - count(DISTINCT c_custkey) AS duplicates, CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 'PASS' ELSE 'FAIL' END AS status FROM customer UNION ALL
SELECT 'orders', count(*) - count(DISTINCT o_orderkey), CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END FROM orders UNION ALL
SELECT 'lineitem', count(*) - count(DISTINCT l_orderkey), CASE WHEN count(*) = count(DISTINCT l_orderkey) THEN 'PASS' ELSE 'FAIL' END FROM lineitem""")
def _(t):
    return q.duplicate_ids({"customer": (t.customer, "c_custkey"), "orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey")})


@query("q20_integrity_checks", with_tables("snapshots", "projects", "outcomes", x="SELECT * REPLACE (snapshot_date - 700 AS snapshot_date) FROM snapshots", renamed="""
SELECT CASE WHEN state = 'CHINA' THEN project_id || '-old' ELSE project_id END AS project_id FROM projects""", v="""
SELECT 'snapshot_before_start' AS c, count(*) FILTER (snapshot_date < project_start_date) AS n FROM x UNION ALL
SELECT 'days_since_start_mismatch', count(*) FILTER (date_diff('day', project_start_date, snapshot_date) <> days_since_project_start) FROM x UNION ALL
SELECT 'days_in_stage_mismatch', count(*) FILTER (date_diff('day', stage_entry_date, snapshot_date) <> days_in_current_stage) FROM x UNION ALL
SELECT 'forbidden_cells', count(*) FROM x UNION ALL
SELECT 'project_id_mismatch', count(*) FROM (SELECT project_id FROM renamed UNION SELECT project_id FROM x UNION SELECT project_id FROM outcomes) u
  WHERE project_id NOT IN (SELECT project_id FROM renamed) OR project_id NOT IN (SELECT project_id FROM x) OR project_id NOT IN (SELECT project_id FROM outcomes) UNION ALL
SELECT 'duplicate_snapshot_ids', count(*) - count(DISTINCT snapshot_id) FROM x""") + """
SELECT c AS "check", n AS value, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def _(t):
    moved = derived(t, "snapshots").withColumn("snapshot_date", F.date_sub("snapshot_date", 700))
    renamed = F.when(F.col("state") == "CHINA", F.concat("project_id", F.lit("-old"))).otherwise(F.col("project_id"))
    return q.integrity_checks(derived(t, "projects").withColumn("project_id", renamed), moved, derived(t, "outcomes"), ["first_delay_day", "scenario"])
