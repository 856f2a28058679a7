"""N queries: notification timelines, snapshots, cycles, transitions, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.operators import timeline as tl
from landpulse.plans.adapters import derived, with_tables
from landpulse.plans.registry import iso, query, r
from landpulse.session import durable, scratch_folder
from landpulse.sources import sinks
from landpulse.sources.registry import legal_policy, read_policy, stage_policy

RANK = "CASE {} WHEN '3a' THEN 1 WHEN '3A' THEN 2 WHEN '3D' THEN 3 ELSE 0 END"
W = "OVER (PARTITION BY project_id ORDER BY publish_date, notification_id)"
SO_FAR = "OVER (PARTITION BY project_id ORDER BY publish_date, notification_id ROWS UNBOUNDED PRECEDING)"
EARLIER = "OVER (PARTITION BY project_id ORDER BY publish_date, notification_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def days(start: str, end: str) -> str:
    return f"date_diff('day', {start}, {end})"


@query("n01_normalise_notifications", with_tables("notifications") + f"""
SELECT project_id, notification_id, notification_type, {iso('publish_date')} AS publish_date,
       {r(f"NULLIF({RANK.format('notification_type')}, 0)")} AS stage_order FROM notifications""", nullable=("stage_order",))
def _(t):
    texts = [F.col(c).cast("string").alias(c) for c in ("project_id", "notification_id", "publish_date")]
    raw = derived(t, "notifications").select(*texts, F.concat(F.lit(" "), "notification_type", F.lit(" ")).alias("notification_type"))
    return tl.normalise_notifications(raw)


@query("n02_project_timeline", with_tables("notifications", f="""
SELECT project_id, min(publish_date) AS lo, max(publish_date) AS hi, count(*) AS n,
  arg_max(notification_type, (publish_date, notification_id)) AS st, arg_max(notification_id, (publish_date, notification_id)) AS id,
  count(*) FILTER (notification_type = '3a') AS n1, count(*) FILTER (notification_type = '3A') AS n2, count(*) FILTER (notification_type = '3D') AS n3,
  min(publish_date) FILTER (notification_type = '3a') AS a1, max(publish_date) FILTER (notification_type = '3a') AS z1,
  min(publish_date) FILTER (notification_type = '3A') AS a2, max(publish_date) FILTER (notification_type = '3A') AS z2,
  min(publish_date) FILTER (notification_type = '3D') AS a3, max(publish_date) FILTER (notification_type = '3D') AS z3
FROM notifications GROUP BY project_id""") + f"""
SELECT project_id, {iso('lo')} AS first_event_date, {iso('hi')} AS last_event_date, st AS latest_event_stage,
  id AS latest_notification_id, n AS notification_count_total, n1 AS notification_count_prelim, n2 AS notification_count_decl,
  n3 AS notification_count_award, {iso('a1')} AS first_prelim_date, {iso('z1')} AS latest_prelim_date,
  {iso('a2')} AS first_decl_date, {iso('z2')} AS latest_decl_date, {iso('a3')} AS first_award_date, {iso('z3')} AS latest_award_date,
  {r(days('a1', 'a2'))} AS days_prelim_to_decl, {r(days('a2', 'a3'))} AS days_decl_to_award, {r(days('a1', 'a3'))} AS days_prelim_to_award,
  {days('lo', 'hi')} AS timeline_span_days FROM f""", nullable=("days_prelim_to_decl", "days_decl_to_award", "days_prelim_to_award"))
def _(t):
    return tl.project_timeline(derived(t, "notifications"))


@query("n03_event_timeline", with_tables("notifications") + f"""
SELECT project_id, notification_id, notification_type, {iso('publish_date')} AS publish_date,
  {iso(f'lag(publish_date) {W}')} AS previous_publish_date,
  {r(days(f'lag(publish_date) {W}', 'publish_date'))} AS days_since_previous_event,
  {days('min(publish_date) OVER (PARTITION BY project_id)', 'publish_date')} AS days_since_first_event FROM notifications""", nullable=("days_since_previous_event",))
def _(t):
    return tl.event_timeline(derived(t, "notifications")).drop("notification_number", "status")


STATE = f"""
SELECT *, row_number() {W} AS seq, lag(publish_date) {W} AS prev, min(publish_date) OVER (PARTITION BY project_id) AS lo,
  count(*) FILTER (notification_type = '3a') {SO_FAR} AS c1, count(*) FILTER (notification_type = '3A') {SO_FAR} AS c2,
  count(*) FILTER (notification_type = '3D') {SO_FAR} AS c3,
  min(publish_date) FILTER (notification_type = '3a') OVER (PARTITION BY project_id) AS f1,
  min(publish_date) FILTER (notification_type = '3A') OVER (PARTITION BY project_id) AS f2,
  min(publish_date) FILTER (notification_type = '3D') OVER (PARTITION BY project_id) AS f3
FROM event_notifications"""
STAGE = "CASE WHEN c3 > 0 THEN '3D' WHEN c2 > 0 THEN '3A' WHEN c1 > 0 THEN '3a' ELSE 'UNKNOWN' END"
FIRST_SEEN = "CASE WHEN c3 > 0 THEN f3 WHEN c2 > 0 THEN f2 WHEN c1 > 0 THEN f1 ELSE lo END"


@query("n04_observed_events", with_tables("event_notifications", s=STATE) + f"""
SELECT project_id, notification_id, notification_type AS event_type, {iso('publish_date')} AS event_date, seq AS event_sequence,
  {iso('prev')} AS previous_event_date, {r(days('prev', 'publish_date'))} AS days_since_previous_event,
  {iso('lo')} AS first_event_date, {days('lo', 'publish_date')} AS days_since_first_event,
  (notification_type = '3a')::INT AS is_prelim, (notification_type = '3A')::INT AS is_decl, (notification_type = '3D')::INT AS is_award,
  (c1 > 0)::INT AS has_prelim_by_date, (c2 > 0)::INT AS has_decl_by_date, (c3 > 0)::INT AS has_award_by_date,
  {STAGE} AS stage_as_of_event FROM s""", nullable=("days_since_previous_event",))
def _(t):
    return tl.observed_events(derived(t, "event_notifications")).drop("notification_number", "status")


@query("n05_duplicate_event_keys", with_tables("notifications") + """
SELECT count(*) - count(DISTINCT (project_id, notification_id)) AS duplicate_event_keys
FROM (SELECT * FROM notifications UNION ALL SELECT * FROM notifications WHERE notification_type = '3D')""")
def _(t):
    rows = derived(t, "notifications")
    return tl.duplicate_event_keys(rows.unionAll(rows.filter("notification_type = '3D'")))


@query("n06_stage_reconciliation", with_tables("event_notifications", c="""
SELECT count(*) FILTER (notification_type = '3a') AS a, count(*) FILTER (notification_type = '3A') AS b,
  count(*) FILTER (notification_type = '3D') AS d, count(*) AS n FROM event_notifications""") + """
SELECT a AS count_prelim, b AS count_decl, d AS count_award, n AS total_events, n - a - b - d AS other_events,
  CASE WHEN a + b + d = n THEN 'PASS' ELSE 'WARNING' END AS status FROM c""")
def _(t):
    return tl.stage_reconciliation(tl.canonical_events(derived(t, "event_notifications")))


@query("n07_project_activity", with_tables("event_notifications", s=STATE) + f"""
SELECT project_id, count(*) AS event_count, arg_max({STAGE}, seq) AS latest_stage FROM s GROUP BY project_id""")
def _(t):
    return tl.project_activity(derived(t, "event_notifications"))


@query("n08_project_snapshots", with_tables("event_notifications", s=STATE) + f"""
SELECT project_id, notification_id, notification_type AS event_type, seq AS event_sequence, seq AS event_count_so_far,
  concat_ws('_', project_id, strftime(publish_date, '%Y%m%d'), CASE WHEN seq > 999 THEN CAST(seq AS VARCHAR) ELSE lpad(CAST(seq AS VARCHAR), 3, '0') END) AS snapshot_id,
  {iso('publish_date')} AS snapshot_date, {iso('lo')} AS project_start_date, {STAGE} AS current_stage,
  {days('lo', 'publish_date')} AS days_since_project_start, {r(days('prev', 'publish_date'))} AS days_since_previous_event,
  c1 AS count_prelim_so_far, c2 AS count_decl_so_far, c3 AS count_award_so_far,
  (c1 > 0)::INT AS has_prelim, (c2 > 0)::INT AS has_decl, (c3 > 0)::INT AS has_award FROM s""", nullable=("days_since_previous_event",))
def _(t):
    return tl.project_snapshots(derived(t, "event_notifications")).drop(
        "notification_number", "status", "stage_first_seen_date", "days_in_current_stage")


@query("n09_days_in_current_stage", with_tables("event_notifications", s=STATE) + f"""
SELECT project_id, notification_id, {STAGE} AS current_stage, {iso(FIRST_SEEN)} AS stage_first_seen_date,
  {days(FIRST_SEEN, 'publish_date')} AS days_in_current_stage FROM s""")
def _(t):
    return tl.project_snapshots(derived(t, "event_notifications")).select(
        "project_id", "notification_id", "current_stage", "stage_first_seen_date", "days_in_current_stage")


@query("n10_static_attributes", with_tables("notifications", "manifest") + f"""
SELECT n.project_id, notification_id, project_name, project_number, {r('land_required_ha')} AS land_required_ha,
  {r('land_to_acquire_ha')} AS land_to_acquire_ha, 'STATIC_REFERENCE' AS project_id_data_class,
  'STATIC_REFERENCE' AS project_name_data_class, 'STATIC_REFERENCE' AS project_number_data_class,
  'STATIC_REFERENCE' AS land_required_ha_data_class, 'STATIC_REFERENCE' AS land_to_acquire_ha_data_class,
  'OBSERVED_AS_OF_SNAPSHOT' AS temporal_state_data_class
FROM notifications n LEFT JOIN manifest m ON n.project_id = m.project_id""")
def _(t):
    return tl.attach_static(derived(t, "notifications").select("project_id", "notification_id"), derived(t, "manifest"))


@query("n11_duplicate_snapshot_ids", with_tables("event_notifications", s=STATE, d="""
SELECT count(*) - count(DISTINCT (project_id, publish_date, seq)) AS n FROM s""") + """
SELECT n AS duplicate_snapshot_ids, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM d""")
def _(t):
    return tl.duplicate_snapshot_ids(tl.project_snapshots(derived(t, "event_notifications")))


@query("n12_backward_transitions", with_tables("notifications", s=f"""
SELECT *, row_number() {W} AS seq, {RANK.format('notification_type')} AS rk FROM notifications""", m="""
SELECT *, max(rk) OVER (PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s""") + f"""
SELECT project_id, {iso('publish_date')} AS snapshot_date, seq AS event_sequence, notification_type AS current_stage,
  rk AS current_stage_rank, before AS previous_stage_rank FROM m WHERE rk < before""")
def _(t):
    snapshots = durable(tl.project_snapshots(derived(t, "notifications")))
    return tl.backward_transitions(snapshots, stage="event_type")


def cycles_sql(source: str) -> dict[str, str]:
    return {
        "m": f"""
SELECT *, row_number() {W} AS seq,
  last_value(CASE WHEN notification_type IN ('3a', '3D') THEN notification_type END IGNORE NULLS) {EARLIER} AS marker FROM {source}""",
        "k": f"""
SELECT *, 1 + count(*) FILTER (notification_type = '3a' AND marker = '3D') {SO_FAR} AS cycle FROM m""",
        "c": """
SELECT *, row_number() OVER u AS cseq, first_value(publish_date) OVER u AS cstart,
  max(CASE WHEN notification_type = '3D' THEN 1 ELSE 0 END) OVER u AS done
FROM k WINDOW u AS (PARTITION BY project_id, cycle ORDER BY publish_date, notification_id ROWS UNBOUNDED PRECEDING)""",
    }


CYCLE_ID = "project_id || '_C' || CASE WHEN cycle > 99 THEN CAST(cycle AS VARCHAR) ELSE lpad(CAST(cycle AS VARCHAR), 2, '0') END"


@query("n13_acquisition_cycles", with_tables("event_notifications", **cycles_sql("event_notifications")) + f"""
SELECT project_id, notification_id, notification_number, status, notification_type AS event_type, notification_type AS cycle_stage,
  {iso('publish_date')} AS event_date, seq AS project_event_sequence, cycle AS cycle_number, {CYCLE_ID} AS cycle_id,
  {iso('cstart')} AS cycle_start_date, cseq AS cycle_event_sequence, {days('cstart', 'publish_date')} AS cycle_days_elapsed,
  done AS cycle_completed, CASE WHEN done = 1 THEN 'COMPLETED' ELSE 'OPEN' END AS cycle_status FROM c""")
def _(t):
    return tl.acquisition_cycles(derived(t, "event_notifications"))


@query("n14_cycle_summary", with_tables("notifications", **cycles_sql("notifications")) + f"""
SELECT project_id, cycle AS cycle_number, {CYCLE_ID} AS cycle_id, {iso('min(cstart)')} AS cycle_start_date,
  {iso('max(publish_date)')} AS cycle_last_event_date, count(*) AS cycle_event_count,
  arg_max(notification_type, cseq) AS latest_cycle_stage, CASE WHEN max(done) = 1 THEN 'COMPLETED' ELSE 'OPEN' END AS cycle_status,
  max(done) AS cycle_completed, max((notification_type = '3a')::INT) AS has_prelim, max((notification_type = '3A')::INT) AS has_decl,
  max((notification_type = '3D')::INT) AS has_award, {days('min(cstart)', 'max(publish_date)')} AS cycle_duration_days
FROM c GROUP BY project_id, cycle""")
def _(t):
    return tl.cycle_summary(tl.acquisition_cycles(derived(t, "notifications")))


@query("n15_cycle_contiguity", with_tables("notifications", **cycles_sql("notifications"), d="""
SELECT DISTINCT project_id, cycle + CASE WHEN project_id % 5 = 0 AND cycle > 1 THEN 1 ELSE 0 END AS cycle FROM c""", e="""
SELECT project_id, cycle, row_number() OVER (PARTITION BY project_id ORDER BY cycle) AS place FROM d""") + """
SELECT project_id, place AS expected_cycle, cycle AS actual_cycle FROM e WHERE place <> cycle""")
def _(t):
    # Every fifth project skips the number two.
    skipped = F.when((F.col("project_id") % 5 == 0) & (F.col("cycle_number") > 1), 1).otherwise(0)
    return tl.cycle_contiguity(tl.acquisition_cycles(derived(t, "notifications")).withColumn("cycle_number", F.col("cycle_number") + skipped))


@query("n16_unified_timeline", with_tables("notifications", "sanctions", u="""
SELECT project_id, publish_date AS d, 'NOTIFICATION' AS event_type,
  CASE notification_type WHEN '3a' THEN '3A_PRELIMINARY_NOTIFICATION' WHEN '3A' THEN '3A_DECLARATION' WHEN '3D' THEN '3D_DECLARATION'
       ELSE notification_type END AS stage, CAST(notification_id AS VARCHAR) AS event_id, notification_number, status, NULL::DOUBLE AS amount_rs
FROM notifications UNION ALL
SELECT project_id, sanction_date, 'SANCTION', 'PROJECT_SANCTION', sanction_number, '', 'SANCTIONED', sanction_amount_rs FROM sanctions""") + f"""
SELECT project_id, {iso('d')} AS event_date, event_type, stage, event_id, notification_number, status, {r('amount_rs')} AS amount_rs,
  row_number() OVER w AS event_sequence, {r(days('lag(d) OVER w', 'd'))} AS days_since_previous_event
FROM u WINDOW w AS (PARTITION BY project_id ORDER BY d, event_type, event_id)""", nullable=("days_since_previous_event",))
def _(t):
    return tl.unified_timeline(derived(t, "notifications"), derived(t, "sanctions"))


TRANSITIONS = """
SELECT *, lead(notification_type) OVER v AS nt, lead(publish_date) OVER v AS nd, lead(notification_id) OVER v AS nid
FROM c WINDOW v AS (PARTITION BY project_id, cycle ORDER BY publish_date, notification_id)"""
PAIRS = "(notification_type = '3a' AND nt = '3A') OR (notification_type = '3A' AND nt = '3D')"


@query("n17_transition_observations", with_tables("notifications", **cycles_sql("notifications"), p=TRANSITIONS) + f"""
SELECT project_id, cycle AS cycle_number, {CYCLE_ID} AS cycle_id, notification_type || '_to_' || nt AS transition,
  notification_type AS from_stage, nt AS to_stage, {iso('publish_date')} AS start_event_date, {iso('nd')} AS end_event_date,
  {days('publish_date', 'nd')} AS duration_days, notification_id AS start_notification_id, nid AS end_notification_id,
  cseq AS start_event_sequence, cseq + 1 AS end_event_sequence, 'OBSERVED' AS observation_quality,
  1 AS usable_for_empirical_benchmark FROM p WHERE {PAIRS}""")
def _(t):
    return tl.transition_observations(derived(t, "notifications")).drop(
        "start_notification_number", "end_notification_number", "start_status", "end_status")


@query("n18_duration_distribution", with_tables("notifications", **cycles_sql("notifications"), p=TRANSITIONS) + f"""
SELECT notification_type || '_to_' || nt AS transition, count(*) AS observation_count, min({days('publish_date', 'nd')}) AS min_days,
  {r(f"median({days('publish_date', 'nd')})")} AS median_days, {r(f"avg({days('publish_date', 'nd')})")} AS mean_days,
  max({days('publish_date', 'nd')}) AS max_days FROM p WHERE {PAIRS} GROUP BY 1""")
def _(t):
    return tl.duration_distribution(tl.transition_observations(derived(t, "notifications")))


@query("n19_stage_policy_check", with_tables("notifications", **cycles_sql("notifications"), p=TRANSITIONS) + f"""
SELECT notification_type || '_to_' || nt AS stage_transition, 'PASS' AS transition_check, 1 AS pending, 0 AS marked_usable,
  count(*) AS observed_transitions, (count(*) >= 100)::INT AS enough_observations FROM p WHERE {PAIRS} GROUP BY 1""")
def _(t):
    return tl.stage_policy_check(stage_policy(t.spark), tl.transition_observations(derived(t, "notifications")))


@query("n19_deadline_overruns", with_tables("notifications", **cycles_sql("notifications"), p=TRANSITIONS) + f"""
SELECT rule_id, deadline_days, count(*) AS observations, count(*) FILTER ({days('publish_date', 'nd')} > deadline_days) AS overruns
FROM p JOIN (VALUES ('RFCTLARR_S19', 365, '3a', '3A'), ('RFCTLARR_S15', 60, '3A', '3D')) AS v(rule_id, deadline_days, a, b) ON notification_type = a AND nt = b GROUP BY ALL""")
def _(t):
    # The objection period is held against the step after the declaration, so that both rules are met.
    rule = legal_policy(t.spark).select(
        "rule_id", F.col("deadline_days").try_cast("int").alias("deadline_days"), F.when(F.col("process_area") == "Declaration", "3a_to_3A").otherwise("3A_to_3D").alias("transition"))
    seen = tl.transition_observations(derived(t, "notifications")).groupBy("transition", "duration_days").agg(F.count(F.lit(1)).alias("n"))
    late = F.col("duration_days") > F.col("deadline_days")
    return seen.join(rule, "transition").groupBy("rule_id", "deadline_days").agg(
        F.sum("n").alias("observations"), F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("overruns"))


POLICY = ("stage_transition string, from_stage string, to_stage string, benchmark_type string, benchmark_days int, confidence string, "
          "minimum_observations_required int, usable_for_ml_label string")
CONFIGURED = "(VALUES ('3a_to_3A', 'YES', 10), ('3a_to_3D', 'NO', 100)) AS v(stage_transition, usable, least)"


def _policy_file(t):
    """The policy as a file: one transition is missing, one is not expected, one is marked usable."""
    path = f"{scratch_folder(t.spark)}/policy.csv"
    rows = stage_policy(t.spark)
    known = rows.filter("stage_transition = '3a_to_3A'")
    changed = known.withColumns({"usable_for_ml_label": F.lit("YES"), "minimum_observations_required": F.lit(10)}).unionByName(
        known.withColumns({"stage_transition": F.lit("3a_to_3D"), "to_stage": F.lit("3D"), "benchmark_type": F.lit("measured")}))
    sinks.write_table(changed, path, "csv")
    return read_policy(t.spark, path, POLICY)


@query("n19_policy_from_file", with_tables("notifications", **cycles_sql("notifications"), p=TRANSITIONS, n=f"""
SELECT notification_type || '_to_' || nt AS stage_transition, count(*) AS n FROM p WHERE {PAIRS} GROUP BY 1""", e="""
SELECT * FROM (VALUES ('3a_to_3A'), ('3A_to_3D')) AS e(stage_transition)""") + f"""
SELECT COALESCE(e.stage_transition, v.stage_transition) AS stage_transition, CASE WHEN v.stage_transition IS NULL THEN 'MISSING' WHEN e.stage_transition IS NULL THEN 'UNEXPECTED' ELSE 'PASS' END AS transition_check,
  COALESCE(v.stage_transition = '3a_to_3A', FALSE)::INT AS pending, COALESCE(v.usable = 'YES', FALSE)::INT AS marked_usable,
  COALESCE(n.n, 0) AS observed_transitions, COALESCE(COALESCE(n.n, 0) >= v.least, FALSE)::INT AS enough_observations
FROM e FULL JOIN {CONFIGURED} ON e.stage_transition = v.stage_transition LEFT JOIN n ON n.stage_transition = COALESCE(e.stage_transition, v.stage_transition)""")
def _(t):
    return tl.stage_policy_check(_policy_file(t), tl.transition_observations(derived(t, "notifications")))


@query("n19_legal_policy_check", """
SELECT p_size % 2 AS side, count(*) AS rules, count(*) FILTER (p_partkey % 3 = 0) AS invalid_deadlines, CASE WHEN count(*) FILTER (p_partkey % 3 = 0) = 0 THEN 'PASS' ELSE 'ERROR' END AS status
FROM part GROUP BY 1""")
def _(t):
    # A rule per part; every third has a deadline that is no number.
    rules = t.part.select((F.col("p_size") % 2).alias("side"), F.when(F.col("p_partkey") % 3 == 0, "on notice").otherwise(F.col("p_size").cast("string")).alias("deadline_days"))
    checked = [tl.legal_policy_check(rules.filter(F.col("side") == side)).withColumn("side", F.lit(side)) for side in (0, 1)]
    return checked[0].unionByName(checked[1]).select("side", "rules", "invalid_deadlines", "status")
