"""R queries: what the serving layer and the dashboards ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.functions.numeric import normalise_record
from landpulse.operators import explain as xp, risk as rk
from landpulse.plans.adapters import band_sql, derived, probability_sql, scored_latest, scorer, with_scored, with_tables
from landpulse.plans.explain import IMPORTANCE, LONG, WEIGHTS
from landpulse.plans.modeling import once
from landpulse.plans.registry import iso, query, r
from landpulse.session import durable

ENRICHED = "SELECT s.*, p.* EXCLUDE (project_id) FROM snapshots s LEFT JOIN projects p ON s.project_id = p.project_id"
LISTED = "project_id, project_name, state, district, implementing_agency, current_stage"
PUBLIC = f"""project_id, project_name, COALESCE(NULLIF(state, ''), 'Unknown') AS state, COALESCE(NULLIF(district, ''), 'Unknown') AS district,
  COALESCE(implementing_agency, 'Unknown') AS implementing_agency, COALESCE(NULLIF(project_type, ''), 'Unknown') AS project_type, current_stage,
  days_in_current_stage, {iso('snapshot_date')} AS snapshot_date, risk_band, risk_90d AS risk_percentage, risk_30d, risk_60d, risk_90d, trend"""
STATE = "COALESCE(NULLIF(state, ''), 'Unknown')"
STAGES = "(VALUES ('3a'), ('3A'), ('3D')) AS d(stage)"
BANDS = "(VALUES ('LOW'), ('MODERATE'), ('HIGH'), ('CRITICAL')) AS d(band)"
BAND_COUNTS = ", ".join(f"count(*) FILTER (risk_band = '{b}') AS {b.lower()}" for b in rk.BANDS)


def table(t):
    """Totals, states, stages and agencies, from one pass over the scored rows, once per session and folder."""
    return once(t, "dashboard", lambda: durable(rk.dashboard(scored_latest(t))))


def latest(t):
    return rk.enrich(rk.latest_snapshots(derived(t, "snapshots")), derived(t, "projects"), one_per_project=True)


@query("r01_enriched_snapshots", with_tables("snapshots", "projects", e=ENRICHED) + f"""
SELECT snapshot_id, {LISTED}, {iso('date_initiation')} AS date_initiation FROM e""")
def _(t):
    twice = derived(t, "projects").unionAll(derived(t, "projects"))
    return rk.enrich(derived(t, "snapshots"), twice).select("snapshot_id", *LISTED.split(", "), "date_initiation")


@query("r02_latest_snapshots", with_scored() + f"SELECT project_id, snapshot_id, {iso('snapshot_date')} AS snapshot_date, current_stage FROM latest")
def _(t):
    return rk.latest_snapshots(derived(t, "snapshots")).select("project_id", "snapshot_id", "snapshot_date", "current_stage")



@query("r03_list_projects", with_scored() + f"""
SELECT {LISTED} FROM scored WHERE lower(project_name) LIKE '%er#00%' OR lower(district) LIKE '%er#00%' OR lower(COALESCE(implementing_agency, '')) LIKE '%er#00%'
ORDER BY project_id LIMIT 100 OFFSET 40""")
def _(t):
    return rk.list_projects(latest(t), 100, 40, search=" ER#00 ").select(*LISTED.split(", "))


@query("r03_list_projects_filtered", with_scored() + f"""
SELECT {LISTED} FROM scored WHERE lower(state) = (SELECT lower(min(n_name)) FROM nation) AND lower(current_stage) = '3a' ORDER BY project_id LIMIT 100""")
def _(t):
    first = t.nation.agg(F.min("n_name")).first()[0]
    return rk.list_projects(latest(t), state=first.lower(), stage="3A").select(*LISTED.split(", "))


@query("r04_count_projects", with_scored() + """
SELECT count(*) AS project_count FROM scored WHERE contains(lower(COALESCE(implementing_agency, '')), 'machinery') OR contains(lower(project_name), 'machinery')""")
def _(t):
    return rk.count_projects(latest(t), search="Machinery")


@query("r05_project_record", with_tables("snapshots", "projects", e=ENRICHED) + f"""
SELECT snapshot_id, {LISTED}, {iso('snapshot_date')} AS snapshot_date, {r('docs_complete_pct')} AS docs_complete_pct FROM e WHERE project_id = 'P7'
ORDER BY e.snapshot_date DESC, snapshot_id DESC LIMIT 1""")
def _(t):
    return normalise_record(rk.project_record(derived(t, "snapshots"), derived(t, "projects"), "P7")).select("snapshot_id", *LISTED.split(", "), "snapshot_date", "docs_complete_pct")


@query("r06_project_history", with_tables("snapshots", "projects", e=ENRICHED) + f"""
SELECT snapshot_id, {LISTED}, {iso('snapshot_date')} AS snapshot_date FROM e WHERE project_id = 'P7'""")
def _(t):
    return rk.project_history(derived(t, "snapshots"), derived(t, "projects"), "P7").select("snapshot_id", *LISTED.split(", "), "snapshot_date")


@query("r07_derived_fields", with_tables("snapshots") + f"""
SELECT snapshot_id, {r('CASE WHEN land_required_ha > 0 THEN land_to_acquire_ha / land_required_ha ELSE 0 END')} AS land_acquisition_ratio,
  {r('CASE WHEN total_parcels > 0 THEN affected_families / total_parcels ELSE 0 END')} AS affected_family_per_parcel,
  {r('CASE WHEN affected_families > 0 THEN vulnerable_families / affected_families ELSE 0 END')} AS vulnerable_family_share,
  {r('GREATEST(compensation_awarded_cr - compensation_disbursed_cr, 0)')} AS compensation_pending_cr,
  {r('CASE WHEN forest_involved = 1 THEN 12.5 ELSE 100 - rnr_progress_pct END')} AS rnr_remaining_pct, {r('100 - docs_complete_pct')} AS docs_remaining_pct FROM snapshots""")
def _(t):
    given = F.when(F.col("forest_involved") == 1, F.lit(12.5))
    return rk.derive_missing(derived(t, "snapshots").withColumn("rnr_remaining_pct", given)).select(
        "snapshot_id", "land_acquisition_ratio", "affected_family_per_parcel", "vulnerable_family_share", "compensation_pending_cr", "rnr_remaining_pct", "docs_remaining_pct")


@query("r08_batch_scoring", with_scored() + f"SELECT project_id, {r('p30')} AS probability_30d, {r('p60')} AS probability_60d, {r('p90')} AS probability_90d FROM scored")
def _(t):
    return scorer(rk.latest_snapshots(derived(t, "snapshots"))).select("project_id", *[f"probability_{h}" for h in rk.HORIZONS])


@query("r09_risk_bands", with_scored() + f"""
SELECT project_id, {band_sql('p30')} AS band_30d, {band_sql('p60')} AS band_60d, risk_band AS band_90d, risk_score AS score_90d, risk_90d FROM scored""")
def _(t):
    return scored_latest(t).select("project_id", "band_30d", "band_60d", "band_90d", "score_90d", "risk_90d")


@query("r10_risk_trend", with_scored() + "SELECT project_id, trend FROM scored")
def _(t):
    return scored_latest(t).select("project_id", "trend")


@query("r11_headline", with_scored(h="SELECT *, CASE WHEN is_censored = 1 THEN p30 ELSE p90 END AS p FROM scored") + f"""
SELECT project_id, {band_sql('p')} AS risk_band, CAST(round_even(p * 100, 0) AS INTEGER) AS risk_score, round_even(p * 100, 1) AS risk_percentage,
  CASE WHEN is_censored = 1 THEN CASE WHEN p60 - p30 >= 0.2e0 THEN 'RISING' WHEN p60 - p30 <= -0.2e0 THEN 'FALLING' ELSE 'STABLE' END ELSE trend END AS trend FROM h""")
def _(t):
    # Censored projects come without a 90-day probability here, so the first horizon leads.
    scored = scorer(rk.latest_snapshots(derived(t, "snapshots")))
    partial = scored.withColumn("probability_90d", F.when(F.col("is_censored") == 0, F.col("probability_90d")))
    return rk.risk_summary(partial).select("project_id", "risk_band", "risk_score", "risk_percentage", "trend")


@query("r11_risk_document", with_scored() + """
SELECT project_id, snapshot_id, risk_band AS headline_band, risk_90d AS percentage_90d, risk_30d AS percentage_30d FROM scored""")
def _(t):
    document = rk.risk_document(scored_latest(t))
    return document.select("project_id", "snapshot_id", F.col("risk.headline_band").alias("headline_band"),
                           F.col("risk.horizons")["90d"]["percentage"].alias("percentage_90d"), F.col("risk.horizons")["30d"]["percentage"].alias("percentage_30d"))


LABELS = """CASE feature WHEN 'file_pending_days' THEN 'Administrative file pending' WHEN 'docs_complete_pct' THEN 'Documentation completeness'
  WHEN 'rnr_progress_pct' THEN 'R&R implementation progress' WHEN 'court_cases_count' THEN 'Legal dispute burden'
  WHEN 'current_stage_3a' THEN 'Current stage: 3a' WHEN 'current_stage_3A' THEN 'Current stage: 3A' WHEN 'current_stage_3D' THEN 'Current stage: 3D' END"""
CATEGORIES = """CASE feature WHEN 'rnr_progress_pct' THEN 'Rehabilitation & Resettlement' WHEN 'court_cases_count' THEN 'Legal' ELSE 'Administrative' END"""


@query("r12_project_evidence", with_tables("snapshots", l=LONG, k="""
SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY c DESC, feature) AS i FROM l WHERE c > 0 AND target = 'delay_next_90d'""", d=f"""
SELECT snapshot_id, i, feature, {LABELS} AS label, {CATEGORIES} AS category, x, c FROM k WHERE i <= 5""") + f"""
SELECT s.project_id, s.snapshot_id, {r('i')} AS driver_rank, feature, label, category, {r('x')} AS value, {r('round_even(c, 4)')} AS contribution,
  label || ' is contributing to the model''s current risk score.' AS explanation, (feature IS NOT NULL)::INT AS available
FROM snapshots s LEFT JOIN d ON s.snapshot_id = d.snapshot_id""", nullable=("driver_rank",))
def _(t):
    rows = derived(t, "snapshots")
    only = {"delay_next_90d": WEIGHTS["delay_next_90d"]}
    return rk.project_evidence(xp.top_drivers(rows, only, ["snapshot_id"], values=xp.stage_flags()), rows)


@query("r13_model_context", with_tables("snapshots", l=LONG, g=IMPORTANCE) + f"""
SELECT i AS rank, feature, {LABELS} AS label, {CATEGORIES} AS category, {r('round_even(share, 2)')} AS normalized_importance_pct FROM g
WHERE target = 'delay_next_90d' AND i <= 5""")
def _(t):
    local = xp.local_explanations(derived(t, "snapshots"), WEIGHTS, ["snapshot_id"], xp.stage_flags())
    return rk.model_context(xp.global_importance(local))


def _rule(condition: str, priority: str, action: str, category: str, trigger: str) -> str:
    return f"SELECT project_id, snapshot_id, '{action}' AS action, '{category}' AS category, {priority} AS priority, {trigger} AS trigger FROM latest WHERE {condition}"


def _n(c: str) -> str:
    return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


ACTIONS = " UNION ALL ".join([
    _rule("pending_approvals_count >= 4", "'HIGH'", "Review pending approvals and assign a responsible department.", "Administrative", f"'pending_approvals_count = ' || {_n('pending_approvals_count')}"),
    _rule("file_pending_days >= 60", "'HIGH'", "Escalate the long-pending administrative file.", "Administrative", f"'file_pending_days = ' || {_n('file_pending_days')}"),
    _rule("docs_complete_pct < 80", "CASE WHEN docs_complete_pct < 60 THEN 'HIGH' ELSE 'MEDIUM' END", "Complete missing acquisition documentation.", "Administrative", f"'docs_complete_pct = ' || {_n('docs_complete_pct')} || '%'"),
    _rule("compensation_awarded_cr > 0 AND disbursal_pct < 70", "CASE WHEN disbursal_pct < 40 THEN 'HIGH' ELSE 'MEDIUM' END", "Prioritize compensation disbursement for eligible cases.", "Compensation", f"'disbursal_pct = ' || {_n('disbursal_pct')} || '%'"),
    _rule("court_cases_count >= 2", "CASE WHEN court_cases_count >= 5 THEN 'HIGH' ELSE 'MEDIUM' END", "Review pending legal/title disputes with the legal cell.", "Legal", f"'court_cases_count = ' || {_n('court_cases_count')}"),
    _rule("rnr_progress_pct < 60", "CASE WHEN rnr_progress_pct < 35 THEN 'HIGH' ELSE 'MEDIUM' END", "Prioritize rehabilitation and resettlement actions.", "Rehabilitation & Resettlement", f"'rnr_progress_pct = ' || {_n('rnr_progress_pct')} || '%'"),
    _rule("grievances_30d >= 5 OR grievance_redressal_days >= 30", "CASE WHEN grievances_30d >= 10 OR grievance_redressal_days >= 60 THEN 'HIGH' ELSE 'MEDIUM' END", "Review unresolved grievances and strengthen grievance redressal.", "Community / Grievance", f"'grievances_30d = ' || {_n('grievances_30d')} || '; grievance_redressal_days = ' || {_n('grievance_redressal_days')}"),
    _rule("days_in_current_stage >= 180", "'MEDIUM'", "Conduct a stage-review meeting and record the next transition dependency.", "Administrative", f"'days_in_current_stage = ' || {_n('days_in_current_stage')}"),
])


@query("r14_recommended_actions", with_scored(f=ACTIONS, a="""
SELECT * FROM f UNION ALL SELECT project_id, snapshot_id, 'Maintain routine milestone monitoring and update the project record.', 'Administrative', 'LOW', 'No rule threshold exceeded'
FROM latest WHERE snapshot_id NOT IN (SELECT snapshot_id FROM f)""") + """
SELECT project_id, snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, category, action) AS action_rank,
  action, category, priority, trigger, 'Open' AS status FROM a""")
def _(t):
    return rk.recommended_actions(rk.latest_snapshots(derived(t, "snapshots"))).drop("owner", "reason")


CHANGED = """(4 * CASE WHEN o_custkey_n % 2 = 0 THEN 0 ELSE pending_approvals_count END + file_pending_days + (100 - 95) + 3 * court_cases_count
 + 2 * grievances_30d + (100 - rnr_progress_pct))"""


@query("r15_what_if", with_scored(w="SELECT *, CAST(substring(project_id, 2) AS BIGINT) AS o_custkey_n FROM scored", c="SELECT *, " + ", ".join(
    f"{probability_sql(h, CHANGED)} AS q{h[:2]}" for h in rk.HORIZONS) + " FROM w") + " UNION ALL ".join(
    f"""SELECT project_id, snapshot_id, '{h}' AS horizon, round_even(p{h[:2]} * 100, 1) AS current_percentage, round_even(q{h[:2]} * 100, 1) AS simulated_percentage,
    (round_even(round_even(q{h[:2]} * 100, 1) - round_even(p{h[:2]} * 100, 1), 1) + 0.0) AS estimated_change_percentage_points, {band_sql(f'p{h[:2]}')} AS risk_band_before,
    {band_sql(f'q{h[:2]}')} AS risk_band_after FROM c""" for h in rk.HORIZONS))
def _(t):
    rows = rk.latest_snapshots(derived(t, "snapshots"))
    number = F.substring("project_id", 2, 20).cast("bigint")
    scenarios = rows.select("project_id", F.when(number % 2 == 0, F.lit(0)).alias("pending_approvals_count"), F.lit(95.0).alias("docs_complete_pct"))
    return rk.what_if(rows, scenarios, scorer)


@query("r16_national_kpis", with_scored() + f"""
SELECT count(*) AS total_projects, count(*) FILTER (current_stage <> '') AS ongoing_projects, {BAND_COUNTS}, {iso('max(snapshot_date)')} AS last_updated FROM scored""")
def _(t):
    return rk.kpis_of(table(t))


BY_STATE = f"""SELECT {STATE} AS state, count(*) AS ongoing_projects, count(*) FILTER (risk_band = 'HIGH') AS high_risk_projects,
  count(*) FILTER (risk_band = 'CRITICAL') AS critical_projects, round_even(avg(risk_90d), 1) AS average_90d_risk FROM scored GROUP BY 1"""


@query("r17_projects_by_state", with_scored() + BY_STATE)
def _(t):
    return rk.states_of(table(t))


@query("r18_projects_by_stage", with_scored() + f"SELECT stage, count(project_id) AS projects FROM {STAGES} LEFT JOIN (SELECT * FROM scored WHERE current_stage <> '3A') x ON stage = current_stage GROUP BY stage")
def _(t):
    # Stage 3A is blanked, so that an empty stage occurs.
    return rk.projects_by_stage(scored_latest(t).withColumn("current_stage", F.when(F.col("current_stage") != "3A", F.col("current_stage"))))


@query("r19_projects_by_agency", with_scored() + "SELECT COALESCE(implementing_agency, 'Unknown') AS agency, count(*) AS ongoing_projects FROM scored GROUP BY 1")
def _(t):
    return rk.agencies_of(table(t))


@query("r20_recently_flagged", with_scored() + f"""
SELECT {PUBLIC} FROM scored WHERE risk_band IN ('HIGH', 'CRITICAL') ORDER BY scored.snapshot_date DESC, risk_90d DESC, project_id LIMIT 12""")
def _(t):
    return rk.recently_flagged(scored_latest(t))


@query("r21_state_risk_matrix", with_scored() + f"""
SELECT {STATE} AS state, count(*) AS projects, {BAND_COUNTS}, round_even(avg(risk_90d), 1) AS average_90d_risk FROM scored GROUP BY 1""")
def _(t):
    return rk.state_matrix_of(table(t))


@query("r22_priority_queue", with_scored() + f"SELECT {PUBLIC} FROM scored WHERE risk_band IN ('HIGH', 'CRITICAL') ORDER BY risk_90d DESC, project_id LIMIT 25")
def _(t):
    return rk.priority_queue(scored_latest(t))


@query("r23_public_projects", with_scored() + f"SELECT {PUBLIC} FROM scored")
def _(t):
    return rk.public_projects(scored_latest(t))


@query("r24_register_view", with_scored() + f"""
SELECT project_id, project_name, state, current_stage, risk_band, risk_90d FROM scored
WHERE contains(lower(project_id || ' ' || project_name || ' ' || state || ' ' || district || ' ' || COALESCE(implementing_agency, '')), 'household') AND current_stage = '3A'
ORDER BY risk_90d DESC, project_id LIMIT 20 OFFSET 20""")
def _(t):
    scored = scored_latest(t)
    rows = scored.drop("risk_band", "risk_30d", "risk_60d", "risk_90d", "trend")
    return rk.register_view(rows, scored, 2, search="HouseHold", stage="3A").select("project_id", "project_name", "state", "current_stage", "risk_band", "risk_90d")


@query("r25_stage_risk", with_scored() + f"""
SELECT stage, count(project_id) AS projects, {r('COALESCE(avg(risk_90d), 0)')} AS average_90d_risk FROM {STAGES} LEFT JOIN scored ON stage = current_stage GROUP BY stage""")
def _(t):
    return rk.stage_risk_of(table(t))


@query("r26_aging_queue", with_scored() + """
SELECT project_id, project_name, state, current_stage, days_in_current_stage, risk_90d, risk_band FROM scored WHERE days_in_current_stage >= 120
ORDER BY days_in_current_stage DESC, project_id LIMIT 25""")
def _(t):
    return rk.aging_queue(scored_latest(t))


@query("r27_state_stage_matrix", with_scored() + """
SELECT state, count(*) AS total, count(*) FILTER (current_stage = '3a') AS stage_prelim, count(*) FILTER (current_stage = '3A') AS stage_decl,
  count(*) FILTER (current_stage = '3D') AS stage_award FROM scored WHERE state <> '' GROUP BY state""")
def _(t):
    return rk.state_stages_of(table(t))


@query("r28_state_density", with_scored(b=BY_STATE) + """
SELECT *, CASE WHEN critical_projects > 0 THEN 'critical' WHEN high_risk_projects > 0 THEN 'high' WHEN average_90d_risk >= 1 THEN 'moderate' ELSE 'low' END AS density_class FROM b""")
def _(t):
    return rk.state_density(rk.states_of(table(t)))


@query("r28_state_queues", with_scored() + """
SELECT * FROM (SELECT state, row_number() OVER (PARTITION BY state ORDER BY risk_90d DESC, project_id) AS queue_rank, project_id, project_name, district, current_stage, risk_90d, risk_band
FROM scored) WHERE queue_rank <= 20""")
def _(t):
    return rk.state_queues(scored_latest(t))


@query("r29_band_shares", with_scored() + f"""
SELECT band AS risk_band, count(project_id) AS projects, {r('count(project_id) / (SELECT count(*) FROM scored) * 100')} AS share_pct
FROM {BANDS} LEFT JOIN scored ON band = risk_band GROUP BY band""")
def _(t):
    return rk.distribution_of(table(t))


@query("r30_merged_state_rows", with_scored(b=BY_STATE) + f"""
SELECT b.*, {r('x.low')} AS low, {r('x.moderate')} AS moderate FROM b
LEFT JOIN (SELECT CASE WHEN starts_with({STATE}, 'C') THEN 'old ' || {STATE} ELSE {STATE} END AS state, {BAND_COUNTS} FROM scored GROUP BY 1) x ON b.state = x.state""", nullable=("low", "moderate"))
def _(t):
    # The risk side knows some states by an old name.
    scored = scored_latest(t)
    old = F.when(F.startswith("state", F.lit("C")), F.concat(F.lit("old "), "state")).otherwise(F.col("state"))
    return rk.merged_state_rows(rk.projects_by_state(scored), rk.state_risk_matrix(scored.withColumn("state", old)))


@query("r31_observed_duration", with_tables("snapshots") + """
SELECT project_id, count(*) AS snapshots, date_diff('day', min(snapshot_date), max(snapshot_date)) AS observed_days FROM snapshots GROUP BY project_id""")
def _(t):
    return rk.observed_duration(derived(t, "snapshots"))
