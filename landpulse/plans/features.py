"""F queries: project features and the project master."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.operators import features as ft, timeline as tl
from landpulse.plans.adapters import derived, with_tables
from landpulse.plans.registry import iso, query, r

SURVEY = """
SELECT project_id, count(*) AS n, sum(area_hectares) AS area, COALESCE(sum(area_hectares) FILTER (land_nature = 'Private'), 0) AS priv,
  COALESCE(sum(area_hectares) FILTER (land_nature = 'Government'), 0) AS gov, count(DISTINCT village) AS villages,
  count(DISTINCT district) AS districts, count(*) FILTER (land_category = 'Urban') AS urban, count(*) FILTER (land_type = 'Wet') AS wet
FROM surveys GROUP BY project_id"""
PARTY = """
SELECT project_id, count(*) AS n, count(*) FILTER (party_type = 'Owner') AS owners, count(*) FILTER (party_type = 'Affected Party') AS affected,
  count(party_area_hectares) AS numeric_n, sum(party_area_hectares) AS area, avg(party_area_hectares) AS mean, max(party_area_hectares) AS biggest
FROM parties GROUP BY project_id"""
ASSEMBLED = """
SELECT m.*, COALESCE(s.n, 0) AS survey_count, s.area AS surveyed_area_ha, COALESCE(s.villages, 0) AS village_count,
  COALESCE(p.n, 0) AS party_record_count, COALESCE(p.owners, 0) AS owner_record_count, COALESCE(p.affected, 0) AS affected_party_count,
  COALESCE(p.numeric_n, 0) AS party_area_numeric_count, p.area AS party_area_total_ha
FROM manifest m LEFT JOIN s ON m.project_id = s.project_id LEFT JOIN p ON m.project_id = p.project_id"""


def _parts(t):
    return derived(t, "manifest"), derived(t, "surveys"), derived(t, "parties")


@query("f01_survey_features", with_tables("surveys", s=SURVEY) + f"""
SELECT project_id, n AS survey_count, {r('area')} AS surveyed_area_ha, {r('priv')} AS private_area_ha, {r('gov')} AS government_area_ha,
  villages AS village_count, districts AS district_count, urban AS urban_survey_count, wet AS wet_survey_count,
  {r('CASE WHEN area = 0 THEN 0 ELSE priv / area * 100 END')} AS private_land_pct,
  {r('CASE WHEN area = 0 THEN 0 ELSE gov / area * 100 END')} AS government_land_pct,
  {r('urban / n * 100')} AS urban_survey_pct, {r('wet / n * 100')} AS wet_land_pct FROM s""")
def _(t):
    return ft.survey_features(derived(t, "surveys"))


@query("f02_party_features", with_tables("parties", p=PARTY) + f"""
SELECT project_id, n AS party_record_count, owners AS owner_record_count, affected AS affected_party_count,
  numeric_n AS party_area_numeric_count, n - numeric_n AS party_area_missing_count, {r('area')} AS party_area_total_ha,
  {r('mean')} AS party_area_mean_ha, {r('biggest')} AS party_area_max_ha, {r('affected / n * 100')} AS affected_party_rate_pct FROM p""")
def _(t):
    return ft.party_features(derived(t, "parties"))


@query("f03_feature_assembly", with_tables("manifest", "surveys", "parties", s=SURVEY, p=PARTY, a=ASSEMBLED) + f"""
SELECT project_id, project_name, survey_count, {r('surveyed_area_ha')} AS surveyed_area_ha, village_count, party_record_count,
  owner_record_count, affected_party_count, party_area_numeric_count, {r('party_area_total_ha')} AS party_area_total_ha FROM a""")
def _(t):
    manifest, surveys, parties = _parts(t)
    twice = manifest.unionAll(manifest)  # repeated manifests collapse to one row per project
    return ft.assemble_features(twice, surveys, parties).select(
        "project_id", "project_name", "survey_count", "surveyed_area_ha", "village_count", "party_record_count", "owner_record_count",
        "affected_party_count", "party_area_numeric_count", "party_area_total_ha")


@query("f04_fallback_population", with_tables("surveys", s=SURVEY) + f"""
SELECT project_id, n AS survey_count, {r('area')} AS surveyed_area_ha FROM s""")
def _(t):
    manifest, surveys, parties = _parts(t)
    return ft.assemble_features(manifest.limit(0), surveys, parties).select("project_id", "survey_count", "surveyed_area_ha")


@query("f05_derived_ratios", with_tables("manifest", "surveys", "parties", s=SURVEY, p=PARTY, a=ASSEMBLED) + f"""
SELECT project_id, {r('land_acquired_ha / NULLIF(land_to_acquire_ha, 0) * 100')} AS acquisition_completion_pct,
  {r('surveyed_area_ha / NULLIF(land_to_acquire_ha, 0) * 100')} AS surveyed_vs_land_to_acquire_pct,
  {r('party_record_count / NULLIF(survey_count, 0)')} AS parties_per_survey, {r('owner_record_count / NULLIF(survey_count, 0)')} AS owners_per_survey FROM a""")
def _(t):
    return ft.project_features(*_parts(t)).select(
        "project_id", "acquisition_completion_pct", "surveyed_vs_land_to_acquire_pct", "parties_per_survey", "owners_per_survey")


WIDE = {
    "sv": """
SELECT project_id, count(*) AS n, COALESCE(sum(area_hectares), 0) AS area, COALESCE(sum(area_hectares) FILTER (land_nature = 'Private'), 0) AS priv,
  COALESCE(sum(area_hectares) FILTER (land_nature = 'Government'), 0) AS gov, count(DISTINCT NULLIF(trim(village), '')) AS villages,
  count(DISTINCT NULLIF(trim(district), '')) AS districts, count(DISTINCT NULLIF(trim(sub_district), '')) AS subs,
  count(DISTINCT NULLIF(trim(land_type), '')) AS types, count(DISTINCT NULLIF(trim(land_category), '')) AS cats,
  sum(owner_count) AS so, sum(affected_party_count) AS sa FROM surveys GROUP BY project_id""",
    "pa": PARTY,
    "nt": """
SELECT project_id, count(*) AS n, count(*) FILTER (notification_type = '3a') AS n1,
  max(publish_date) FILTER (notification_type = '3a') AS z1, max(publish_date) FILTER (notification_type = '3D') AS z3,
  min(publish_date) FILTER (notification_type = '3a') AS a1, min(publish_date) FILTER (notification_type = '3A') AS a2 FROM notifications GROUP BY project_id""",
    "ev": "SELECT project_id, publish_date AS d FROM notifications UNION ALL SELECT project_id, sanction_date FROM sanctions",
    "gp": "SELECT project_id, d, date_diff('day', lag(d) OVER (PARTITION BY project_id ORDER BY d), d) AS gap FROM ev",
    "ga": """
SELECT project_id, min(d) AS lo, max(d) AS hi, avg(gap) AS mean, median(gap) AS med, max(gap) AS biggest FROM gp GROUP BY project_id""",
}


@query("f06_wide_project_record", with_tables("manifest", "surveys", "parties", "notifications", "sanctions", **WIDE) + f"""
SELECT m.project_id, {r('GREATEST(land_to_acquire_ha - land_acquired_ha, 0)')} AS land_remaining_ha,
  {r('land_acquired_ha / NULLIF(land_to_acquire_ha, 0) * 100')} AS acquisition_completion_pct, COALESCE(sv.n, 0) AS total_surveys,
  {r('COALESCE(sv.area, 0)')} AS surveyed_area_ha, {r('COALESCE(sv.area, 0) / NULLIF(land_required_ha, 0) * 100')} AS surveyed_vs_required_pct,
  {r('COALESCE(sv.area, 0) / NULLIF(land_to_acquire_ha, 0) * 100')} AS surveyed_vs_acquisition_target_pct,
  {r('sv.priv / NULLIF(sv.area, 0) * 100')} AS private_land_pct, {r('sv.gov / NULLIF(sv.area, 0) * 100')} AS government_land_pct,
  COALESCE(villages, 0) AS village_count, COALESCE(districts, 0) AS district_count, COALESCE(subs, 0) AS sub_district_count,
  COALESCE(types, 0) AS land_type_count, COALESCE(cats, 0) AS land_category_count, COALESCE(pa.n, 0) AS total_party_records,
  COALESCE(owners, 0) AS total_owners, COALESCE(affected, 0) AS total_affected_parties,
  {r('COALESCE(affected, 0) / NULLIF(COALESCE(sv.n, 0), 0) * 100')} AS affected_party_density_pct,
  {r('COALESCE(owners, 0) / NULLIF(COALESCE(sv.n, 0), 0)')} AS owners_per_survey, {r('so')} AS survey_owner_count_sum, {r('sa')} AS survey_affected_party_count_sum,
  {r('n1')} AS notification_cycle_count, {r('nt.n')} AS notification_count_total, {iso('ga.lo')} AS first_event_date, {iso('ga.hi')} AS latest_event_date,
  {r("date_diff('day', ga.lo, ga.hi)")} AS timeline_span_days, {r('ga.mean')} AS average_event_gap_days, {r('med')} AS median_event_gap_days,
  {r('ga.biggest')} AS max_event_gap_days, {r("date_diff('day', a1, a2)")} AS days_prelim_to_decl,
  {r("date_diff('day', z1, z3)")} AS days_latest_prelim_to_latest_award, {r("date_diff('day', z3, ga.hi)")} AS days_since_latest_award_event,
  COALESCE(pa.numeric_n, 0) AS party_area_numeric_count, COALESCE(pa.n - pa.numeric_n, 0) AS party_area_missing_count
FROM manifest m LEFT JOIN sv ON m.project_id = sv.project_id LEFT JOIN pa ON m.project_id = pa.project_id
LEFT JOIN nt ON m.project_id = nt.project_id LEFT JOIN ga ON m.project_id = ga.project_id""", nullable=(
    "survey_owner_count_sum", "survey_affected_party_count_sum", "notification_cycle_count", "notification_count_total", "timeline_span_days",
    "max_event_gap_days", "days_prelim_to_decl", "days_latest_prelim_to_latest_award", "days_since_latest_award_event"))
def _(t):
    manifest, surveys, parties = _parts(t)
    notes = derived(t, "notifications")
    record = ft.wide_project_record(manifest, surveys, parties, tl.project_timeline(notes), tl.unified_timeline(notes, derived(t, "sanctions")))
    return record.select(
        "project_id", "land_remaining_ha", "acquisition_completion_pct", "total_surveys", "surveyed_area_ha", "surveyed_vs_required_pct",
        "surveyed_vs_acquisition_target_pct", "private_land_pct", "government_land_pct", "village_count", "district_count", "sub_district_count",
        "land_type_count", "land_category_count", "total_party_records", "total_owners", "total_affected_parties", "affected_party_density_pct",
        "owners_per_survey", "survey_owner_count_sum", "survey_affected_party_count_sum", "notification_cycle_count", "notification_count_total",
        "first_event_date", "latest_event_date", "timeline_span_days", "average_event_gap_days", "median_event_gap_days", "max_event_gap_days",
        "days_prelim_to_decl", "days_latest_prelim_to_latest_award", "days_since_latest_award_event", "party_area_numeric_count", "party_area_missing_count")


@query("f07_normalise_project_id", "SELECT c_custkey AS project_id, c_name FROM customer WHERE c_custkey % 6 <> 0")
def _(t):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.lit("unknown")).when(k % 6 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string"))
    return ft.normalise_project_id(t.customer.select(text.alias("project_id"), "c_name"))


MASTER = {
    "tl": """
SELECT project_id, min(publish_date) AS first_event_date, arg_max(notification_type, (publish_date, notification_id)) AS latest_event_stage,
  count(*) AS n FROM notifications GROUP BY project_id""",
    "ms": "SELECT m.*, tl.first_event_date, tl.latest_event_stage, tl.n AS total FROM manifest m LEFT JOIN tl ON m.project_id = tl.project_id",
}


def _master(t):
    # The events of projects with more than 280 ha to acquire stand under another number here, so that missing timelines occur.
    small = derived(t, "manifest").filter("land_to_acquire_ha <= 280").select("project_id", F.lit(1).alias("small"))
    notes = derived(t, "notifications").join(small, "project_id", "left").withColumn(
        "project_id", F.when(F.col("small").isNull(), -F.col("project_id")).otherwise(F.col("project_id"))).drop("small")
    return ft.project_master(derived(t, "manifest"), tl.project_timeline(notes))


def _master_sql():
    tables = dict(MASTER)
    tables["tl"] = tables["tl"].replace("FROM notifications", """FROM (SELECT * REPLACE (CASE WHEN project_id IN (SELECT project_id FROM manifest WHERE land_to_acquire_ha <= 280)
THEN project_id ELSE -project_id END AS project_id) FROM notifications)""")
    return with_tables("manifest", "notifications", **tables)


@query("f08_project_master", _master_sql() + f"""
SELECT project_id, project_name, {iso('first_event_date')} AS first_event_date, latest_event_stage, {r('total')} AS notification_count_total FROM ms""",
       nullable=("notification_count_total",))
def _(t):
    return _master(t).select("project_id", "project_name", "first_event_date", "latest_event_stage", "notification_count_total")


@query("f09_master_summary", _master_sql() + """
SELECT count(*) AS project_rows, count(DISTINCT project_id) AS unique_project_ids, count(*) - count(DISTINCT project_id) AS duplicate_ids,
  count(*) FILTER (first_event_date IS NULL) AS projects_without_timeline FROM ms""")
def _(t):
    return ft.master_summary(_master(t))


@query("f09_stage_value_counts", _master_sql() + "SELECT latest_event_stage, count(*) AS projects FROM ms GROUP BY 1")
def _(t):
    return ft.stage_value_counts(_master(t))


@query("f09_columns_with_nulls", _master_sql() + """
SELECT * FROM (SELECT 'latest_event_stage' AS "column", count(*) FILTER (latest_event_stage IS NULL) AS missing_count FROM ms UNION ALL
SELECT 'notification_count_total', count(*) FILTER (total IS NULL) FROM ms) WHERE missing_count > 0""")
def _(t):
    return ft.columns_with_nulls(_master(t).select("project_id", "project_name", "latest_event_stage", "notification_count_total"))
