"""S queries: tables written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import schemas
from landpulse.operators import quality, risk, timeline as tl
from landpulse.plans.adapters import derived, scored_latest, with_scored, with_tables
from landpulse.plans.registry import iso, query, r
from landpulse.session import scratch_folder
from landpulse.sources import registry as reg, sinks

NOTES = f"""SELECT project_id, notification_id, notification_type, {iso('publish_date')} AS publish_date, notification_number, status"""


def _text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("s01_multi_file_csv_scan", with_tables("notifications", "sanctions") + NOTES + ", NULL AS amount FROM notifications"
       f" UNION ALL SELECT project_id, NULL, NULL, NULL, sanction_number, NULL, {r('sanction_amount_rs')} FROM sanctions", nullable=("notification_id",))
def _(t):
    folder = scratch_folder(t.spark)
    columns = [c.split()[0] for c in schemas.NOTIFICATIONS.split(", ")]
    notes = _text(derived(t, "notifications"))
    full = notes.select(*[F.col(c) if c in notes.columns else F.lit(None).cast("string").alias(c) for c in columns])
    # one layout in order, one reversed, one without its optional last columns
    for kind, layout in zip(tl.STAGES, (columns, columns[::-1], columns[:7])):
        sinks.write_table(full.filter(F.col("notification_type") == kind).select(*layout), f"{folder}/{kind}/notifications.csv", "csv")
    sinks.write_table(full.limit(0), f"{folder}/none/notifications.csv", "csv")
    scanned = reg.lenient_types(reg.scan_csv_files(t.spark, f"{folder}/*/notifications.csv", schemas.NOTIFICATIONS))
    grants = derived(t, "sanctions").select("project_id", F.col("sanction_number").alias("notification_number"), F.col("sanction_amount_rs").alias("amount"))
    kept = scanned.select("project_id", "notification_id", "notification_type", "publish_date", "notification_number", "status")
    return reg.union_layouts(kept, grants)


@query("s02_single_csv_scan", with_tables("sanctions") + f"""
SELECT project_id, sanction_number, {iso('sanction_date')} AS sanction_date, {r('sanction_amount_rs')} AS sanction_amount_rs FROM sanctions""")
def _(t):
    path = f"{scratch_folder(t.spark)}/sanctions.csv"
    sinks.write_table(derived(t, "sanctions"), path, "csv")
    return reg.lenient_types(reg.read_text_csv(t.spark, path, schemas.SANCTIONS))


@query("s03_all_text_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS project_id, 'He said "' || c_name || '", twice' AS project_name,
       CAST(c_nationkey AS VARCHAR) AS project_number FROM customer""")
def _(t):
    path = f"{scratch_folder(t.spark)}/quoted.csv"
    quoted = t.customer.select(F.col("c_custkey").alias("project_id"), F.concat(F.lit('He said "'), "c_name", F.lit('", twice')).alias("project_name"),
                               F.col("c_nationkey").alias("project_number"))
    sinks.write_table(quoted, path, "csv")
    return reg.read_text_csv(t.spark, path, "project_id string, project_name string, project_number string")


@query("s04_required_columns", "SELECT 'orders' AS dataset, count(*) AS rows, max(o_orderkey) AS last_key FROM orders")
def _(t):
    path = f"{scratch_folder(t.spark)}/orders.csv"
    sinks.write_table(t.orders.select("o_orderdate", "o_custkey", "o_orderkey"), path, "csv")
    checked = reg.scan_csv_files(t.spark, path, "o_orderkey string, o_custkey string, o_orderdate string", required=["o_orderkey", "o_custkey", "o_orderdate"])
    return checked.agg(F.count("o_orderkey").alias("rows"), F.max(F.col("o_orderkey").cast("bigint")).alias("last_key")).select(
        F.lit("orders").alias("dataset"), "rows", "last_key")


@query("s05_lenient_types", f"""
SELECT doc_id, {r("CASE WHEN doc_id % 3 = 1 THEN doc_id / 2 END")} AS area_hectares,
  {iso("CASE WHEN doc_id % 3 = 2 THEN DATE '2020-01-31' END")} AS publish_date FROM documents""")
def _(t):
    third = F.col("doc_id") % 3
    raw = t.documents.select(
        "doc_id",
        F.when(third == 1, (F.col("doc_id") / 2).cast("string")).when(third == 2, F.lit("")).otherwise(F.lit("n/a")).alias("area_hectares"),
        F.when(third == 2, F.lit("2020-01-31")).when(third == 1, F.lit("31 Jan")).otherwise(F.lit("")).alias("publish_date"))
    return reg.lenient_types(raw)


@query("s06_partitioned_layout", with_tables("notifications") + """
SELECT notification_type, count(*) AS rows, 1::BIGINT AS files, min(notification_id) AS first_id, max(notification_id) AS last_id FROM notifications GROUP BY 1""")
def _(t):
    path = f"{scratch_folder(t.spark)}/by-type"
    sinks.write_partitioned(derived(t, "notifications"), path, ["notification_type"], "parquet")
    back = t.spark.read.parquet(path)
    return back.groupBy("notification_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.col("_metadata.file_path")).alias("files"), F.min("notification_id").alias("first_id"), F.max("notification_id").alias("last_id"))


@query("s07_table_sink", with_tables("notifications") + NOTES + " FROM notifications")
def _(t):
    path = f"{scratch_folder(t.spark)}/notifications"
    sinks.write_table(derived(t, "notifications"), path)
    return t.spark.read.parquet(path)


@query("s08_json_report", """
SELECT 'orders' AS dataset, count(*) AS project_count, count(*) FILTER (o_totalprice < 1000) AS cheap,
  CASE WHEN count(*) < 50 THEN 'NOT_READY_FOR_PRODUCTION_ML' ELSE 'READY_FOR_NEXT_PIPELINE_STAGE' END AS overall_status FROM orders""")
def _(t):
    path = f"{scratch_folder(t.spark)}/report"
    counted = t.orders.agg(F.count(F.lit(1)).alias("project_count"), F.count_if(F.col("o_totalprice") < 1000).alias("cheap"))
    status = F.when(F.col("project_count") < quality.SMALLEST_READY_TABLE, quality.NOT_READY).otherwise(quality.READY)
    sinks.write_json_report(counted.select(F.struct(F.lit("orders").alias("name"), status.alias("status")).alias("summary"), "project_count", "cheap"), path)
    back = t.spark.read.schema("summary struct<name string, status string>, project_count bigint, cheap bigint").json(path)
    return back.select(F.col("summary.name").alias("dataset"), "project_count", "cheap", F.col("summary.status").alias("overall_status"))


@query("s09_register_export", with_scored() + f"""
SELECT project_id, project_name, COALESCE(NULLIF(state, ''), 'Unknown') AS state, COALESCE(NULLIF(district, ''), 'Unknown') AS district,
  COALESCE(implementing_agency, 'Unknown') AS implementing_agency, COALESCE(NULLIF(project_type, ''), 'Unknown') AS project_type,
  current_stage, days_in_current_stage, risk_band, risk_30d, risk_60d, risk_90d, trend, {iso('snapshot_date')} AS snapshot_date FROM scored""")
def _(t):
    path = f"{scratch_folder(t.spark)}/register.csv"
    scored = scored_latest(t)
    export = sinks.register_export(scored, risk.public_projects(scored))
    sinks.write_register(export, path)
    types = {"days_in_current_stage": "int", "risk_30d": "double", "risk_60d": "double", "risk_90d": "double"}
    back = reg.read_text_csv(t.spark, path, ", ".join(f"{c} string" for c in sinks.REGISTER_COLUMNS))
    return back.withColumns({c: F.col(c).cast(k) for c, k in types.items()})


@query("s10_policy_tables", with_tables("notifications") + """
SELECT notification_type AS from_stage, count(*) AS notifications,
  CASE notification_type WHEN '3a' THEN '3a_to_3A' WHEN '3A' THEN '3A_to_3D' END AS stage_transition,
  CASE WHEN notification_type <> '3D' THEN 'empirical_pending' END AS benchmark_type FROM notifications GROUP BY notification_type""")
def _(t):
    counts = derived(t, "notifications").groupBy(F.col("notification_type").alias("from_stage")).agg(F.count(F.lit(1)).alias("notifications"))
    policy = reg.stage_policy(t.spark).select("from_stage", "stage_transition", "benchmark_type")
    return counts.join(F.broadcast(policy), "from_stage", "left")  # two policy rows
