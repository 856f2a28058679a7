import gzip

import pytest
from pyspark.sql import functions as F

from landpulse import schemas
from landpulse.operators import features as ft, risk as rk, timeline as tl
from landpulse.operators.contracts import forbid_columns, require_columns, require_unique, require_values
from landpulse.sources import registry as reg, sinks
from landpulse.streaming import intake

HEADER = "project_id,notification_id,notification_type,serial_number,publish_date,notification_number,status,details_url,objections_url\n"


@pytest.fixture()
def folder(tmp_path):
    for project, lines in {"1": ['1,10,3a,1,2020-01-01,"S.O. ""5"" (E)",Open,,', "1,11,3A,2,bad,6,Open,,"], "2": [], "3": ["x,12,3D,1,2021-05-06,7,,,"]}.items():
        (tmp_path / project).mkdir()
        text = "﻿" + HEADER + "".join(line + "\n" for line in lines)
        (tmp_path / project / "notifications.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_glob_scan(spark, folder):
    table = reg.read_registry_table(spark, f"{folder}/*/notifications.csv", schemas.NOTIFICATIONS)
    rows = {r["notification_id"]: r for r in table.collect()}
    assert set(rows) == {10, 11, 12}
    assert rows[10]["notification_number"] == 'S.O. "5" (E)' and rows[11]["publish_date"] is None and rows[12]["project_id"] is None
    assert tl.normalise_notifications(table).count() == 2


def test_columns_are_read_by_header_name(spark, tmp_path):
    files = {
        "a": "notification_id,project_id,notification_type\n7,54635.0,3a\n", "b": "project_id,notification_type,publish_date,extra\n8,3A,2020-01-01,z\n",
        "c": "project_id,notification_id,notification_type\n", "d": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "e.csv.gz").write_bytes(b"not a gzip file")
    rows = {tuple(r) for r in reg.lenient_types(reg.scan_csv_files(spark, f"{tmp_path}/*.csv*", schemas.NOTIFICATIONS)).select(
        "project_id", "notification_id", "notification_type").collect()}
    assert rows == {(54635, 7, "3a"), (8, None, "3A")}
    assert [r["path"].rsplit("/", 1)[1] for r in reg.skipped_files(spark, f"{tmp_path}/*.csv*").collect()] == ["e.csv.gz"]
    with pytest.raises(ValueError, match="notification_id"):
        reg.scan_csv_files(spark, f"{tmp_path}/*.csv*", schemas.NOTIFICATIONS, required=["notification_id"])


def test_missing_file_and_contracts(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reg.read_text_csv(spark, f"{folder}/none.csv", schemas.SANCTIONS).count()
    df = spark.createDataFrame([(1,), (1,)], "project_id int")
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["project_id", "other"])
    with pytest.raises(ValueError, match="forbidden"):
        forbid_columns(["a", "delay_next_30d"], ["delay_next_30d"])
    with pytest.raises(ValueError, match="duplicate"):
        require_unique(df, ["project_id"])
    with pytest.raises(Exception, match="duplicate"):
        ft.project_master(df, df).collect()
    with pytest.raises(ValueError, match="invalid"):
        require_values(spark.createDataFrame([(None,), (1,)], "event_date int"), ["event_date"], "events")


def test_partitioned_sink(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("project_id"), "id")
    sinks.write_partitioned(df, f"{tmp_path}/out", ["project_id"])
    back = spark.read.option("header", "true").csv(f"{tmp_path}/out")
    assert back.count() == 100 and back.select("project_id").distinct().count() == 3


def test_scenarios_are_checked(spark):
    with pytest.raises(ValueError, match="not editable"):
        rk.valid_scenarios(spark.createDataFrame([("P", 1)], "project_id string, total_parcels int"))
    asked = spark.createDataFrame([("a", 50.0), ("b", 101.0), ("c", None)], "project_id string, docs_complete_pct double")
    assert [r["project_id"] for r in rk.valid_scenarios(asked).collect()] == ["a"]


def test_zero_is_a_value_for_action_rules(spark):
    row = spark.createDataFrame([("p", "s", 0.0, None)], "project_id string, snapshot_id string, docs_complete_pct double, rnr_progress_pct double")
    fields = ["pending_approvals_count", "file_pending_days", "disbursal_pct", "compensation_awarded_cr", "court_cases_count", "grievances_30d",
              "grievance_redressal_days", "days_in_current_stage"]
    got = rk.recommended_actions(row.withColumns({f: F.lit(None).cast("double") for f in fields})).collect()
    assert [(r["action"], r["priority"], r["trigger"]) for r in got] == [
        ("Complete missing acquisition documentation.", "HIGH", "docs_complete_pct = 0%")]


def test_bands_and_trend(spark):
    values = [-0.5, 0.0, 0.1999, 0.2, 0.4, 0.7, 1.0, 1.5, None]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in df.select(rk.risk_band(F.col("p"))).collect()] == [
        "LOW", "LOW", "LOW", "MODERATE", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL", None]
    trends = spark.createDataFrame([(0.1, 0.2, 0.35), (0.5, None, 0.1), (None, 0.2, None), (0.1, 0.2, None)], "a double, b double, c double")
    assert [r[0] for r in trends.select(rk.risk_trend([F.col("a"), F.col("b"), F.col("c")])).collect()] == ["RISING", "FALLING", "UNKNOWN", "STABLE"]


def test_intake_stream(spark, folder, tmp_path):
    counts = intake.stage_counts(intake.notification_stream(spark, f"{folder}/*"))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("intake").option(
        "checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("intake").collect()} == {("3a", 1), ("3A", 1)}


def test_headers_do_not_cost_a_second_reading(spark, tmp_path):
    """Bytes that the JVM reads from files while ten files are scanned by their headers."""
    lines = "".join(f"{k},{k},3a,1,2020-01-01,{'n' * 40},Open,,\n" for k in range(20_000))
    for k in range(10):
        (tmp_path / f"{k}.csv").write_text(HEADER + lines)
    size = sum(f.stat().st_size for f in tmp_path.glob("*.csv"))
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
    read = lambda: sum(s.getBytesRead() for s in statistics())
    before = read()
    layouts = reg.csv_layouts(spark, f"{tmp_path}/*.csv")
    headers = read() - before
    assert [len(files) for _, files in layouts] == [10] and headers < 0.1 * size
    before = read()
    reg.scan_csv_files(spark, f"{tmp_path}/*.csv", schemas.NOTIFICATIONS).write.format("noop").mode("overwrite").save()
    assert 0.9 * size < read() - before < 1.5 * size


def test_headers_of_packed_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"project_id,status\n1,Open\n"))
    (tmp_path / "b c.csv").write_bytes("project_id,status\r\n2,Zu ä\r\n".encode())
    (tmp_path / "d.csv").write_bytes(b"project_id,status")
    rows = {tuple(r) for r in reg.scan_csv_files(spark, f"{tmp_path}/*", "project_id string, status string").collect()}
    assert rows == {("1", "Open"), ("2", "Zu ä")}
    assert reg.skipped_files(spark, f"{tmp_path}/*").collect() == []
