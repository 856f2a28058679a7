"""The dashboard's one table against the single answers, on odd rows, and its plans."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from landpulse.operators import risk as rk
from landpulse.plans import risk as plans
from landpulse.plans.registry import Tables

SCHEMA = "state string, current_stage string, implementing_agency string, risk_band string, risk_90d double, snapshot_date date"
ROWS = [("A", "3a", "X", "HIGH", 45.0), ("A", "3D", None, "LOW", 3.0), ("A", None, "X", "CRITICAL", 90.0), ("", "3A", "", "MODERATE", None), (None, "", "Y", None, 1.0),
        ("B", "other", "Y", "CRITICAL", 70.5), ("Unknown", "3a", "Z", "LOW", 0.0)]


def listed(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_one_table_gives_the_single_answers(spark):
    scored = spark.createDataFrame([(*r, None) for r in ROWS], SCHEMA).withColumn("snapshot_date", F.to_date(F.lit("2024-05-06")))
    table = rk.dashboard(scored).cache()
    for whole, single in ((rk.kpis_of, rk.national_kpis), (rk.states_of, rk.projects_by_state), (rk.stages_of, rk.projects_by_stage), (rk.agencies_of, rk.projects_by_agency),
                          (rk.distribution_of, rk.risk_distribution), (rk.state_matrix_of, rk.state_risk_matrix), (rk.stage_risk_of, rk.stage_risk), (rk.state_stages_of, rk.state_stage_matrix)):
        assert listed(whole(table)) == listed(single(scored)), single.__name__
    kpis = rk.kpis_of(table).first()
    assert (kpis["total_projects"], kpis["ongoing_projects"], kpis["critical"], kpis["last_updated"]) == (7, 5, 2, "2024-05-06")
    states = {r["state"]: r for r in rk.states_of(table).collect()}
    assert states["A"]["ongoing_projects"] == 2 and states["A"]["critical_projects"] == 0 and states["A"]["average_90d_risk"] == 24.0
    assert states["Unknown"]["ongoing_projects"] == 2  # no state, and one that is called so
    assert {r["state"]: r["total"] for r in rk.state_stages_of(table).collect()} == {"A": 3, "B": 1, "Unknown": 1}
    assert [(r["stage"], r["projects"]) for r in rk.stage_risk_of(table).orderBy("stage").collect()] == [("3A", 1), ("3D", 1), ("3a", 2)]


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rk.national_kpis(empty).first()["total_projects"] == 0 and rk.dashboard(empty).count() == 0
    assert {r["projects"] for r in rk.projects_by_stage(empty).collect()} == {0} and rk.projects_by_state(empty).count() == 0


def test_answers_read_the_stored_table_only(spark):
    folder = "/root/testdata/sf0.001"
    stored = plans.table(Tables(spark, folder)).inputFiles()
    for name in ("r16_national_kpis", "r17_projects_by_state", "r19_projects_by_agency", "r21_state_risk_matrix", "r25_stage_risk", "r27_state_stage_matrix", "r29_band_shares"):
        assert set(contract.queries()[name](spark, folder).inputFiles()) == set(stored), name
