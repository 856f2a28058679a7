"""Exact distinct counts beside sums, on odd rows, and their plans."""

import pandas as pd
import numpy as np

from landpulse.operators import features as ft

SCHEMA = "project_id bigint, village string, district string, land_nature string, land_category string, land_type string, area_hectares double"


def test_distinct_counts_agree_with_sets(spark):
    rng = np.random.default_rng(4)
    pick = lambda n, names: [None if v == len(names) else names[v] for v in rng.integers(0, len(names) + 1, n)]
    n = 600
    frame = pd.DataFrame({
        "project_id": pick(n, [1, 2, 3]), "village": pick(n, [f"v{k}" for k in range(40)]), "district": pick(n, ["d1", "", "d2"]), "land_nature": pick(n, ["Private", "Government"]),
        "land_category": pick(n, ["Urban", "Rural"]), "land_type": pick(n, ["Wet", "Dry"]), "area_hectares": [None if k % 9 == 0 else float(k % 13) for k in range(n)]})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    rows = [(None if r[0] is None else int(r[0]), *r[1:]) for r in rows] + [(9, None, None, None, None, None, None)]
    out = ft.survey_features(spark.createDataFrame(rows, SCHEMA))
    got = {r["project_id"]: r for r in out.collect()}
    assert set(got) == {None, 1, 2, 3, 9}
    for project, row in got.items():
        own = [r for r in rows if r[0] == project]
        assert (row["survey_count"], row["village_count"], row["district_count"]) == (len(own), len({r[1] for r in own} - {None}), len({r[2] for r in own} - {None}))
        assert (row["urban_survey_count"], row["wet_survey_count"]) == (sum(r[4] == "Urban" for r in own), sum(r[5] == "Wet" for r in own))
        assert abs(row["surveyed_area_ha"] - sum(r[6] or 0 for r in own)) < 1e-9
        assert abs(row["private_area_ha"] - sum(r[6] or 0 for r in own if r[3] == "Private")) < 1e-9
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_without_a_manifest_the_surveyed_projects_stand(spark):
    surveys = spark.createDataFrame([(1, "v", "d", "Private", "Urban", "Wet", 2.0), (2, "w", "d", None, None, None, None)], SCHEMA)
    parties = spark.createDataFrame([(1, "Owner", "3.5")], "project_id bigint, party_type string, party_area_hectares string")
    manifest = spark.createDataFrame([("1", "one"), ("1", "one"), ("7", "seven")], "project_id string, project_name string")
    whole = {r["project_id"]: r for r in ft.assemble_features(manifest, surveys, parties).collect()}
    assert set(whole) == {1, 7} and whole[7]["survey_count"] == 0 and whole[7]["surveyed_area_ha"] is None and whole[1]["owner_record_count"] == 1
    alone = {r["project_id"]: r for r in ft.assemble_features(manifest.limit(0), surveys, parties).collect()}
    assert set(alone) == {1, 2} and alone[1]["survey_count"] == 1 and alone[2]["surveyed_area_ha"] == 0.0
