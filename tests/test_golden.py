"""The shipped sample: 18 notifications of five projects and every table that follows from them."""

import datetime as dt

import pytest

from landpulse.operators import timeline as tl

# Project, notification, type, date.
SAMPLE = """
54635 50840 3a 2017-05-17
54635 44531 3A 2017-09-18
54635 45887 3A 2017-11-17
54635 52358 3a 2018-05-17
54635 34193 3D 2018-09-28
54635 35100 3D 2018-11-15
54635 58267 3a 2021-09-15
54635 56691 3A 2021-11-15
54635 44312 3D 2022-03-24
59362 56361 3a 2020-02-11
60432 59173 3a 2023-10-12
60681 59791 3a 2004-05-19
60681 59817 3a 2004-05-19
60681 60106 3A 2005-04-13
60681 46246 3D 2005-11-10
61053 60885 3a 2023-10-11
61053 67707 3A 2024-03-06
61053 54973 3D 2024-06-14
"""
CYCLES = {
    (54635, 1, "2017-05-17", "2018-11-15", 547, 6, "3D", "COMPLETED"), (54635, 2, "2021-09-15", "2022-03-24", 190, 3, "3D", "COMPLETED"),
    (59362, 1, "2020-02-11", "2020-02-11", 0, 1, "3a", "OPEN"), (60432, 1, "2023-10-12", "2023-10-12", 0, 1, "3a", "OPEN"),
    (60681, 1, "2004-05-19", "2005-11-10", 540, 4, "3D", "COMPLETED"), (61053, 1, "2023-10-11", "2024-06-14", 247, 3, "3D", "COMPLETED"),
}
TRANSITIONS = {
    (54635, 1, "3a_to_3A", 124, 50840, 44531), (54635, 2, "3a_to_3A", 61, 58267, 56691), (54635, 2, "3A_to_3D", 129, 56691, 44312),
    (60681, 1, "3a_to_3A", 329, 59817, 60106), (60681, 1, "3A_to_3D", 211, 60106, 46246), (61053, 1, "3a_to_3A", 147, 60885, 67707),
    (61053, 1, "3A_to_3D", 100, 67707, 54973),
}
TIMELINES = {
    (54635, "3D", 44312, 3, 3, 3, 124, 375, 499, 1772), (59362, "3a", 56361, 1, 0, 0, None, None, None, 0),
    (60432, "3a", 59173, 1, 0, 0, None, None, None, 0), (60681, "3D", 46246, 2, 1, 1, 329, 211, 540, 540),
    (61053, "3D", 54973, 1, 1, 1, 147, 100, 247, 247),
}
HOT = [10**6, 2]  # plain windows only; every project of two or more events sliced


@pytest.fixture(scope="module")
def notes(spark):
    rows = [tuple(line.split()) + ("N", "Published") for line in SAMPLE.split("\n") if line]
    raw = spark.createDataFrame(rows, "project_id string, notification_id string, notification_type string, publish_date string, "
                                      "notification_number string, status string")
    return tl.normalise_notifications(raw).cache()


def rows(df, *columns):
    return {tuple(str(v) if isinstance(v, dt.date) else v for v in r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("hot", HOT)
def test_cycles(notes, hot):
    summary = tl.cycle_summary(tl.acquisition_cycles(notes, hot))
    assert rows(summary, "project_id", "cycle_number", "cycle_start_date", "cycle_last_event_date", "cycle_duration_days",
                "cycle_event_count", "latest_cycle_stage", "cycle_status") == CYCLES


@pytest.mark.parametrize("hot", HOT)
def test_transitions(notes, hot):
    seen = tl.transition_observations(notes, hot)
    assert rows(seen, "project_id", "cycle_number", "transition", "duration_days", "start_notification_id", "end_notification_id") == TRANSITIONS


def test_project_timeline(notes):
    assert rows(tl.project_timeline(notes), "project_id", "latest_event_stage", "latest_notification_id", "notification_count_prelim",
                "notification_count_decl", "notification_count_award", "days_prelim_to_decl", "days_decl_to_award",
                "days_prelim_to_award", "timeline_span_days") == TIMELINES


@pytest.mark.parametrize("hot", HOT)
def test_snapshots(notes, hot):
    snapshots = tl.project_snapshots(notes, hot)
    got = rows(snapshots.filter("project_id = 54635"), "snapshot_id", "current_stage", "days_in_current_stage", "days_since_previous_event")
    assert ("54635_20170918_002", "3A", 0, 124) in got
    assert ("54635_20171117_003", "3A", 60, 60) in got
    assert ("54635_20180517_004", "3A", 241, 181) in got
    assert ("54635_20220324_009", "3D", 1273, 129) in got
    assert tl.duplicate_snapshot_ids(snapshots).first()["duplicate_snapshot_ids"] == 0
    assert tl.backward_transitions(snapshots, hot_rows=hot).count() == 0


def test_no_contiguity_errors(notes):
    assert tl.cycle_contiguity(tl.acquisition_cycles(notes)).count() == 0
