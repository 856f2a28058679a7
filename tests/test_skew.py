"""Slicing hot keys must not change a single row, and cycles must follow their step-by-step definition."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.operators import extraction as ex, quality as q, skew, timeline as tl
from landpulse.plans import load
from landpulse.plans.registry import QUERIES

KINDS = ["3a", "3A", "3D", "survey", ""]


def random_events(seed, n=400, projects=6):
    rng = random.Random(seed)
    start = dt.date(2020, 1, 1)
    # One project holds about a third of all events, several of them on one day.
    owners = [0 if rng.random() < 0.34 else rng.randrange(1, projects) for _ in range(n)]
    return [
        (p, i * 7 % 1009 + 1009 * i, rng.choice(KINDS), start + dt.timedelta(days=rng.choice([0, 5, rng.randrange(200)])), "n", "s")
        for i, p in enumerate(owners)
    ]


def frame(spark, events):
    return spark.createDataFrame(
        events, "project_id long, notification_id long, notification_type string, publish_date date, notification_number string, status string")


def same(a, b):
    columns = a.columns
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_sliced_equals_plain(spark, seed):
    notes = frame(spark, random_events(seed)).cache()
    for operator in (tl.event_timeline, tl.observed_events, tl.project_snapshots, tl.acquisition_cycles, tl.transition_observations):
        assert same(operator(notes), operator(notes, 30)), operator.__name__
    snapshots = tl.project_snapshots(notes).cache()
    assert same(tl.backward_transitions(snapshots, "event_type"), tl.backward_transitions(snapshots, "event_type", 30))
    assert same(q.cadence_checks(snapshots), q.cadence_checks(snapshots, 20))
    grants = notes.select("project_id", F.concat(F.lit("SN"), "notification_id").alias("sanction_number"),
                          F.col("publish_date").alias("sanction_date"), F.lit(1.0).alias("sanction_amount_rs"))
    assert same(tl.unified_timeline(notes, grants), tl.unified_timeline(notes, grants, 30))
    gaps = tl.acquisition_cycles(notes).filter("event_type = '3A'")
    assert same(tl.cycle_contiguity(gaps), tl.cycle_contiguity(gaps, 2))


def walk(events):
    """Cycles of one project, event by event."""
    number, completed, sequence, start, out = 0, False, 0, None, []
    for _, ident, kind, day, *_ in sorted(events, key=lambda e: (e[3], e[1])):
        if number == 0 or (kind == "3a" and completed):
            number, completed, sequence, start = number + 1, False, 0, day
        sequence += 1
        completed = completed or kind == "3D"
        out.append((ident, number, sequence, (day - start).days, "COMPLETED" if completed else "OPEN"))
    return out


@pytest.mark.parametrize("hot", [10**6, 25])
def test_cycles_follow_the_state_machine(spark, hot):
    events = [e for seed in range(5) for e in [(r[0] + 10 * seed, *r[1:]) for r in random_events(seed, 150)]]
    expected = {row for p in {e[0] for e in events} for row in ((p, *r) for r in walk([e for e in events if e[0] == p]))}
    got = tl.acquisition_cycles(frame(spark, events), hot).select(
        "project_id", "notification_id", "cycle_number", "cycle_event_sequence", "cycle_days_elapsed", "cycle_status")
    assert {tuple(r) for r in got.collect()} == expected


def test_all_hot_keys_count(spark):
    df = spark.createDataFrame([(k,) for k in range(5) for _ in range(k + 1)] + [(None,)] * 4, "k int")
    assert sorted(str(r["k"]) for r in skew.hot_keys(df, ["k"], 3).collect()) == ["2", "3", "4", "None"]


def test_many_hot_keys_outlying_ids_and_a_null_key(spark):
    rows = [(k if k else None, i * 3 + k, "3a", dt.date(2020, 1, 1), "n", "s") for k in range(1300) for i in range(3)]
    rows += [(7, 10**15, "3A", dt.date(2020, 1, 1), "n", "s"), (7, -(10**15), "3D", dt.date(2020, 1, 1), "n", "s")]
    df = frame(spark, rows).withColumnRenamed("publish_date", "event_date")
    window = lambda hot: skew.scan_by_key(
        df, ["project_id"], ["event_date", "notification_id"], lambda x, apply: apply(x, {"n": skew.running_count(), "before": skew.previous(F.col("notification_id"))}),
        skew.date_id_slice("event_date", "notification_id"), skew.id_bounds("notification_id"), hot)
    assert same(window(10**6), window(2))


@pytest.mark.parametrize("merge_ranges", ["true", "false"])
def test_positions_and_quantiles(spark, merge_ranges):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge_ranges)
    try:
        check_positions_and_quantiles(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_positions_and_quantiles(spark):
    rng = np.random.default_rng(7)
    values = {g: rng.integers(0, 40, 500) * 0.25 for g in ("a", "b")}
    values["a"][:200] = 3.0  # one value on a large share of the rows
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["probability"]): r["quantile"] for r in skew.exact_quantiles(df, ["g"], "v", probabilities).collect()}
    for g, vs in values.items():
        for p in probabilities:
            assert got[g, p] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    ranked = skew.positions(df.withColumn("id", F.monotonically_increasing_id()), ["g"], [F.col("v").asc(), F.col("id").asc()])
    for g in values:
        assert sorted(r["before"] for r in ranked.filter(F.col("g") == g).collect()) == list(range(500))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join(spark, how):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)], "k int, v int")
    facts = spark.createDataFrame([(k, f"f{k}") for k in (0, 1, 2, 5)], "k int, f string")
    assert same(rows.join(facts, "k", how), skew.lookup(rows, facts, ["k"], how))


def test_party_and_detail_scans_sliced(spark):
    cells = [(1, 0, r, c, f"Project Name" if (r, c) == (3, 1) else f"v{r}{c}", None, None, None, None) for r in range(6) for c in range(2)]
    cells += [(1, 1, 2, None, t, None, None, 0, i) for i, t in enumerate(["Name", "Address", "Type", "Area"])]
    cells += [(1, 1, 2, None, t, None, None, n, i) for n in range(1, 9) for i, t in enumerate([f"p{n}", "", "Owner", f"{n} ha"])]
    df = spark.createDataFrame(cells, "page_id long, table_idx int, row_idx long, cell_idx int, cell_text string, href string, "
                                      "link_text string, nested_row_idx long, nested_cell_idx int")
    for hot in (10**6, 2):
        assert ex.project_details(df, hot).first()["project_name"] == "v40"
        parties = ex.party_rows(df, hot).orderBy("party_sequence").collect()
        assert [(r["row_idx"], r["party_sequence"], r["party_name"], r["party_area_hectares"]) for r in parties] == [
            (1, n, f"p{n}", float(n)) for n in range(1, 9)]


def test_rows_of_a_page_are_put_together_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "MANY_ROWS", 100)
    cells = spark.range(1600).select(
        F.when(F.col("id") < 1600, 5).otherwise(0).alias("table_idx"), F.expr("id div 8 + 2").alias("row_idx"), (F.col("id") % 8).cast("int").alias("cell_idx"),
        F.concat(F.lit(" c"), F.col("id").cast("string")).alias("cell_text"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("link_text"))
    cells = cells.withColumn("page_id", F.expr("row_idx % 3"))
    made = ex.consent_purchases(cells)
    assert made.rdd.getNumPartitions() == 16  # one task before, however many cells
    rows = made.collect()
    assert len(rows) == 200 and all(r["state"] == f"c{(r['row_idx'] - 2) * 8}" and r["disbursement_details"] == f"c{(r['row_idx'] - 2) * 8 + 7}" for r in rows)
    several = ex.report_sections(cells.withColumn("table_idx", F.col("table_idx") - 2))
    assert several.rdd.getNumPartitions() == 16 and several.count() == 200


def test_fits_side_by_side_share_the_cores(spark):
    rows = spark.range(0, 1000, 1, 12)
    assert skew.share(rows, 1000, 3).rdd.getNumPartitions() == 3  # 8 local cores
    assert skew.share(rows, 5 * skew.MANY_ROWS, 3).rdd.getNumPartitions() == 5
    assert skew.share(rows, 1000, 3).count() == 1000


def test_parties_are_numbered_in_the_pass_that_makes_them(spark, monkeypatch):
    cells = [(1, 1, 2 * k, None, t, None, None, 0, i) for k in (1, 2) for i, t in enumerate([" NAME :", "Address", "Type", "Area"])]
    cells += [(1, 1, 2 * k, None, t, None, None, n, i) for k in (1, 2) for n in range(1, 9) for i, t in enumerate([f"p{k}{n}", "", "Owner", f"{n} ha"])]
    df = spark.createDataFrame(cells, "page_id long, table_idx int, row_idx long, cell_idx int, cell_text string, href string, "
                                      "link_text string, nested_row_idx long, nested_cell_idx int")
    wanted = [(2 * k - 1, n, f"p{k}{n}") for k in (1, 2) for n in range(1, 9)]
    read = lambda rows: [(r["row_idx"], r["party_sequence"], r["party_name"]) for r in rows.orderBy("row_idx", "party_sequence").collect()]
    for hot in (9, 3):  # 32 cells, then 8 rows of a key reach the limit
        assert read(ex.party_rows(df, hot)) == wanted

    def stored(_):
        raise AssertionError("no key is hot, nothing has to be stored")

    monkeypatch.setattr(skew, "durable", stored)
    monkeypatch.setattr(ex, "durable", stored, raising=False)
    assert read(ex.party_rows(df, 33)) == wanted


def test_readiness_reads_a_stored_master(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "overall_readiness", lambda checks, master, features: seen.append(master) or checks.limit(1).select(
        F.lit(0).alias("warning_checks"), F.lit(0).alias("small_tables"), F.lit("x").alias("overall_status")))
    load()
    for name in ("q07_overall_readiness", "s08_quality_report"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(seen) == 2
    for master in seen:  # its joins ran a second time before
        assert "Join" not in master._jdf.queryExecution().analyzed().toString()
