"""Data-quality checks as tables (Q1-Q20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from landpulse.functions.literals import literal_table
from landpulse.operators import skew
from landpulse.operators.skew import HOT_ROWS

# Keywords, limits and rules of the quality reports.
LEAKAGE_WORDS = ["actual", "delay_days", "delayed", "outcome", "failed", "completion_date", "future"]
SMALLEST_READY_TABLE = 50
NOT_READY, READY = "NOT_READY_FOR_PRODUCTION_ML", "READY_FOR_NEXT_PIPELINE_STAGE"
INFINITY = float("inf")
RANGE_RULES = {
    "docs_complete_pct": (0, 100),
    "disbursal_pct": (0, 100),
    "rnr_progress_pct": (0, 100),
    "rnr_consent_pct": (0, 100),
    "pending_approvals_count": (0, INFINITY),
    "file_pending_days": (0, INFINITY),
    "court_cases_count": (0, INFINITY),
    "case_age_months": (0, INFINITY),
    "title_disputes_parcels": (0, INFINITY),
    "grievances_30d": (0, INFINITY),
    "days_in_current_stage": (0, INFINITY),
    "days_since_project_start": (0, INFINITY),
}
SNAPSHOT_INTERVAL_DAYS, FEWEST_SNAPSHOTS, MOST_SNAPSHOTS = 30, 8, 15
TARGETS = ["delay_next_30d", "delay_next_60d", "delay_next_90d"]
PROJECT_CHECKS = {
    "project_count": "Unique projects in project master",
    "duplicate_project_ids": "Project IDs should be unique in project master",
    "projects_with_3d_detail": "Projects with extracted 3D survey records",
    "projects_without_3d_detail": "Projects without extracted 3D survey records",
    "negative_acquisition_completion": "Acquisition completion below 0%",
    "acquisition_completion_above_100": "Acquisition completion above 100%",
    "3A_before_3a": "3A notification occurring before 3a notification",
    "possible_test_projects": "Projects whose name/number contains 'test'; review before ML training",
}
INFORMATION_CHECKS = ["project_count", "projects_with_3d_detail", "projects_without_3d_detail"]


def row_count() -> Column:
    return F.count(F.lit(1))


def as_checks(one_row: DataFrame, name: str = "check", value: str = "value") -> DataFrame:
    """Turn a one-row aggregate into (check, value) rows."""
    return one_row.select(*[F.col(f"`{c}`").cast("bigint").alias(c) for c in one_row.columns]).unpivot(
        [], [f"`{c}`" for c in one_row.columns], name, value
    )


def pass_or(bad: Column, otherwise: str) -> Column:
    return F.when(bad == 0, F.lit("PASS")).otherwise(F.lit(otherwise))


def dataset_summary(df: DataFrame, name: str) -> DataFrame:
    """Q1: size, missing cells and fully repeated rows; equal rows meet before the shuffle."""
    width = len(df.columns)
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    distinct = df.groupBy(*df.columns).agg(row_count().alias("__n"))
    n = F.col("__n")
    counted = distinct.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.coalesce(F.sum(missing * n), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
    )
    cells = F.col("rows") * width
    return counted.select(
        F.lit(name).alias("dataset"), "rows", F.lit(width).alias("columns"), cells.alias("total_cells"), "missing_cells",
        F.when(cells > 0, F.bround(F.col("missing_cells") / cells * 100, 4)).otherwise(0.0).alias("missing_pct"),
        "duplicate_rows",
    )


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """Q2: completeness, distinct values and share of the most frequent value per column.

    Values are counted per (column, value), combining before the shuffle, so a value on most rows costs little.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "v")
    counted = long.groupBy("column", "v").agg(row_count().alias("n"))
    present = F.when(F.col("v").isNotNull(), F.col("n"))
    profile = counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("v").alias("unique_values"), F.coalesce(F.max(present), F.lit(0)).alias("most"),
    )
    rows, filled = F.col("rows"), F.col("rows") - F.col("missing_count")
    types = F.create_map(*[F.lit(v) for pair in df.dtypes for v in pair])
    return profile.select(
        F.lit(name).alias("dataset"), "column", types[F.col("column")].alias("dtype"), "rows", "missing_count",
        F.bround(F.col("missing_count") / rows * 100, 4).alias("missing_pct"), "unique_values",
        F.bround(filled / rows * 100, 4).alias("completeness_pct"),
        F.coalesce(F.bround(F.try_divide(F.col("most"), filled) * 100, 4), F.lit(0.0)).alias("dominant_value_pct"),
    )


def _mentions_test(df: DataFrame) -> Column:
    names = [c for c in ("project_name", "project_number") if c in df.columns]
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains("test") for c in names])


def project_checks(master: DataFrame) -> DataFrame:
    """Q3: (check, value, status, description) rows from one pass over the project master."""
    completion, surveys = F.col("acquisition_completion_pct"), F.coalesce(F.col("survey_count"), F.lit(0))
    ids = F.countDistinct("project_id")
    counted = master.agg(
        ids.alias("project_count"), (F.count("project_id") - ids).alias("duplicate_project_ids"),
        F.count_if(surveys > 0).alias("projects_with_3d_detail"), F.count_if(surveys == 0).alias("projects_without_3d_detail"),
        F.count_if(completion < 0).alias("negative_acquisition_completion"),
        F.count_if(completion > 100).alias("acquisition_completion_above_100"),
        F.count_if(F.col("first_decl_date") < F.col("first_prelim_date")).alias("3A_before_3a"),
        F.count_if(_mentions_test(master)).alias("possible_test_projects"),
    )
    checks = as_checks(counted)
    described = F.create_map(*[F.lit(v) for pair in PROJECT_CHECKS.items() for v in pair])
    status = F.when(F.col("check").isin(*INFORMATION_CHECKS), F.lit("INFO")).otherwise(pass_or(F.col("value"), "WARNING"))
    return checks.select("check", "value", status.alias("status"), described[F.col("check")].alias("description"))


def detected_test_projects(master: DataFrame) -> DataFrame:
    """Q4: projects whose name or number contains 'test' in any case."""
    return master.filter(_mentions_test(master)).select("project_id", "project_name", "project_number")


def feature_variation(features: DataFrame, key: str = "project_id") -> DataFrame:
    """Q5: columns with at most two distinct values."""
    columns = [c for c in features.columns if c != key]
    text = features.select(*[F.col(c).cast("string").alias(c) for c in columns])
    # A third value lies strictly between the least and the greatest, which are one row.
    bounds = text.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"__{c}") for c in columns])
    tested = text.join(F.broadcast(bounds)).agg(*[
        F.struct(F.first(f"__{c}.low").alias("low"), F.first(f"__{c}.high").alias("high"),
                 F.count_if((F.col(c) > F.col(f"__{c}.low")) & (F.col(c) < F.col(f"__{c}.high"))).alias("between")).alias(c) for c in columns])
    long = tested.unpivot([], columns, "column", "v")
    counted = long.withColumn("unique_values", F.when(F.col("v.low").isNull(), 0).when(F.col("v.low") == F.col("v.high"), 1).otherwise(2).cast("bigint"))
    issue = F.when(F.col("unique_values") <= 1, F.lit("NO_VARIATION")).otherwise(F.lit("LOW_VARIATION"))
    return counted.filter("v.between = 0").select("column", "unique_values", issue.alias("issue"))


def leakage_candidates(df: DataFrame) -> DataFrame:
    """Q6: columns whose name hints at the future, with how many rows carry a value there."""
    suspects = [c for c in df.columns if any(word in c.lower() for word in LEAKAGE_WORDS)]
    if not suspects:
        return literal_table(df.sparkSession, [], "column string, filled_rows bigint")
    return as_checks(df.agg(*[F.count(F.col(c)).alias(c) for c in suspects]), "column", "filled_rows")


def overall_readiness(checks: DataFrame, master: DataFrame, features: DataFrame) -> DataFrame:
    """Q7: not ready when any check warns or a table has fewer than 50 rows."""
    sizes = master.agg(row_count().alias("n")).unionAll(features.agg(row_count().alias("n")))
    small = sizes.agg(F.count_if(F.col("n") < SMALLEST_READY_TABLE).alias("small_tables"))
    warned = checks.agg(F.count_if(F.col("status") == "WARNING").alias("warning_checks"))
    both = warned.withColumn("small_tables", small.scalar())
    total = F.col("warning_checks") + F.col("small_tables")
    return both.select("warning_checks", "small_tables",
                         F.when(total > 0, F.lit(NOT_READY)).otherwise(F.lit(READY)).alias("overall_status"))


def bundle_checks(tables: dict[str, DataFrame], required: dict[str, list[str]], numeric: dict[str, list[str]]) -> DataFrame:
    """Q8: per table: rows, missing required fields and unreadable numbers, as PASS or ERROR rows."""
    parts = []
    for name, table in tables.items():
        absent = [c for c in required.get(name, []) if c not in table.columns]
        unreadable = [F.count_if(F.col(c).cast("string").try_cast("double").isNull()) for c in numeric.get(name, [])]
        parts.append(table.agg(row_count().alias("rows"), sum(unreadable, F.lit(0)).cast("bigint").alias("unreadable_numbers")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(absent)).alias("missing_fields"), "unreadable_numbers",
            F.when((F.col("rows") == 0) | F.lit(bool(absent)) | (F.col("unreadable_numbers") > 0), F.lit("ERROR"))
            .otherwise(F.lit("PASS")).alias("status"),
        ))
    return reduce(DataFrame.unionAll, parts)


def sanction_totals(sanctions: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Q9: sanctioned total per project against ``expected`` (project_id, expected_rows, expected_total_rs)."""
    money = F.col("sanction_amount_rs").cast("decimal(18,2)")
    actual = sanctions.groupBy("project_id").agg(row_count().alias("sanction_rows"), F.sum(money).alias("total_rs"))
    joined = actual.join(expected, "project_id", "full")
    close = F.abs(F.col("total_rs") - F.col("expected_total_rs")) < tolerance
    same = F.coalesce(F.col("sanction_rows") == F.col("expected_rows"), F.lit(False))
    return joined.select(
        "project_id", F.coalesce("sanction_rows", F.lit(0)).alias("sanction_rows"), F.col("total_rs").cast("double").alias("total_rs"),
        F.when(same, "PASS").otherwise("WARN").alias("row_check"),
        F.when(F.coalesce(close, F.lit(False)), "PASS").otherwise("WARN").alias("total_check"),
    )


def notification_checks(notifications: DataFrame, expected: DataFrame) -> DataFrame:
    """Q10: duplicate keys, blanks, unknown types and the id set against ``expected`` (notification_id)."""
    key = ["project_id", "notification_type", "notification_id"]
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    by_key = notifications.groupBy(*key).agg(
        row_count().alias("n"), F.count_if(blank("publish_date")).alias("no_date"), F.count_if(blank("status")).alias("no_status")
    )
    counted = by_key.agg(
        F.sum("n").alias("notifications"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.sum("no_date").alias("blank_publish_dates"), F.sum("no_status").alias("blank_statuses"),
    )
    ids = by_key.select("notification_id").distinct().withColumn("here", F.lit(1))
    wanted = expected.select("notification_id").distinct().withColumn("there", F.lit(1))
    sets = ids.join(wanted, "notification_id", "full").agg(
        F.count_if(F.col("here").isNull()).alias("missing_ids"), F.count_if(F.col("there").isNull()).alias("unexpected_ids")
    )
    checks = as_checks(counted).unionAll(as_checks(sets))
    status = (
        F.when(F.col("check") == "notifications", "INFO")
        .when(F.col("value") == 0, "PASS")
        .when(F.col("check").isin("blank_statuses", "unexpected_ids"), "WARN")
        .otherwise("ERROR")
    )
    return checks.withColumn("status", status)


def type_counts(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Q10 and Q11: rows per value of ``column`` against ``expected`` (value, expected_count)."""
    actual = df.groupBy(F.col(column).alias("value")).agg(row_count().alias("actual_count"))
    zero = F.lit(0).cast("bigint")
    joined = actual.join(expected, "value", "full").select(
        "value", F.coalesce("actual_count", zero).alias("actual_count"), F.coalesce("expected_count", zero).alias("expected_count")
    )
    return joined.withColumn("status", F.when(F.col("actual_count") == F.col("expected_count"), "PASS").otherwise("ERROR"))


def survey_checks(surveys: DataFrame, parties: DataFrame, expected: DataFrame) -> DataFrame:
    """Q11: rows and area per notification against ``expected`` (notification_id, expected_surveys, expected_area).

    Party areas that are missing must keep their raw text 'Hectares'; any other raw value is reported.
    """
    parcels = surveys.groupBy("notification_id").agg(row_count().alias("surveys"), F.sum("area_hectares").alias("area_ha"))
    missing = F.col("party_area_hectares").isNull()
    people = parties.groupBy("notification_id").agg(
        row_count().alias("parties"), F.count_if(missing).alias("missing_party_areas"),
        F.count_if(missing & (F.coalesce(F.col("party_area_raw"), F.lit("")) != "Hectares")).alias("unexpected_raw_values"),
        F.sum("party_area_hectares").alias("party_area_ha"),
    )
    joined = expected.join(parcels, "notification_id", "full").join(people, "notification_id", "full")
    same_rows = F.coalesce(F.col("surveys") == F.col("expected_surveys"), F.lit(False))
    same_area = F.coalesce(F.abs(F.col("area_ha") - F.col("expected_area")) < 0.000001, F.lit(False))
    return joined.fillna(0, subset=["surveys", "parties", "missing_party_areas", "unexpected_raw_values"]).select(
        "notification_id", "surveys", "area_ha", "parties", "missing_party_areas", "unexpected_raw_values", "party_area_ha",
        F.when(same_rows, "PASS").otherwise("ERROR").alias("count_check"),
        F.when(same_area, "PASS").otherwise("WARN").alias("area_check"),
        F.when(F.col("unexpected_raw_values") == 0, "PASS").otherwise("WARN").alias("raw_check"),
    )


def referential_checks(tables: dict[str, DataFrame], notifications: DataFrame) -> DataFrame:
    """Q12: per table, notification ids that no notification has."""
    known = notifications.select("notification_id").distinct()
    parts = []
    for name, table in tables.items():
        orphans = table.groupBy("notification_id").agg(row_count().alias("n")).join(known, "notification_id", "left_anti")
        parts.append(orphans.agg(row_count().alias("orphan_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")).select(
            F.lit(name).alias("dataset"), "orphan_ids", "orphan_rows", pass_or(F.col("orphan_ids"), "ERROR").alias("status")
        ))
    return reduce(DataFrame.unionAll, parts)


def range_checks(snapshots: DataFrame) -> DataFrame:
    """Q13: values outside their allowed range, null included."""
    def invalid(column: str, low: float, high: float) -> Column:
        value = F.col(column).cast("double")
        inside = (value >= low) if high == INFINITY else value.between(low, high)
        return F.count_if(~F.coalesce(inside, F.lit(False))).alias(column)

    counted = snapshots.agg(*[invalid(c, low, high) for c, (low, high) in RANGE_RULES.items()])
    return as_checks(counted, "column", "invalid").withColumn("status", pass_or(F.col("invalid"), "FAIL"))


def cadence_checks(snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Q14: projects with repeated dates, gaps other than 30 days, projects outside 8-15 snapshots."""
    per_day = snapshots.groupBy("project_id", "snapshot_date").agg(row_count().alias("n"))
    scanned = skew.scan_by_key(
        per_day, ["project_id"], ["snapshot_date"],
        lambda rows, apply: apply(rows, {"previous": skew.previous(F.col("snapshot_date"))}),
        F.coalesce(F.unix_date("snapshot_date"), F.lit(10_000_000)).cast("bigint"), None, hot_rows,
    )
    gap = F.datediff("snapshot_date", "previous")
    per_project = scanned.groupBy("project_id").agg(
        F.max("n").alias("most_per_day"), F.sum("n").alias("snapshots"),
        (F.count_if(gap != SNAPSHOT_INTERVAL_DAYS) + F.sum(F.col("n") - 1)).alias("odd_gaps"),
    )
    counts = F.col("snapshots")
    return as_checks(per_project.agg(
        F.count_if(F.col("most_per_day") > 1).alias("unordered_projects"),
        F.coalesce(F.sum("odd_gaps"), F.lit(0)).alias("interval_issues"),
        F.count_if(~counts.between(FEWEST_SNAPSHOTS, MOST_SNAPSHOTS)).alias("projects_outside_snapshot_range"),
    )).withColumn("status", pass_or(F.col("value"), "FAIL"))


def label_monotonicity(snapshots: DataFrame) -> DataFrame:
    """Q15: a delay within 30 days is one within 60, and within 90."""
    d30, d60, d90 = (F.col(t) for t in TARGETS)
    return as_checks(snapshots.agg(
        F.count_if((d30 == 1) & (d60 == 0)).alias("30d_without_60d"), F.count_if((d60 == 1) & (d90 == 0)).alias("60d_without_90d")
    )).withColumn("status", pass_or(F.col("value"), "FAIL"))


def label_distribution(snapshots: DataFrame) -> DataFrame:
    """Q16: positives and negatives per label."""
    long = snapshots.select(*TARGETS).unpivot([], TARGETS, "target", "y")
    grouped = long.groupBy("target").agg(F.sum("y").alias("positive"), row_count().alias("rows"))
    positive, rows = F.col("positive"), F.col("rows")
    return grouped.select("target", "positive", (rows - positive).alias("negative"), (positive / rows * 100).alias("positive_pct"))


def group_means(snapshots: DataFrame, groups: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Q17: feature means per project group; ``groups`` has one row per project."""
    joined = skew.lookup(snapshots.select("project_id", *features), groups.select("project_id", group), ["project_id"])
    return joined.groupBy(group).agg(row_count().alias("snapshot_count"), *[F.avg(f).alias(f"{f}_mean") for f in features])


def group_sanity(means: DataFrame, group: str, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Q17: compare one group's mean to another's; rules are (name, feature, group, '>' or '<', other group)."""
    def pick(feature: str, name: str) -> Column:
        return F.max(F.when(F.col(group) == name, F.col(f"{feature}_mean")))

    def holds(feature: str, one: str, sign: str, other: str) -> Column:
        a, b = pick(feature, one), pick(feature, other)
        return F.coalesce((a > b) if sign == ">" else (a < b), F.lit(False)).cast("bigint")

    outcome = means.agg(*[holds(f, a, sign, b).alias(name) for name, f, a, sign, b in rules])
    passed = F.when(F.col("holds") == 1, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return as_checks(outcome, "check", "holds").select("check", passed.alias("status"))


def outcome_consistency(outcomes: DataFrame) -> DataFrame:
    """Q18: delayed projects have a first delay day, others have none."""
    day = F.col("first_delay_day")
    return as_checks(outcomes.agg(
        F.count_if((F.col("delayed") == 1) & day.isNull()).alias("delayed_without_day"),
        F.count_if((F.col("delayed") == 0) & day.isNotNull()).alias("not_delayed_with_day"),
    )).withColumn("status", pass_or(F.col("value"), "FAIL"))


def duplicate_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Q19: repeated ids of several tables."""
    parts = []
    for name, (table, key) in tables.items():
        counted = table.groupBy(key).agg(row_count().alias("n"))
        parts.append(counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).select(
            F.lit(name).alias("dataset"), "duplicates", pass_or(F.col("duplicates"), "FAIL").alias("status")
        ))
    return reduce(DataFrame.unionAll, parts)


def integrity_checks(projects: DataFrame, snapshots: DataFrame, outcomes: DataFrame, forbidden: list[str]) -> DataFrame:
    """Q20: recomputed days, date order, equal id sets over three tables, repeated snapshots, forbidden columns."""
    start, day, entry = F.col("project_start_date"), F.col("snapshot_date"), F.col("stage_entry_date")
    rows = as_checks(snapshots.agg(
        F.count_if(day < start).alias("snapshot_before_start"),
        F.count_if(F.datediff(day, start) != F.col("days_since_project_start")).alias("days_since_start_mismatch"),
        F.count_if(F.datediff(day, entry) != F.col("days_in_current_stage")).alias("days_in_stage_mismatch"),
        F.sum(F.lit(len(set(forbidden) & set(snapshots.columns)))).alias("forbidden_cells"),
    ))
    ids = reduce(DataFrame.unionAll, [
        t.select("project_id", *[F.lit(int(i == j)).alias(f"in_{j}") for j in range(3)])
        for i, t in enumerate((projects, snapshots, outcomes))
    ]).groupBy("project_id").agg(*[F.max(f"in_{j}").alias(f"in_{j}") for j in range(3)])
    everywhere = F.col("in_0") + F.col("in_1") + F.col("in_2")
    sets = as_checks(ids.agg(F.count_if(everywhere < 3).alias("project_id_mismatch")))
    repeated = as_checks(snapshots.groupBy("snapshot_id").agg(row_count().alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_snapshot_ids")
    ))
    return rows.unionAll(sets).unionAll(repeated).withColumn("status", pass_or(F.col("value"), "FAIL"))


def quality_report(name: str, checks: DataFrame, readiness: DataFrame) -> DataFrame:
    """The report as one nested row, fit for JSON; check tables are short and fixed in length."""
    warnings = checks.agg(F.sort_array(F.collect_list(F.when(
        F.col("status") == "WARNING", F.struct("check", "value", "status", "description")
    ))).alias("warnings"))
    return readiness.withColumns({"warnings": warnings.scalar(), "dataset": F.lit(name)})
