"""Notification timelines, as-of states, re-acquisition cycles and transition durations.

Stage codes are case-sensitive; columns use the tokens ``prelim`` (3a), ``decl`` (3A) and ``award`` (3D), because
names that differ only by case are ambiguous in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landpulse.functions.literals import literal_table
from landpulse.functions.numeric import whole_number
from landpulse.operators import skew
from landpulse.operators.contracts import duplicate_count, present, require_columns
from landpulse.operators.skew import HOT_ROWS
from landpulse.session import durable

# Stage codes, their order and their names in the unified timeline.
STAGES = {"3a": "prelim", "3A": "decl", "3D": "award"}
STAGE_ORDER = {"3a": 1, "3A": 2, "3D": 3}
TIMELINE_STAGE_NAMES = {
    "3a": "3A_PRELIMINARY_NOTIFICATION",
    "3A": "3A_DECLARATION",
    "3D": "3D_DECLARATION",
}
BENCHMARK_TRANSITIONS = {"3a_to_3A": ("3a", "3A"), "3A_to_3D": ("3A", "3D")}
STATIC_FIELDS = ["project_name", "project_number", "land_required_ha", "land_to_acquire_ha"]
STATIC_CLASS = "STATIC_REFERENCE"
OBSERVED_CLASS = "OBSERVED_AS_OF_SNAPSHOT"

PROJECT, ORDER = ["project_id"], ["event_date", "notification_id"]


def stage_rank(stage: Column, otherwise: int | None = 0) -> Column:
    rank = F.when(F.lit(False), F.lit(0))
    for code, order in STAGE_ORDER.items():
        rank = rank.when(stage == code, F.lit(order))
    return rank.otherwise(F.lit(otherwise).cast("int"))


def normalise_notifications(raw: DataFrame) -> DataFrame:
    """Lenient ids and dates, trimmed type, stage order; rows without a project are dropped."""
    require_columns(raw, ["project_id", "notification_id", "notification_type", "publish_date"], "notifications")
    kind = F.trim(F.col("notification_type").cast("string"))
    return raw.withColumns({
        "project_id": whole_number(F.col("project_id")),
        "notification_id": whole_number(F.col("notification_id")),
        "publish_date": F.col("publish_date").try_cast("date"),
        "notification_type": kind,
        "stage_order": stage_rank(kind, None),
    }).filter(F.col("project_id").isNotNull())


def canonical_events(notifications: DataFrame) -> DataFrame:
    """Rename notifications to events; a missing type becomes ''."""
    carried = [c for c in notifications.columns if c not in ("publish_date", "notification_type")]
    return notifications.select(
        *carried,
        F.col("publish_date").cast("date").alias("event_date"),
        F.trim(F.coalesce(F.col("notification_type"), F.lit(""))).alias("event_type"),
    )


def dated_events(notifications: DataFrame) -> DataFrame:
    """Events for snapshots and cycles, which need a date: one without stops the job when its row is computed."""
    return canonical_events(notifications).withColumn("event_date", present("event_date", "events"))


def _day_gap(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(later, earlier)


def scan_events(events: DataFrame, scans: dict[str, skew.Scan] | None = None, cycles: bool = False,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number each project's events in (date, id) order and add the asked-for running values.

    Everything shares one shuffle by project. With ``cycles`` the re-acquisition cycle columns are added: a 3a
    opens a new cycle when the last 3a or 3D before it was a 3D.
    """
    kind = F.col("event_type")

    def steps(rows: DataFrame, apply: skew.Apply) -> DataFrame:
        wanted = {"event_sequence": skew.running_count(), **(scans or {})}
        if cycles:
            wanted["__marker"] = skew.last_known_before(F.when(kind.isin("3a", "3D"), kind))
        rows = apply(rows, wanted)
        if not cycles:
            return rows
        opens = (kind == "3a") & (F.col("__marker") == "3D")
        rows = rows.withColumn("__opens", F.coalesce(opens, F.lit(False)))
        starts = F.col("__opens") | (F.col("event_sequence") == 1)
        return apply(rows, {
            "__opened": skew.running_sum(F.col("__opens").cast("bigint")),
            "__cycle_start": skew.running_max(F.when(starts, F.struct("event_sequence", "event_date"))),
            "__award": skew.running_max(F.when(kind == "3D", F.col("event_sequence"))),
        })

    scanned = skew.scan_by_key(
        events, PROJECT, ORDER, steps, skew.date_id_slice("event_date", "notification_id"),
        skew.id_bounds("notification_id"), hot_rows,
    )
    if not cycles:
        return scanned
    start = F.col("__cycle_start")
    done = F.coalesce(F.col("__award") >= start["event_sequence"], F.lit(False))
    number = F.col("__opened") + 1
    return scanned.withColumns({
        "cycle_number": number,
        "cycle_id": F.concat(F.col("project_id").cast("string"), F.lit("_C"), _pad(number, 2)),
        "cycle_start_date": start["event_date"],
        "cycle_event_sequence": F.col("event_sequence") - start["event_sequence"] + 1,
        "cycle_completed": done.cast("int"),
        "cycle_status": F.when(done, F.lit("COMPLETED")).otherwise(F.lit("OPEN")),
    }).drop("__marker", "__opens", "__opened", "__cycle_start", "__award")


def _pad(number: Column, width: int) -> Column:
    """Left-pad with zeros without cutting longer numbers."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def project_timeline(notifications: DataFrame) -> DataFrame:
    """First and latest date per stage, stage-pair days, counts and latest event of each project."""
    kind, date, ident = F.col("notification_type"), F.col("publish_date"), F.col("notification_id")
    latest = F.max_by(F.struct(kind, ident), F.struct(date.isNull(), date, ident))
    per_stage = []
    for code, token in STAGES.items():
        when_stage = F.when(kind == code, date)
        per_stage += [
            F.count_if(kind == code).alias(f"notification_count_{token}"),
            F.min(when_stage).alias(f"first_{token}_date"),
            F.max(when_stage).alias(f"latest_{token}_date"),
        ]
    grouped = notifications.groupBy("project_id").agg(
        F.min(date).alias("first_event_date"), F.max(date).alias("last_event_date"), latest.alias("latest"),
        F.count(F.lit(1)).alias("notification_count_total"), *per_stage,
    )
    return grouped.select(
        "project_id", "first_event_date", "last_event_date",
        F.col("latest.notification_type").alias("latest_event_stage"),
        F.col("latest.notification_id").alias("latest_notification_id"),
        "notification_count_total",
        *[f"notification_count_{t}" for t in STAGES.values()],
        *[f"{edge}_{t}_date" for t in STAGES.values() for edge in ("first", "latest")],
        _day_gap("first_decl_date", "first_prelim_date").alias("days_prelim_to_decl"),
        _day_gap("first_award_date", "first_decl_date").alias("days_decl_to_award"),
        _day_gap("first_award_date", "first_prelim_date").alias("days_prelim_to_award"),
        _day_gap("last_event_date", "first_event_date").alias("timeline_span_days"),
    )


def event_timeline(notifications: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every notification with the previous date, days since it and days since the first."""
    date = F.col("event_date")
    renamed = notifications.withColumnRenamed("publish_date", "event_date")
    scanned = scan_events(
        renamed.withColumn("event_type", F.col("notification_type")),
        {"previous_publish_date": skew.previous(date), "__first": skew.running_min(date)}, hot_rows=hot_rows,
    )
    return scanned.withColumns({
        "days_since_previous_event": _day_gap(date, F.col("previous_publish_date")),
        "days_since_first_event": _day_gap(date, F.col("__first")),
    }).withColumnRenamed("event_date", "publish_date").drop("__first", "event_type", "event_sequence")


def _stage_counts() -> dict[str, skew.Scan]:
    kind = F.col("event_type")
    return {f"count_{t}_so_far": skew.running_sum((kind == c).cast("bigint")) for c, t in STAGES.items()}


def _stage_as_of() -> Column:
    stage = F.when(F.lit(False), F.lit(""))
    for code, token in reversed(list(STAGES.items())):
        stage = stage.when(F.col(f"count_{token}_so_far") > 0, F.lit(code))
    return stage.otherwise(F.lit("UNKNOWN"))


def observed_events(notifications: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Canonical event table with sequence, gaps, indicators and what was known as of each event."""
    date = F.col("event_date")
    scans = {"previous_event_date": skew.previous(date), "first_event_date": skew.running_min(date), **_stage_counts()}
    scanned = scan_events(canonical_events(notifications), scans, hot_rows=hot_rows)
    flags = {f"is_{t}": (F.col("event_type") == c).cast("int") for c, t in STAGES.items()}
    known = {f"has_{t}_by_date": (F.col(f"count_{t}_so_far") > 0).cast("int") for t in STAGES.values()}
    return scanned.withColumns({
        "days_since_previous_event": _day_gap(date, F.col("previous_event_date")),
        "days_since_first_event": _day_gap(date, F.col("first_event_date")),
        **flags, **known, "stage_as_of_event": _stage_as_of(),
    }).drop(*[f"count_{t}_so_far" for t in STAGES.values()])


def duplicate_event_keys(events: DataFrame) -> DataFrame:
    """How many events repeat an earlier (project, notification) key."""
    return duplicate_count(events, ["project_id", "notification_id"]).withColumnRenamed("duplicates", "duplicate_event_keys")


def stage_reconciliation(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events per stage against the total; a difference means other event types exist."""
    per_stage = [F.count_if(F.col(kind) == c).alias(f"count_{t}") for c, t in STAGES.items()]
    known = sum((F.col(f"count_{t}") for t in STAGES.values()), F.lit(0))
    counted = events.agg(*per_stage, F.count(F.lit(1)).alias("total_events"))
    return counted.withColumns({
        "other_events": F.col("total_events") - known,
        "status": F.when(known == F.col("total_events"), F.lit("PASS")).otherwise(F.lit("WARNING")),
    })


def project_activity(notifications: DataFrame) -> DataFrame:
    """Events and highest stage reached per project; needs no ordering, so no window."""
    kind = F.col("event_type")
    grouped = canonical_events(notifications).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max(stage_rank(kind)).alias("rank")
    )
    stage = F.when(F.lit(False), F.lit(""))
    for code, order in STAGE_ORDER.items():
        stage = stage.when(F.col("rank") == order, F.lit(code))
    return grouped.select("project_id", "event_count", stage.otherwise(F.lit("UNKNOWN")).alias("latest_stage"))


def project_snapshots(notifications: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One snapshot per event with running counts, elapsed days and days in the current stage."""
    kind, date = F.col("event_type"), F.col("event_date")
    scans = {"__previous": skew.previous(date), "project_start_date": skew.running_min(date), **_stage_counts()}
    scans |= {f"__first_{t}": skew.running_min(F.when(kind == c, date)) for c, t in STAGES.items()}
    scanned = scan_events(dated_events(notifications), scans, hot_rows=hot_rows)
    first_seen = F.when(F.lit(False), date)
    for token in reversed(STAGES.values()):
        first_seen = first_seen.when(F.col(f"count_{token}_so_far") > 0, F.col(f"__first_{token}"))
    first_seen = first_seen.otherwise(F.col("project_start_date"))
    ident = F.concat_ws("_", F.col("project_id").cast("string"), F.date_format(date, "yyyyMMdd"), _pad(F.col("event_sequence"), 3))
    return scanned.withColumns({
        "snapshot_id": ident,
        "snapshot_date": date,
        "current_stage": _stage_as_of(),
        "stage_first_seen_date": first_seen,
        "days_in_current_stage": _day_gap(date, first_seen),
        "days_since_project_start": _day_gap(date, F.col("project_start_date")),
        "days_since_previous_event": _day_gap(date, F.col("__previous")),
        "event_count_so_far": F.col("event_sequence"),
        **{f"has_{t}": (F.col(f"count_{t}_so_far") > 0).cast("int") for t in STAGES.values()},
    }).drop("event_date", "__previous", *[f"__first_{t}" for t in STAGES.values()])


def attach_static(snapshots: DataFrame, master: DataFrame) -> DataFrame:
    """Join static project facts (first row per project) and tag where each field comes from."""
    static = master.select("project_id", *STATIC_FIELDS).dropDuplicates(["project_id"])
    classes = {f"{c}_data_class": F.lit(STATIC_CLASS) for c in ["project_id", *STATIC_FIELDS]}
    return skew.lookup(snapshots, static, PROJECT).withColumns(
        {**classes, "temporal_state_data_class": F.lit(OBSERVED_CLASS)}
    )


def duplicate_snapshot_ids(snapshots: DataFrame) -> DataFrame:
    """Repeated snapshot ids; ``require_unique`` is the raising form."""
    counted = duplicate_count(snapshots, ["snapshot_id"])
    status = F.when(F.col("duplicates") == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return counted.select(F.col("duplicates").alias("duplicate_snapshot_ids"), status.alias("status"))


def backward_transitions(snapshots: DataFrame, stage: str = "current_stage", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Snapshots whose stage ranks below the highest stage seen earlier in the project."""
    rank = stage_rank(F.col(stage))
    scanned = skew.scan_by_key(
        snapshots.select("project_id", "snapshot_date", "event_sequence", F.col(stage).alias("current_stage"),
                         rank.alias("current_stage_rank")),
        PROJECT, ["snapshot_date", "event_sequence"],
        lambda rows, apply: apply(rows, {"previous_stage_rank": skew.max_before(F.col("current_stage_rank"))}),
        skew.date_id_slice("snapshot_date", "event_sequence"), skew.id_bounds("event_sequence"), hot_rows,
    )
    return scanned.filter(F.col("current_stage_rank") < F.col("previous_stage_rank"))


def acquisition_cycles(notifications: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every event with its acquisition cycle, position and status within it."""
    scanned = scan_events(dated_events(notifications), cycles=True, hot_rows=hot_rows)
    return scanned.withColumns({
        "cycle_stage": F.col("event_type"),
        "cycle_days_elapsed": _day_gap("event_date", "cycle_start_date"),
    }).withColumnRenamed("event_sequence", "project_event_sequence")


def cycle_summary(cycles: DataFrame) -> DataFrame:
    """One row per cycle."""
    kind, position = F.col("event_type"), F.col("cycle_event_sequence")
    return cycles.groupBy("project_id", "cycle_number", "cycle_id").agg(
        F.min("cycle_start_date").alias("cycle_start_date"),
        F.max("event_date").alias("cycle_last_event_date"),
        F.max(position).alias("cycle_event_count"),
        F.max_by("cycle_stage", position).alias("latest_cycle_stage"),
        F.max_by("cycle_status", position).alias("cycle_status"),
        F.max("cycle_completed").alias("cycle_completed"),
        *[F.max((kind == c).cast("int")).alias(f"has_{t}") for c, t in STAGES.items()],
    ).withColumn("cycle_duration_days", _day_gap("cycle_last_event_date", "cycle_start_date"))


def cycle_contiguity(cycles: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cycles whose number differs from their place among the project's cycles."""
    numbers = durable(cycles.select("project_id", "cycle_number").distinct())
    placed = skew.scan_by_key(
        numbers, PROJECT, ["cycle_number"], lambda rows, apply: apply(rows, {"expected_cycle": skew.running_count()}),
        F.shiftright(F.col("cycle_number"), 16), None, hot_rows,
    )
    wrong = placed.filter(F.col("cycle_number") != F.col("expected_cycle"))
    return wrong.select("project_id", "expected_cycle", F.col("cycle_number").alias("actual_cycle"))


def unified_timeline(notifications: DataFrame, sanctions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sanctions and notifications in one timeline with sequence and gap days."""
    stage = F.col("notification_type")
    for code, name in TIMELINE_STAGE_NAMES.items():
        stage = F.when(F.col("notification_type") == code, F.lit(name)).otherwise(stage)
    notices = notifications.select(
        "project_id", F.col("publish_date").alias("event_date"), F.lit("NOTIFICATION").alias("event_type"),
        stage.alias("stage"), F.col("notification_id").cast("string").alias("event_id"),
        "notification_number", "status", F.lit(None).cast("double").alias("amount_rs"),
    )
    grants = sanctions.select(
        "project_id", F.col("sanction_date").alias("event_date"), F.lit("SANCTION").alias("event_type"),
        F.lit("PROJECT_SANCTION").alias("stage"), F.col("sanction_number").alias("event_id"),
        F.lit("").alias("notification_number"), F.lit("SANCTIONED").alias("status"),
        F.col("sanction_amount_rs").alias("amount_rs"),
    )
    kind_rank = F.when(F.col("event_type") == "NOTIFICATION", 0).otherwise(1)
    slice_of = F.coalesce(F.unix_date("event_date"), F.lit(10_000_000)).cast("bigint") * 2 + kind_rank
    scanned = skew.scan_by_key(
        notices.unionByName(grants), PROJECT, ["event_date", "event_type", "event_id"],
        lambda rows, apply: apply(rows, {
            "event_sequence": skew.running_count(), "__previous": skew.previous(F.col("event_date")),
        }),
        slice_of, None, hot_rows,
    )
    return scanned.withColumn("days_since_previous_event", _day_gap("event_date", "__previous")).drop("__previous")


def transition_observations(notifications: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Days between neighbouring 3a-3A and 3A-3D events of one cycle.

    Only a 3a can open a cycle, so a following 3A or 3D always belongs to the same one.
    """
    facts = [c for c in ("event_type", "event_date", "notification_id", "notification_number", "status") if c != "event_type"]
    ahead = F.struct("event_type", *[c for c in facts if c in notifications.columns or c == "event_date"])
    scanned = scan_events(canonical_events(notifications), {"__next": skew.following(ahead)}, True, hot_rows)
    pair = F.when(F.lit(False), F.lit(""))
    for name, (start, end) in BENCHMARK_TRANSITIONS.items():
        pair = pair.when((F.col("event_type") == start) & (F.col("__next.event_type") == end), F.lit(name))
    extra = [c for c in ("notification_number", "status") if c in notifications.columns]
    return scanned.withColumn("transition", pair).filter(F.col("transition").isNotNull()).select(
        "project_id", "cycle_number", "cycle_id", "transition",
        F.col("event_type").alias("from_stage"), F.col("__next.event_type").alias("to_stage"),
        F.col("event_date").alias("start_event_date"), F.col("__next.event_date").alias("end_event_date"),
        _day_gap(F.col("__next.event_date"), F.col("event_date")).alias("duration_days"),
        F.col("notification_id").alias("start_notification_id"),
        F.col("__next.notification_id").alias("end_notification_id"),
        *[F.col(c).alias(f"start_{c}") for c in extra], *[F.col(f"__next.{c}").alias(f"end_{c}") for c in extra],
        F.col("cycle_event_sequence").alias("start_event_sequence"),
        (F.col("cycle_event_sequence") + 1).alias("end_event_sequence"),
        F.lit("OBSERVED").alias("observation_quality"), F.lit(1).alias("usable_for_empirical_benchmark"),
    )


def duration_distribution(observations: DataFrame) -> DataFrame:
    """Count, min, median, mean and max days per transition.

    Days are first reduced to (transition, days) counts, so the exact median only sees distinct day values.
    """
    counted = observations.groupBy("transition", "duration_days").agg(F.count(F.lit(1)).alias("n"))
    days, n = F.col("duration_days"), F.col("n")
    return counted.groupBy("transition").agg(
        F.sum(n).alias("observation_count"), F.min(days).alias("min_days"),
        F.percentile(days, F.lit(0.5), n).alias("median_days"),
        (F.sum(days * n) / F.sum(n)).alias("mean_days"), F.max(days).alias("max_days"),
    )


def stage_policy_check(policy: DataFrame, observations: DataFrame) -> DataFrame:
    """Each expected or configured transition, its policy state and how many observations back it."""
    expected = literal_table(policy.sparkSession, [(t,) for t in BENCHMARK_TRANSITIONS], "stage_transition string")
    counts = observations.groupBy(F.col("transition").alias("stage_transition")).agg(
        F.count(F.lit(1)).alias("observed_transitions")
    )
    configured = policy.withColumn("configured", F.lit(1))
    joined = expected.withColumn("expected", F.lit(1)).join(configured, "stage_transition", "full").join(
        counts, "stage_transition", "left"
    )
    observed = F.coalesce(F.col("observed_transitions"), F.lit(0))
    return joined.select(
        "stage_transition",
        F.when(F.col("configured").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED")
        .otherwise("PASS").alias("transition_check"),
        F.coalesce((F.col("benchmark_type") == "empirical_pending").cast("int"), F.lit(0)).alias("pending"),
        F.coalesce((F.upper("usable_for_ml_label") == "YES").cast("int"), F.lit(0)).alias("marked_usable"),
        observed.alias("observed_transitions"),
        F.coalesce((observed >= F.col("minimum_observations_required")).cast("int"), F.lit(0)).alias("enough_observations"),
    )


def legal_policy_check(policy: DataFrame) -> DataFrame:
    """Legal rules and how many have no numeric deadline."""
    bad = F.col("deadline_days").cast("string").try_cast("double").isNull()
    return policy.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(bad).alias("invalid_deadlines"),
        F.when(F.count_if(bad) == 0, F.lit("PASS")).otherwise(F.lit("ERROR")).alias("status"),
    )
