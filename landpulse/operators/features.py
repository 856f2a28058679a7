"""Project features, the project master and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landpulse.functions.numeric import percent_or_null, percent_or_zero, ratio_or_null, whole_number
from landpulse.operators import skew
from landpulse.operators.contracts import unique_rows
from landpulse.session import durable

COUNT_FEATURES = [
    "survey_count", "village_count", "district_count", "urban_survey_count", "wet_survey_count",
    "party_record_count", "owner_record_count", "affected_party_count", "party_area_numeric_count",
    "party_area_missing_count",
]


def _totals_and_distinct(rows: DataFrame, key: str, totals: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """Per key the sums ``totals`` and, exactly, how many values each column of ``distinct`` has.

    Rows are first summed per combination of the values, with map-side combining, and stored. Only combinations are then
    counted column by column; the rows themselves are read once and never copied.
    """
    held = {name: f"__{name}" for name in distinct}
    combined = durable(rows.groupBy(key, *[c.alias(held[name]) for name, c in distinct.items()]).agg(*[F.sum(c).alias(name) for name, c in totals.items()]))
    sums = combined.groupBy(key).agg(*[F.sum(name).alias(name) for name in totals])
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.col(own).cast("string").alias("value")) for name, own in held.items()])
    values = combined.select(key, F.inline(cells)).filter("value is not null").distinct()
    counts = values.groupBy(key).agg(*[F.count_if(F.col("name") == name).alias(name) for name in distinct])
    return skew.match(sums, counts, [key], "left").fillna(0, subset=list(distinct))


def survey_features(surveys: DataFrame) -> DataFrame:
    """parcel counts, areas and shares per project."""
    area, one = F.col("area_hectares"), F.lit(1).cast("bigint")
    where = lambda condition, value=one: F.when(condition, value)
    counts = {
        "survey_count": one, "urban_survey_count": where(F.col("land_category") == "Urban"), "wet_survey_count": where(F.col("land_type") == "Wet"),
    }
    areas = {
        "surveyed_area_ha": area, "private_area_ha": where(F.col("land_nature") == "Private", area), "government_area_ha": where(F.col("land_nature") == "Government", area),
    }
    found = _totals_and_distinct(surveys, "project_id", counts | areas, {"village_count": F.col("village"), "district_count": F.col("district")})
    grouped = found.fillna(0, subset=list(counts)).withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in areas})
    share = lambda part, whole: percent_or_zero(F.col(part), F.col(whole))
    return grouped.withColumns({
        "private_land_pct": share("private_area_ha", "surveyed_area_ha"),
        "government_land_pct": share("government_area_ha", "surveyed_area_ha"),
        "urban_survey_pct": share("urban_survey_count", "survey_count"),
        "wet_land_pct": share("wet_survey_count", "survey_count"),
    })


def party_features(parties: DataFrame) -> DataFrame:
    """stakeholder counts and areas per project; areas stay null when no party has a numeric one."""
    area = F.col("party_area_hectares").cast("string").try_cast("double")
    return parties.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("party_record_count"),
        F.count_if(F.col("party_type") == "Owner").alias("owner_record_count"),
        F.count_if(F.col("party_type") == "Affected Party").alias("affected_party_count"),
        F.count(area).alias("party_area_numeric_count"),
        F.count_if(area.isNull()).alias("party_area_missing_count"),
        F.sum(area).alias("party_area_total_ha"), F.avg(area).alias("party_area_mean_ha"),
        F.max(area).alias("party_area_max_ha"),
    ).withColumn("affected_party_rate_pct", percent_or_zero(F.col("affected_party_count"), F.col("party_record_count")))


def assemble_features(manifest: DataFrame, surveys: DataFrame, parties: DataFrame) -> DataFrame:
    """manifest population, or the surveyed projects where there is no manifest at all.

    Counts are zero-filled, areas stay null.
    """
    projects = manifest.withColumn("project_id", F.col("project_id").cast("string").try_cast("bigint")).dropDuplicates(["project_id"])
    by_survey, by_party = survey_features(surveys), party_features(parties)
    # Without any project in the manifest the surveyed ones take their place; whether there is one is worked out in the plan.
    none = projects.agg(F.count(F.lit(1)) == 0).scalar()
    population = projects.unionByName(by_survey.filter(none).select("project_id"), allowMissingColumns=True)
    assembled = population.join(by_survey, "project_id", "left").join(by_party.filter(~none), "project_id", "left")
    return assembled.fillna(0, subset=[c for c in COUNT_FEATURES if c in assembled.columns])


def derived_ratios(features: DataFrame) -> DataFrame:
    """completion, coverage and complexity ratios; a zero denominator gives null."""
    col = F.col
    formulas = {
        "acquisition_completion_pct": (percent_or_null, "land_acquired_ha", "land_to_acquire_ha"),
        "surveyed_vs_land_to_acquire_pct": (percent_or_null, "surveyed_area_ha", "land_to_acquire_ha"),
        "parties_per_survey": (ratio_or_null, "party_record_count", "survey_count"),
        "owners_per_survey": (ratio_or_null, "owner_record_count", "survey_count"),
    }
    return features.withColumns({
        name: ratio(col(top), col(bottom)) for name, (ratio, top, bottom) in formulas.items()
        if top in features.columns and bottom in features.columns
    })


def project_features(manifest: DataFrame, surveys: DataFrame, parties: DataFrame) -> DataFrame:
    return derived_ratios(assemble_features(manifest, surveys, parties))


def wide_project_record(manifest: DataFrame, surveys: DataFrame, parties: DataFrame, timeline: DataFrame,
                        unified: DataFrame) -> DataFrame:
    """the wide record of every project: progress, coverage, geography, stakeholders, timing, quality.

    ``timeline`` holds one row per project (first and latest stage dates, counts); ``unified`` one row per
    sanction or notification with its gap in days.
    """
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    distinct = {
        "village": "village_count", "district": "district_count", "sub_district": "sub_district_count",
        "land_type": "land_type_count", "land_category": "land_category_count",
    }
    area = F.col("area_hectares")
    parcel = _totals_and_distinct(surveys, "project_id", {
        "total_surveys": F.lit(1).cast("bigint"), "surveyed_area_ha": area, "private_area_ha": F.when(F.col("land_nature") == "Private", area),
        "government_area_ha": F.when(F.col("land_nature") == "Government", area), "survey_owner_count_sum": F.col("owner_count"),
        "survey_affected_party_count_sum": F.col("affected_party_count"),
    }, {name: filled(c) for c, name in distinct.items()})
    people = parties.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_party_records"),
        F.count_if(F.col("party_type") == "Owner").alias("total_owners"),
        F.count_if(F.col("party_type") == "Affected Party").alias("total_affected_parties"),
        F.count(F.nullif(F.col("party_area_hectares").cast("string"), F.lit(""))).alias("party_area_numeric_count"),
    )
    gap, n = F.col("gap"), F.col("n")
    by_gap = unified.groupBy("project_id", F.col("days_since_previous_event").alias("gap")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last")
    )
    gaps = by_gap.groupBy("project_id").agg(
        F.min("first").alias("first_event_date"), F.max("last").alias("latest_event_date"),
        (F.sum(gap * n) / F.sum(F.when(gap.isNotNull(), n))).alias("average_event_gap_days"),
        F.percentile(gap, F.lit(0.5), n).alias("median_event_gap_days"), F.max(gap).alias("max_event_gap_days"),
    )
    stages = timeline.drop("first_event_date", "last_event_date", "timeline_span_days")
    joined = (
        manifest.join(parcel, "project_id", "left").join(people, "project_id", "left")
        .join(stages, "project_id", "left").join(gaps, "project_id", "left")
        .fillna(0, subset=["total_surveys", *distinct.values(), "total_party_records", "total_owners",
                           "total_affected_parties", "party_area_numeric_count"])
        .fillna(0.0, subset=["surveyed_area_ha", "private_area_ha", "government_area_ha"])
    )
    col = F.col
    return joined.withColumns({
        "land_remaining_ha": F.when(
            col("land_to_acquire_ha").isNotNull() & col("land_acquired_ha").isNotNull(),
            F.greatest(col("land_to_acquire_ha") - col("land_acquired_ha"), F.lit(0.0)),
        ),
        "acquisition_completion_pct": percent_or_null(col("land_acquired_ha"), col("land_to_acquire_ha")),
        "surveyed_vs_required_pct": percent_or_null(col("surveyed_area_ha"), col("land_required_ha")),
        "surveyed_vs_acquisition_target_pct": percent_or_null(col("surveyed_area_ha"), col("land_to_acquire_ha")),
        "private_land_pct": percent_or_null(col("private_area_ha"), col("surveyed_area_ha")),
        "government_land_pct": percent_or_null(col("government_area_ha"), col("surveyed_area_ha")),
        "affected_party_density_pct": percent_or_null(col("total_affected_parties"), col("total_surveys")),
        "owners_per_survey": ratio_or_null(col("total_owners"), col("total_surveys")),
        "notification_cycle_count": col("notification_count_prelim"),
        "timeline_span_days": F.datediff("latest_event_date", "first_event_date"),
        "days_latest_prelim_to_latest_award": F.datediff("latest_award_date", "latest_prelim_date"),
        "days_since_latest_award_event": F.datediff("latest_event_date", "latest_award_date"),
        "party_area_missing_count": col("total_party_records") - col("party_area_numeric_count"),
    })


def normalise_project_id(df: DataFrame) -> DataFrame:
    """whole-number project ids; rows without one are dropped."""
    return df.withColumn("project_id", whole_number(F.col("project_id"))).filter(F.col("project_id").isNotNull())


def project_master(features: DataFrame, timeline: DataFrame) -> DataFrame:
    """F8: features left-joined to the timeline, one row each side; repeated ids raise."""
    left = unique_rows(normalise_project_id(features), ["project_id"], "project features")
    right = unique_rows(normalise_project_id(timeline), ["project_id"], "project timeline")
    return left.join(right, "project_id", "left")


def master_summary(master: DataFrame) -> DataFrame:
    """row, id and timeline counts of the master."""
    rows, ids = F.count(F.lit(1)), F.countDistinct("project_id")
    return master.agg(
        rows.alias("project_rows"), ids.alias("unique_project_ids"), (F.count("project_id") - ids).alias("duplicate_ids"),
        F.count_if(F.col("first_event_date").isNull()).alias("projects_without_timeline"),
    )


def stage_value_counts(master: DataFrame) -> DataFrame:
    """projects per latest stage, a missing stage counted as its own value."""
    return master.groupBy("latest_event_stage").agg(F.count(F.lit(1)).alias("projects"))


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """columns that have nulls, most first; one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counted.unpivot([], counted.columns, "column", "missing_count")
    return long.filter(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column")
