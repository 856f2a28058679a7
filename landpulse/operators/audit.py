"""Machine-learning readiness audit."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from landpulse.functions.literals import literal_table
from landpulse.operators import skew
from landpulse.operators.quality import TARGETS, row_count
from landpulse.session import durable

# Audited features and thresholds.
NUMERIC_FEATURES = [
    "days_in_current_stage", "days_since_project_start", "event_count_so_far", "land_required_ha", "land_to_acquire_ha",
    "total_parcels", "affected_families", "vulnerable_families", "pending_approvals_count", "file_pending_days",
    "docs_complete_pct", "court_cases_count", "case_age_months", "title_disputes_parcels", "grievances_30d",
    "compensation_awarded_cr", "compensation_disbursed_cr", "disbursal_pct", "rnr_progress_pct", "rnr_consent_pct",
    "grievance_redressal_days", "forest_involved", "proximity_km_to_urban",
]
CATEGORICAL_FEATURES = ["current_stage", "approval_dept", "terrain_type", "urban_rural"]
FORBIDDEN_FEATURES = [
    "snapshot_id", "project_id", "snapshot_date", "project_start_date", "stage_entry_date", "delay_next_30d",
    "delay_next_60d", "delay_next_90d", "is_censored", "scenario", "scenario_ground_truth", "first_delay_day",
    "delay_days", "delay_30_event_count", "delay_60_event_count", "delay_90_event_count", "delayed",
]
MISSING_WARN_PCT, MISSING_FAIL_PCT = 1.0, 5.0
RARE_CATEGORY_ROWS = 10
HIGH_CORRELATION = 0.90
FEWEST_PROJECTS = 100  # for a temporal holdout
FLAT_CELLS = 64  # from here on rank cells are gathered as maps instead of as columns
TOP_SIGNALS = 8
FEWEST_VALID_ROWS = 20
SCENARIO_FEATURES = [
    "pending_approvals_count", "file_pending_days", "docs_complete_pct", "court_cases_count", "grievances_30d",
    "rnr_progress_pct", "rnr_consent_pct", "disbursal_pct",
]


def long_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, x): one row per row and feature."""
    keep = keep or []
    typed = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.unpivot(keep, features, "feature", "x")


def missingness(df: DataFrame, features: list[str]) -> DataFrame:
    """A1: missing values per feature with the 1% and 5% thresholds; one pass."""
    counted = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features], row_count().alias("__rows"))
    long = counted.unpivot(["__rows"], features, "feature", "missing_count")
    pct = F.coalesce(F.try_divide(F.col("missing_count"), F.col("__rows")) * 100, F.lit(0.0))
    status = F.when(F.col("missing_pct") >= MISSING_FAIL_PCT, "FAIL").when(F.col("missing_pct") >= MISSING_WARN_PCT, "WARN").otherwise("PASS")
    return long.select("feature", "missing_count", pct.alias("missing_pct")).withColumn("status", status)


def numeric_health(df: DataFrame, features: list[str]) -> DataFrame:
    """A2: moments, exact quartiles, IQR outliers and cardinality per feature.

    The table is reduced once to distinct (feature, value) counts; quartiles, outliers and cardinality read those.
    """
    values = long_features(df, features).filter("x is not null").groupBy("feature", "x").agg(row_count().alias("n"))
    ranked = skew.positions(values, ["feature"], [F.col("x").asc()], F.col("n"))
    last, n, x = F.col("total") - 1, F.col("n"), F.col("x")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + n), x))

    def quantile(q: float) -> Column:
        place = last * q
        low, share = F.floor(place), place - F.floor(place)
        return at(low) + (at(F.ceil(place)) - at(low)) * F.max(share)

    total = F.max("total")
    mean = F.sum(x * n) / total
    moments = ranked.groupBy("feature").agg(
        total.alias("rows"), row_count().alias("unique_count"), mean.alias("mean"), F.min(x).alias("min"), quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"), quantile(0.75).alias("q3"), F.max(x).alias("max"),
    )
    # A second pass over the distinct values: squared distances from the mean and the outliers.
    spread = F.col("q3") - F.col("q1")
    outside = (spread != 0) & ((x < F.col("q1") - 1.5 * spread) | (x > F.col("q3") + 1.5 * spread))
    second = ranked.select("feature", "x", "n").join(F.broadcast(moments), "feature").groupBy("feature").agg(
        F.sum((x - F.col("mean")) * (x - F.col("mean")) * n).alias("squares"),
        F.sum(F.when(outside, n).otherwise(0)).alias("iqr_outlier_count"),
    )
    flag = F.when(F.col("unique_count") <= 1, "CONSTANT").when(F.col("unique_count") <= 3, "LOW_CARDINALITY").otherwise("OK")
    return moments.join(second, "feature").select(
        "feature", "unique_count", "mean", F.sqrt(F.try_divide(F.col("squares"), F.col("rows") - 1)).alias("std"), "min", "q1",
        "median", "q3", "max", "iqr_outlier_count",
        (F.col("iqr_outlier_count") / F.col("rows") * 100).alias("iqr_outlier_pct"), flag.alias("flag"),
    )


def target_balance(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """A3: class counts per label."""
    grouped = df.select(*targets).unpivot([], targets, "target", "y").groupBy("target").agg(
        F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"),
        F.count_if(F.col("y").isNull()).alias("missing"), (F.count_if(F.col("y") == 1) / row_count() * 100).alias("positive_pct"),
    )
    one_class = (F.col("positive") == 0) | (F.col("negative") == 0)
    return grouped.withColumn("status", F.when(one_class, "FAIL").when(F.col("positive_pct") < 1, "WARN").otherwise("PASS"))


def _per_target(df: DataFrame, key: list[str], targets: list[str]) -> DataFrame:
    """(key..., target, n, pos): rows with a known label and positives, for all labels in one aggregation."""
    counted = df.groupBy(*key).agg(*[
        F.struct(F.count(t).alias("n"), F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("pos")).alias(t) for t in targets
    ], row_count().alias("all_rows"))
    return counted.select(*key, "all_rows", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t)["n"].alias("n"), F.col(t)["pos"].alias("pos")) for t in targets
    ])))


def numeric_signal(df: DataFrame, features: list[str], targets: list[str] = TARGETS) -> DataFrame:
    """A4: rank correlation, single-feature AUC and class means for every feature and label.

    Rows are reduced to (feature, value) with class counts per label; mid-ranks come from the counts, so no row is
    ever ranked on its own and ties cost nothing.
    """
    known = long_features(df, features, targets).filter("x is not null")
    values = _per_target(known, ["feature", "x"], targets).filter("n > 0")
    ranked = skew.positions(values, ["target", "feature"], [F.col("x").asc()], F.col("n"))
    n, pos, x = F.col("n"), F.col("pos"), F.col("x")
    rank = F.col("before") + (n + 1) / 2.0
    sums = ranked.groupBy("target", "feature").agg(
        F.sum(n).alias("rows"), F.sum(pos).alias("p"), F.sum(rank * n).alias("sum_rank"), F.sum(rank * rank * n).alias("sum_rank2"),
        F.sum(rank * pos).alias("pos_rank"), F.sum(x * pos).alias("pos_x"), F.sum(x * n).alias("sum_x"),
    ).filter(F.col("rows") >= FEWEST_VALID_ROWS)
    rows, p = F.col("rows").cast("double"), F.col("p").cast("double")
    covariance = rows * F.col("pos_rank") - F.col("sum_rank") * p
    scale = F.sqrt(rows * F.col("sum_rank2") - F.col("sum_rank") * F.col("sum_rank")) * F.sqrt(rows * p - p * p)
    positive_mean = F.try_divide(F.col("pos_x"), p)
    negative_mean = F.try_divide(F.col("sum_x") - F.col("pos_x"), rows - p)
    return sums.select(
        "target", "feature", F.try_divide(covariance, scale).alias("spearman"),
        F.try_divide(F.col("pos_rank") - p * (p + 1) / 2, p * (rows - p)).alias("single_feature_auc"),
        positive_mean.alias("positive_mean"), negative_mean.alias("negative_mean"),
        F.try_divide(positive_mean - negative_mean, F.abs(negative_mean)).alias("relative_mean_difference"),
        F.col("rows").alias("n"),
    )


def top_signals(signals: DataFrame, k: int = TOP_SIGNALS) -> DataFrame:
    """A5: features whose AUC is furthest from 0.5, per label."""
    distance = F.abs(F.col("single_feature_auc") - 0.5)
    ranked = Window.partitionBy("target").orderBy(F.desc("abs_auc_distance"), "feature")
    return signals.withColumn("abs_auc_distance", distance).withColumn("signal_rank", F.row_number().over(ranked)).filter(
        F.col("signal_rank") <= k
    ).select("target", "signal_rank", "feature", "single_feature_auc", "abs_auc_distance")


def categorical_signal(df: DataFrame, features: list[str] = CATEGORICAL_FEATURES, targets: list[str] = TARGETS) -> DataFrame:
    """How far label prevalence differs between categories, and how many categories are rare."""
    text = df.select(*[F.col(f).cast("string").alias(f) for f in features], *targets).unpivot(targets, features, "feature", "category")
    counted = _per_target(text, ["feature", "category"], targets)
    whole = Window.partitionBy("target", "feature")  # one row per category
    rate = F.try_divide(F.col("pos"), F.col("n"))
    overall = F.try_divide(F.sum("pos").over(whole), F.sum("n").over(whole))
    gaps = counted.withColumns({"rate": rate, "gap": F.abs(rate - overall)})
    several = F.count_if(F.col("n") > 0) > 1
    return gaps.groupBy("target", "feature").agg(
        F.count_if(F.col("n") > 0).alias("category_count"),
        F.when(several, F.max("gap")).otherwise(0.0).alias("max_abs_prevalence_difference"),
        F.when(several, F.max("rate") - F.min("rate")).otherwise(0.0).alias("prevalence_spread"),
        F.count_if(F.col("all_rows") < RARE_CATEGORY_ROWS).alias("rare_category_count"),
    )


def _centred_ranks(rows: DataFrame, features: list[str], gaps: list[str]) -> DataFrame:
    """(id, ranks): per feature an array of mid-ranks less their mean, one among all rows that have the feature, then one for
    each feature with gaps, among the rows that have that one too; zero where the row lacks one of both.

    Ranks are worked out once per distinct value, for all partners together, so a row is copied once per feature.
    """
    has = F.array(*[F.col(f"`{g}`").isNotNull().cast("bigint") for g in gaps]).cast("array<bigint>")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{f}`").alias("x")) for k, f in enumerate(features)])
    long = rows.select("id", has.alias("has"), F.inline(cells)).filter("x is not null")
    counts = long.groupBy("k", "x").agg(row_count().alias("n0"), *[F.sum(F.get("has", i)).alias(f"n{i + 1}") for i in range(len(gaps))])
    names = [f"n{i}" for i in range(len(gaps) + 1)]
    ranked = skew.prefix_sums(counts, ["k"], [F.col("x").asc()], {n: F.col(n) for n in names})
    # A mid-rank less the mean rank (total + 1) / 2
    own = F.array(*[F.col(f"{n}_before") + F.col(n) / 2.0 - F.col(f"{n}_total") / 2.0 for n in names])
    met = long.join(ranked.select("k", "x", own.alias("ranks")), ["k", "x"])
    seen = F.zip_with("ranks", F.concat(F.array(F.lit(1).cast("bigint")), F.col("has")), lambda rank, there: rank * there)
    spread = met.select("id", "k", seen.alias("ranks"))
    if len(features) * len(names) <= FLAT_CELLS:  # one plain maximum per cell, as each cell has one row at most
        cell = lambda k, i: F.coalesce(F.max(F.when(F.col("k") == k, F.get("ranks", i))), F.lit(0.0))
        return spread.groupBy("id").agg(F.array(*[cell(k, F.lit(i)) for k in range(len(features)) for i in range(len(names))]).alias("ranks"))
    held = spread.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "ranks"))).alias("by_feature"))  # one entry per feature
    nothing = F.array_repeat(F.lit(0.0), len(names))
    return held.select("id", F.flatten(F.array(*[F.coalesce(F.element_at("by_feature", F.lit(k)), nothing) for k in range(len(features))])).alias("ranks"))


def spearman_matrix(df: DataFrame, features: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Rank correlation of every feature pair, each over the rows where both are present.

    As ranks are centred, a correlation is a sum of products over the roots of two sums of squares. All of them are one
    sum of vectors over the rows, merged in a tree; the driver gets one number per pair and per (feature, partner).
    """
    rows = durable(df.select(F.monotonically_increasing_id().alias("id"), *[F.col(f).cast("double").alias(f) for f in features]))
    nulls = rows.agg(*[F.count_if(F.col(f"`{f}`").isNull()).alias(f) for f in features]).first()  # one number per feature
    gaps = [f for f in features if nulls[f]]
    width = len(gaps) + 1
    at = lambda f, partner: features.index(f) * width + (gaps.index(partner) + 1 if partner in gaps else 0)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    ones, others = [at(a, b) for a, b in pairs], [at(b, a) for a, b in pairs]
    cells = len(features) * width
    indexes = lambda of: F.expr(f"array({', '.join(map(str, [*of, *range(cells)]))})")
    left, right = indexes(ones), indexes(others)
    product = F.zip_with(left, right, lambda i, j: F.get("ranks", i) * F.get("ranks", j))
    found = _centred_ranks(rows, features, gaps).select(Summarizer.sum(array_to_vector(product))).first()[0]
    sums = [float(v) for v in found] if found is not None and len(found) else [0.0] * (len(pairs) + cells)
    squares = sums[len(pairs):]
    out = [(f, f, 1.0) for f in features]
    for k, (a, b) in enumerate(pairs):
        scale = math.sqrt(squares[ones[k]]) * math.sqrt(squares[others[k]])
        value = sums[k] / scale if scale else None
        out += [(a, b, value), (b, a, value)]
    values = ", ".join(f"('{a}', '{b}', {'CAST(NULL AS DOUBLE)' if v is None else f'CAST({v!r} AS DOUBLE)'})" for a, b, v in out)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS c(feature_a, feature_b, spearman)")


def high_correlations(matrix: DataFrame, features: list[str] = NUMERIC_FEATURES, threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs of the upper triangle at or above the threshold."""
    place = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f, i)])
    return matrix.filter((place[F.col("feature_a")] < place[F.col("feature_b")]) & (F.abs("spearman") >= threshold))


def project_structure(df: DataFrame) -> DataFrame:
    """How many projects repeat, and the longest one."""
    per_project = df.groupBy("project_id").agg(row_count().alias("n"))
    counted = per_project.agg(
        row_count().alias("projects"), F.count_if(F.col("n") > 1).alias("multi_snapshot_projects"), F.max("n").alias("max_snapshots")
    )
    return counted.withColumn("leakage_risk", F.when(F.col("multi_snapshot_projects") > 0, "WARNING").otherwise("PASS"))


def temporal_holdout(df: DataFrame) -> DataFrame:
    """Sizes and overlaps of a 70/15/15 cut of the projects by first snapshot date, and whether the cut will do.

    FAIL when parts overlap, WARNING below ``FEWEST_PROJECTS`` projects, else PASS.
    """
    projects = df.groupBy("project_id").agg(F.min("snapshot_date").alias("first_date"))
    ranked = skew.positions(projects, [], [F.col("first_date").asc(), F.col("project_id").asc()])
    part = F.when(F.col("before") < F.floor(F.col("total") * 0.70), "train").when(
        F.col("before") < F.floor(F.col("total") * 0.85), "validation").otherwise("test")
    parts = ranked.select("project_id", part.alias("part"))
    per_project = parts.groupBy("project_id").agg(*[
        F.max((F.col("part") == p).cast("int")).alias(p) for p in ("train", "validation", "test")
    ])
    both = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"overlap_{a}_{b}")
    sizes = per_project.agg(
        *[F.sum(p).alias(f"{p}_projects") for p in ("train", "validation", "test")],
        both("train", "validation"), both("train", "test"), both("validation", "test"), row_count().alias("projects"),
    )
    overlaps = F.col("overlap_train_validation") + F.col("overlap_train_test") + F.col("overlap_validation_test")
    status = F.when(F.col("projects") < FEWEST_PROJECTS, "WARNING").when(overlaps > 0, "FAIL").otherwise("PASS")
    return sizes.withColumn("status", status)


def positive_timing(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """A10: project day of positive snapshots per label; days are counted first, so the median is exact and small."""
    day, n = F.col("days_since_project_start"), F.col("n")
    long = df.select("days_since_project_start", *targets).unpivot(["days_since_project_start"], targets, "target", "y")
    counted = long.groupBy("target", "days_since_project_start").agg(F.count_if(F.col("y") == 1).alias("n"))
    positive = F.when(n > 0, day)
    return counted.groupBy("target").agg(
        F.sum(n).alias("positive_count"), F.percentile(positive, F.lit(0.5), n).alias("median_positive_project_day"),
        F.min(positive).alias("min_positive_project_day"), F.max(positive).alias("max_positive_project_day"),
    )


def forbidden_columns(df: DataFrame, model_features: list[str]) -> DataFrame:
    """Forbidden columns of a table, how many rows fill them, and whether the model uses any."""
    present = [c for c in FORBIDDEN_FEATURES if c in df.columns]
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).unpivot([], present, "column", "filled_rows")
    used = F.col("column").isin(*model_features).cast("int")
    return filled.select("column", "filled_rows", used.alias("in_model"), F.when(used == 1, "FAIL").otherwise("PASS").alias("status"))


def roll_up(statuses: list[DataFrame]) -> DataFrame:
    """FAIL if any check fails, PASS_WITH_WARNINGS if any warns, else PASS."""
    every = reduce(DataFrame.unionAll, [s.select("status") for s in statuses])
    counted = every.agg(
        F.count_if(F.col("status") == "PASS").alias("pass_checks"),
        F.count_if(F.col("status").isin("WARN", "WARNING")).alias("warn_checks"),
        F.count_if(F.col("status") == "FAIL").alias("fail_checks"),
    )
    status = F.when(F.col("fail_checks") > 0, "FAIL").when(F.col("warn_checks") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return counted.withColumn("status", status)


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of a column's values in bits, null counted as a value.

    With n rows per value of m in all, H = log2(m) - sum(n log2 n) / m, so value counts are enough.
    """
    n = F.col("n")
    counted = df.groupBy(column).agg(row_count().alias("n"))
    return counted.agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy_bits"))
