"""Delay-risk modelling: features, labels, split, models, metrics and calibration."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landpulse.functions.literals import literal_table
from landpulse.functions.numeric import PROBABILITY_EPSILON, clip, logit, platt, ratio_or_null
from landpulse.operators import boosting, skew
from landpulse.operators.contracts import forbid_columns, require_columns
from landpulse.operators.quality import TARGETS, row_count
from landpulse.session import durable

# Predictors, columns that must never be predictors, and training settings.
BASE_NUMERIC = [
    "days_in_current_stage", "days_since_project_start", "land_required_ha", "land_to_acquire_ha", "total_parcels",
    "affected_families", "vulnerable_families", "pending_approvals_count", "file_pending_days", "docs_complete_pct",
    "court_cases_count", "case_age_months", "title_disputes_parcels", "grievances_30d", "compensation_awarded_cr",
    "compensation_disbursed_cr", "disbursal_pct", "rnr_progress_pct", "rnr_consent_pct", "grievance_redressal_days",
    "forest_involved", "proximity_km_to_urban",
]
BASE_CATEGORICAL = ["current_stage", "approval_dept", "terrain_type", "urban_rural"]
ENGINEERED_NOTES = {
    "land_acquisition_ratio": "land_to_acquire_ha / land_required_ha",
    "affected_family_per_parcel": "affected_families / total_parcels",
    "vulnerable_family_share": "vulnerable_families / affected_families",
    "compensation_pending_cr": "compensation_awarded_cr - compensation_disbursed_cr",
    "rnr_remaining_pct": "100 - rnr_progress_pct",
    "docs_remaining_pct": "100 - docs_complete_pct",
}
LABEL_NOTE = "Forward-looking delay label; never used as predictor."
FORBIDDEN_PREDICTORS = [
    "snapshot_id", "project_id", "snapshot_date", "project_start_date", "stage_entry_date", "is_censored", "scenario",
    "scenario_ground_truth", "event_count_so_far", *TARGETS,
]
SEED = 20260914
TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.15
TOP_SHARE = 0.10
THRESHOLD = 0.50
BIN_EDGES = [i * 0.1 for i in range(10)] + [1.0]  # edges of ten equal bins, as floats
EXACT_TYPES = {"tinyint", "smallint", "int", "bigint", "double"}
HORIZON_DAYS = {"delay_next_30d": 30, "delay_next_60d": 60, "delay_next_90d": 90}

RANGES_TOGETHER, SCORE_BUCKETS = 8, 1024
Block = tuple[float, float, float, float]
BLOCK, BLOCK_NAMES, BLOCK_TYPES = "part long, low double, high double, n double, s double", ["part", "low", "high", "n", "s"], [pa.float64()] * 4
SEGMENT_NAMES = ["start", "stop", "start_value", "stop_value"]

ENGINEERED = list(ENGINEERED_NOTES)
NUMERIC = BASE_NUMERIC + ENGINEERED
PREDICTORS = NUMERIC + BASE_CATEGORICAL


def engineered_features() -> dict[str, Column]:
    number = lambda c: F.col(c).cast("double")
    return {
        "land_acquisition_ratio": ratio_or_null(number("land_to_acquire_ha"), number("land_required_ha")),
        "affected_family_per_parcel": ratio_or_null(number("affected_families"), number("total_parcels")),
        "vulnerable_family_share": ratio_or_null(number("vulnerable_families"), number("affected_families")),
        "compensation_pending_cr": clip(number("compensation_awarded_cr") - number("compensation_disbursed_cr"), 0.0),
        "rnr_remaining_pct": clip(100.0 - number("rnr_progress_pct"), 0.0, 100.0),
        "docs_remaining_pct": clip(100.0 - number("docs_complete_pct"), 0.0, 100.0),
    }


def feature_matrix(snapshots: DataFrame, keep: list[str] | None = None, targets: list[str] = TARGETS) -> DataFrame:
    """M1 and M3: 28 numeric and 4 categorical predictors plus labels; never an identifier or a future column."""
    require_columns(snapshots, BASE_NUMERIC + BASE_CATEGORICAL + targets, "snapshots")
    forbid_columns(PREDICTORS, FORBIDDEN_PREDICTORS, "feature matrix")
    kinds = dict(snapshots.dtypes)
    # Whole numbers and doubles need no way over text; other types may hold words.
    typed = {c: F.col(c).cast("double") if kinds[c] in EXACT_TYPES else F.col(c).cast("string").try_cast("double") for c in BASE_NUMERIC}
    categories = {c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in BASE_CATEGORICAL}
    return snapshots.withColumns(typed | categories).withColumns(engineered_features()).select(*(keep or []), *PREDICTORS, *targets)


def label_domain(matrix: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """M1: label values other than 0, 1 and null, per label."""
    return matrix.agg(*[F.count_if(~F.col(t).isin(0, 1)).alias(t) for t in targets]).unpivot([], targets, "target", "invalid_labels")


def feature_manifest(matrix: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """M2: name, type, role, availability and notes of each column, with its missing values in this matrix."""
    def kind(c: str) -> str:
        if c in targets:
            return "target"
        return "categorical" if c in BASE_CATEGORICAL else "engineered_numeric" if c in ENGINEERED_NOTES else "numeric"

    columns = [c for c in PREDICTORS + targets if c in matrix.columns]
    rows = [
        (c, kind(c), "label" if c in targets else "predictor", "future_window" if c in targets else "snapshot_time",
         LABEL_NOTE if c in targets else ENGINEERED_NOTES.get(c, ""))
        for c in columns
    ]
    described = literal_table(
        matrix.sparkSession, rows, "feature string, feature_type string, model_role string, availability string, notes string"
    )
    missing = matrix.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "feature", "missing_values")
    return missing.join(F.broadcast(described), "feature")  # one row per column


def leakage_guard(columns: list[str], matrix: DataFrame) -> DataFrame:
    """M3: forbidden columns among the chosen predictors, over how many rows; no row means no leak."""
    leaks = sorted(set(columns) & set(FORBIDDEN_PREDICTORS))
    counted = matrix.agg(row_count().alias("rows"))
    return counted.select(F.explode(F.array(*[F.lit(c) for c in leaks]).cast("array<string>")).alias("column"), "rows")


def alignment_check(features: DataFrame, snapshots: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """M4: features and snapshots matched by snapshot id: rows on one side only and labels that differ."""
    side = lambda df, name: df.select("snapshot_id", *[F.col(t).alias(f"{name}_{t}") for t in targets], F.lit(1).alias(name))
    joined = side(features, "f").join(side(snapshots, "s"), "snapshot_id", "full")
    both = F.col("f").isNotNull() & F.col("s").isNotNull()
    return joined.agg(
        F.count_if(F.col("s").isNull()).alias("only_in_features"), F.count_if(F.col("f").isNull()).alias("only_in_snapshots"),
        *[F.count_if(both & ~F.col(f"f_{t}").eqNullSafe(F.col(f"s_{t}"))).alias(f"mismatch_{t}") for t in targets],
    )


def project_split(snapshots: DataFrame) -> DataFrame:
    """M5: (project_id, project_start_date, split), 70/15/15 by start date then id, no project in two parts."""
    projects = snapshots.groupBy("project_id").agg(F.min("project_start_date").alias("project_start_date"))
    ranked = skew.positions(projects, [], [F.col("project_start_date").asc(), F.col("project_id").asc()])
    train = F.floor(F.col("total") * TRAIN_SHARE)
    validation = train + F.floor(F.col("total") * VALIDATION_SHARE)
    part = F.when(F.col("before") < train, "train").when(F.col("before") < validation, "validation").otherwise("test")
    return ranked.select("project_id", "project_start_date", part.alias("split"))


def with_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    return skew.lookup(rows, split.select("project_id", "split"), ["project_id"], "inner")


def split_summary(rows: DataFrame) -> DataFrame:
    """M6: projects, snapshots and start dates per part."""
    return rows.groupBy("split").agg(
        F.countDistinct("project_id").alias("projects"), row_count().alias("snapshots"),
        F.min("project_start_date").alias("earliest_project_start"), F.max("project_start_date").alias("latest_project_start"),
    )


def split_leaks(rows: DataFrame) -> DataFrame:
    """M6: projects found in more than one part."""
    parts = rows.groupBy("project_id").agg(F.countDistinct("split").alias("parts"))
    return parts.agg(F.count_if(F.col("parts") > 1).alias("leaked_projects"), row_count().alias("projects"))


def training_medians(train: DataFrame, numeric: list[str] = NUMERIC) -> dict[str, float]:
    """M7: exact median of each numeric predictor, the middle pair averaged; one number per column."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "feature", "x")
    found = skew.exact_quantiles(long, ["feature"], "x", [0.5]).collect()  # one row per numeric column
    return {r["feature"]: r["quantile"] for r in found}


def preprocessing(train: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = BASE_CATEGORICAL) -> Pipeline:
    """M7: median imputation; one-hot columns with unknown categories encoded as all zeros."""
    medians = training_medians(train, numeric)
    filled = [f"{c}__filled" for c in numeric]
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), {medians.get(c, 0.0)!r}D) AS {c}__filled" for c in numeric)
    indexed, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
        StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=filled + hot, outputCol="features"),
    ])


def fill_modes(df: DataFrame, train: DataFrame, categorical: list[str] = BASE_CATEGORICAL) -> DataFrame:
    """M7: missing categories become the most frequent training value (smallest on ties)."""
    long = train.select(*categorical).unpivot([], categorical, "feature", "v").filter("v is not null")
    counted = long.groupBy("feature", "v").agg(row_count().alias("n"))
    best = counted.groupBy("feature").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    modes = {r["feature"]: r["v"] for r in best.collect()}  # one row per categorical column
    return df.fillna(modes)


def prior_baseline(rows: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """M8: the training positive rate, used as everybody's probability."""
    train = rows.filter("split = 'train'").select(*targets).unpivot([], targets, "target", "y")
    return train.groupBy("target").agg(F.avg("y").alias("prior_probability"), row_count().alias("train_rows"))


def weights_of(train: DataFrame, target: str, scheme: str) -> tuple[float, float]:
    """The weights of the labels 0 and 1."""
    n, p = train.agg(row_count(), F.sum(F.col(target).cast("bigint"))).first()
    positives, negatives = max(int(p or 0), 1), max(n - int(p or 0), 1)
    return (n / (2.0 * negatives), n / (2.0 * positives)) if scheme == "balanced" else (1.0, negatives / positives)


def class_weights(train: DataFrame, target: str, scheme: str) -> DataFrame:
    """``balanced`` gives both classes half the weight; ``positive`` weighs positives by negatives per positive."""
    other, positive = weights_of(train, target, scheme)
    return train.withColumn("class_weight", F.when(F.col(target) == 1, positive).otherwise(other))


def _fit(classifier: Estimator, train: DataFrame, encoder: PipelineModel | None) -> PipelineModel:
    if encoder is None:
        return Pipeline(stages=[preprocessing(train), classifier]).fit(train)
    return PipelineModel([encoder, classifier.fit(train)])


def train_logistic(train: DataFrame, target: str, max_iter: int = 2000, encoder: PipelineModel | None = None) -> PipelineModel:
    """M9: L2-regularised logistic regression with balanced classes on raw feature scales.

    With the fitted M7 as ``encoder`` the rows are those it has encoded, so that several labels share one encoding.
    """
    weighted = class_weights(train, target, "balanced")
    rows = weighted.count()
    model = LogisticRegression(labelCol=target, weightCol="class_weight", maxIter=max_iter, tol=1e-9, regParam=1.0 / rows,
                               elasticNetParam=0.0, standardization=False)
    return _fit(model, weighted, encoder)


def train_boosted(train: DataFrame, target: str, trees: int = 350, encoder: PipelineModel | None = None) -> PipelineModel:
    """Gradient-boosted trees, grown by ``boosting``. ``encoder`` as in M9."""
    return train_boosted_labels(train, [target], trees, encoder)[target]


def train_boosted_labels(train: DataFrame, targets: list[str], trees: int = 350, encoder: PipelineModel | None = None) -> dict[str, PipelineModel]:
    """M10 for several labels of the same rows, which are read and kept once."""
    own = preprocessing(train).fit(train) if encoder is None else encoder
    rows = own.transform(train) if encoder is None else train
    models = [GBTClassifier(labelCol=target, weightCol="class_weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.85,
                            minInstancesPerNode=3, featureSubsetStrategy="0.85", seed=SEED) for target in targets]
    fitted = boosting.fit(rows, [(model, weights_of(train, target, "positive")) for model, target in zip(models, targets)])
    return {target: PipelineModel([own, model]) for target, model in zip(targets, fitted)}


def score(model: Transformer, rows: DataFrame, target: str, name: str, keep: list[str]) -> DataFrame:
    """(keep..., target, model, y_true, predicted_probability)."""
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select(
        *keep, F.lit(target).alias("target"), F.lit(name).alias("model"), F.col(target).cast("int").alias("y_true"),
        probability.alias("predicted_probability"),
    )


def score_prior(rows: DataFrame, prior: DataFrame, keep: list[str], targets: list[str] = TARGETS) -> DataFrame:
    """M15 for the prior baseline, all labels at once."""
    long = rows.select(*keep, *targets).unpivot(keep, targets, "target", "y_true")
    return long.join(F.broadcast(prior), "target").select(  # one row per label
        *keep, "target", F.lit("dummy").alias("model"), F.col("y_true").cast("int").alias("y_true"),
        F.col("prior_probability").alias("predicted_probability"),
    )


def stack_predictions(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def feature_importance(model: PipelineModel, scored: DataFrame, target: str) -> DataFrame:
    """Importance per encoded feature, named from the vector's slots."""
    attributes = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(target, names[i].replace("__filled", "").replace("__hot_", "_"), float(v)) for i, v in enumerate(values)]
    return literal_table(scored.sparkSession, rows, "target string, feature string, importance double")


# --- metrics over a long table (group..., id, y_true, predicted_probability) ---------------------------------


def classification_metrics(predictions: DataFrame, group: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Precision, recall and F1 at a threshold; 0 where undefined."""
    y, hit = F.col("y_true") == 1, F.col("predicted_probability") >= threshold
    counted = predictions.groupBy(*group).agg(
        row_count().alias("n"), F.count_if(y).alias("positives"), F.count_if(hit).alias("flagged"), F.count_if(y & hit).alias("true_positives")
    )
    tp, flagged, positives = F.col("true_positives"), F.col("flagged"), F.col("positives")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counted.select(
        *group, safe(tp, flagged).alias("precision"), safe(tp, positives).alias("recall"),
        safe(2 * tp, flagged + positives).alias("f1"), (positives / F.col("n")).alias("positive_rate"), "n", "positives",
    )


def ranking_metrics(predictions: DataFrame, group: list[str]) -> DataFrame:
    """ROC-AUC, average precision (step sum) and Brier score.

    Everything is a sum over distinct scores once the classes are counted per score.
    """
    p, y = F.col("predicted_probability"), F.col("y_true").cast("bigint")
    scores = predictions.groupBy(*group, "predicted_probability").agg(row_count().alias("n"), F.sum(y).alias("pos"))
    ranked = skew.prefix_sums(scores, group, [p.asc()], {"rows": F.col("n"), "hits": F.col("pos")})
    n, pos, positives = F.col("n"), F.col("pos"), F.col("hits_total")
    neg, negatives = n - pos, F.col("rows_total") - positives
    neg_before = F.col("rows_before") - F.col("hits_before")
    at_or_above, hits = F.col("rows_total") - F.col("rows_before"), positives - F.col("hits_before")
    both = (positives > 0) & (negatives > 0)
    terms = ranked.select(
        *group, n, positives.alias("positives"),
        F.when(both, pos * (neg_before + neg / 2.0) / (positives.cast("double") * negatives)).alias("auc_term"),
        F.when(both, pos / positives * (hits / at_or_above)).alias("ap_term"),
        (p * p * neg + (1 - p) * (1 - p) * pos).alias("square"),
    )
    return terms.groupBy(*group).agg(
        F.sum("auc_term").alias("roc_auc"), F.sum("ap_term").alias("pr_auc"), (F.sum("square") / F.sum("n")).alias("brier_score"),
        F.sum("n").alias("n"), F.max("positives").alias("positives"),
    )


def top_share_metrics(predictions: DataFrame, group: list[str], ident: str, share: float = TOP_SHARE) -> DataFrame:
    """Precision and recall among the riskiest share of rows; equal scores are taken in id order.

    Class counts per score tell where the share ends; only rows with exactly that score are ranked by id.
    """
    p, y = F.col("predicted_probability"), F.col("y_true").cast("bigint")
    scores = predictions.groupBy(*group, "predicted_probability").agg(row_count().alias("n"), F.sum(y).alias("pos"))
    ranked = skew.prefix_sums(scores, group, [p.desc()], {"rows": F.col("n"), "hits": F.col("pos")})
    k = F.greatest(F.lit(1), F.ceil(F.col("rows_total") * share))
    cut = F.broadcast(ranked.filter((F.col("rows_before") < k) & (k <= F.col("rows_before") + F.col("n"))).select(
        *group, "predicted_probability", k.alias("k"), (k - F.col("rows_before")).alias("needed"), "hits_before", "hits_total"
    ))  # one row per group
    tied = predictions.join(cut, [*group, "predicted_probability"]).select(*group, ident, y.alias("y"), "needed")
    placed = skew.positions(tied, group, [F.col(ident).asc()])
    taken = placed.groupBy(*group).agg(F.sum(F.when(F.col("before") < F.col("needed"), F.col("y")).otherwise(0)).alias("tied_hits"))
    hits = F.col("hits_before") + F.col("tied_hits")
    return cut.join(taken, group).select(
        *group, "k", (hits / F.col("k")).alias("precision_at_10pct"), F.try_divide(hits, F.col("hits_total")).alias("recall_at_10pct")
    )


def probability_bin(probability: Column) -> Column:
    """Number of the equal-width bin, from 1; the last one includes 1.0."""
    return sum(((probability >= e).cast("int") for e in BIN_EDGES[1:-1]), F.lit(1))


def _bin_stats(predictions: DataFrame, group: list[str]) -> DataFrame:
    p = F.col("predicted_probability")
    return predictions.groupBy(*group, probability_bin(p).alias("bin")).agg(
        row_count().alias("count"), F.avg(p).alias("mean_predicted_probability"), F.avg("y_true").alias("observed_positive_rate")
    )


def calibration_error(predictions: DataFrame, group: list[str]) -> DataFrame:
    """Expected calibration error over ten bins."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate"))
    return _bin_stats(predictions, group).groupBy(*group).agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece_10bin"))


def calibration_bins(predictions: DataFrame, group: list[str]) -> DataFrame:
    """Reliability table with empty bins kept."""
    stats = _bin_stats(predictions, group)
    edges = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(BIN_EDGES[i]).alias("lower_probability"),
                               F.lit(BIN_EDGES[i + 1]).alias("upper_probability")) for i in range(10)])
    bins = stats.select(*group).distinct().select(*group, F.inline(edges))
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate"))
    return bins.join(stats, [*group, "bin"], "left").fillna(0, subset=["count"]).withColumn("absolute_calibration_gap", gap)


def fit_platt(predictions: DataFrame) -> LogisticRegressionModel:
    """Logistic regression of the label on the logit of the raw probability, L2 with C = 1."""
    train = predictions.select(F.col("y_true").cast("double").alias("label"), logit(F.col("predicted_probability")).alias("x"))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(train)
    return LogisticRegression(regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(vectors)


def platt_artifact(spark: SparkSession, model: LogisticRegressionModel, target: str) -> DataFrame:
    """The calibrator as a one-row table, portable and readable by any job."""
    return literal_table(
        spark, [(target, "sigmoid", 1, PROBABILITY_EPSILON, float(model.coefficients[0]), float(model.intercept))],
        "target string, method string, version int, epsilon double, coefficient double, intercept double",
    )


def apply_platt(predictions: DataFrame, artifact: DataFrame) -> DataFrame:
    calibrators = F.broadcast(artifact.select("target", "coefficient", "intercept"))  # one row per label
    return predictions.join(calibrators, "target").withColumn(
        "predicted_probability", platt(F.col("predicted_probability"), F.col("coefficient"), F.col("intercept"))
    ).drop("coefficient", "intercept")


def pool_violators(blocks: Iterator[Block]) -> list[Block]:
    """Neighbouring blocks (least score, greatest score, weight, sum) in order, pooled until their means rise.

    Pooling is associative: the result over a sequence is the result over the results of its parts.
    """
    out: list[Block] = []
    for low, high, n, s in blocks:
        while out and out[-1][3] * n >= s * out[-1][2]:  # the mean before is not below this one
            low, _, more, sums = out.pop()
            n, s = n + more, s + sums
        out.append((low, high, n, s))
    return out


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each group of neighbouring ranges; rows come sorted by group and score."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for group, own in groupby(rows, itemgetter(0)):
        found = pool_violators(row[1:] for row in own)
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(found), pa.int64()), *[pa.array([x[k] for x in found], t) for k, t in enumerate(BLOCK_TYPES)]], BLOCK_NAMES)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Straight pieces of the fitted curve, from the blocks in order; the first and the last go on without end."""
    last = None
    for batch in batches:
        out = []
        for low, high, n, s in zip(*(c.to_pylist() for c in batch.columns)):
            value = s / n
            out.append((-float("inf"), low, value, value) if last is None else (last[0], low, last[1], value))
            out.append((low, high, value, value))
            last = high, value
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.float64()) for k in range(4)], SEGMENT_NAMES)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (last[0], float("inf"), last[1], last[1])], SEGMENT_NAMES)


def fit_isotonic(predictions: DataFrame) -> DataFrame:
    """Monotone fit as a stored table of straight pieces (start, stop, start_value, stop_value); without rows, none.

    Rows are counted per score, which leaves the solution unchanged. Each range of scores pools its violators on its own, then
    ``RANGES_TOGETHER`` neighbouring ranges at a time are pooled until one is left; only blocks travel, and the driver gets
    the number of ranges alone.
    """
    merged = predictions.groupBy("predicted_probability").agg(row_count().alias("n"), F.sum(F.col("y_true").cast("double")).alias("s")).filter("s is not null")
    p = F.col("predicted_probability").cast("double")
    blocks = merged.select(p.alias("low"), p.alias("high"), F.col("n").cast("double").alias("n"), "s").repartitionByRange("low").select(
        F.spark_partition_id().cast("bigint").alias("part"), *BLOCK_NAMES[1:]).sortWithinPartitions("part", "low")
    pooled = durable(blocks.mapInArrow(_pooled, BLOCK))
    while (pooled.agg(F.countDistinct("part")).first()[0] or 0) > 1:
        grouped = pooled.withColumn("part", F.floor(F.col("part") / RANGES_TOGETHER).cast("bigint")).repartition("part").sortWithinPartitions("part", "low")
        pooled = durable(grouped.mapInArrow(_pooled, BLOCK))
    return durable(pooled.select(*BLOCK_NAMES[1:]).coalesce(1).sortWithinPartitions("low").mapInArrow(_segments, ", ".join(f"{c} double" for c in SEGMENT_NAMES)))


def apply_isotonic(predictions: DataFrame, model: DataFrame) -> DataFrame:
    """Interpolate on the fitted curve: rows meet the pieces that touch their bucket of scores, then the one they are on."""
    bucket = lambda x: F.floor(clip(x, 0.0, 1.0) * SCORE_BUCKETS).cast("int")
    x, start, stop = F.col("predicted_probability"), F.col("start"), F.col("stop")
    spread = model.select("*", F.explode(F.sequence(bucket(start), bucket(stop))).alias("__bucket"))
    # Pieces share their ends, where they agree; a row on one belongs to the piece that ends there.
    joined = predictions.withColumn("__bucket", bucket(x)).join(spread, "__bucket").filter((x > start) & (x <= stop))
    flat = (F.col("start_value") == F.col("stop_value")) | (start == float("-inf")) | (stop == float("inf"))
    value = F.when(flat, F.col("stop_value")).otherwise(F.col("start_value") + (F.col("stop_value") - F.col("start_value")) * (x - start) / (stop - start))
    return joined.withColumn("predicted_probability", clip(value, 0.0, 1.0)).drop("__bucket", *SEGMENT_NAMES)


def calibration_metrics(predictions: DataFrame, group: list[str]) -> DataFrame:
    """Ranking metrics and calibration error per method."""
    return ranking_metrics(predictions, group).join(calibration_error(predictions, group), group)


# --- labels -------------------------------------------------------------------------------------------------


def forward_labels(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """1 when the project's first delay lies 1 to h days ahead; 0 once it has happened or if it never does."""
    ahead = F.col("first_delay_day") - F.col("days_since_project_start")
    return skew.lookup(snapshots, outcomes.select("project_id", "first_delay_day"), ["project_id"]).withColumns({
        t: F.coalesce(ahead.between(1, h).cast("int"), F.lit(0)) for t, h in HORIZON_DAYS.items()
    })


def project_outcomes(labelled: DataFrame) -> DataFrame:
    """Observation window, final stage, delay and label counts per project."""
    last = F.struct("snapshot_date", "snapshot_id")
    day = F.col("first_delay_day")
    grouped = labelled.groupBy("project_id").agg(
        row_count().alias("total_snapshots"), F.min("project_start_date").alias("observation_start_date"),
        F.max("snapshot_date").alias("observation_end_date"), F.max_by("current_stage", last).alias("final_stage"),
        F.max(day).alias("first_delay_day"), F.max("days_since_project_start").alias("__days"),
        *[F.sum(t).alias(f"delay_{h}_event_count") for t, h in HORIZON_DAYS.items()],
    )
    delayed = F.coalesce(day <= F.col("__days"), F.lit(False))
    return grouped.withColumns({
        "delayed": delayed.cast("int"), "delay_days": F.when(delayed, F.col("__days") - day).otherwise(0),
    }).withColumn("first_delay_day", F.when(delayed, day)).drop("__days")
