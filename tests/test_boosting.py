"""The trees of ``boosting`` against Spark's own trainer, and the same trees from one task, many tasks and lost folders."""

import shutil

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from landpulse.operators import boosting as bo, modeling as md

TARGET = "delay_next_90d"


@pytest.fixture(scope="module")
def encoded(spark):
    """Two numbers of many values, one of few, a category of three; no two of them tell the same."""
    rng = np.random.default_rng(4)
    n = 3000
    a, b, c, k = rng.random(n), rng.normal(size=n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    y = (rng.random(n) < 0.1 + 0.5 * (a > 0.6) * (b < 0.3) + 0.2 * (k == 1)).astype(int)
    z = (rng.random(n) < 0.05 + 0.3 * (c == 2)).astype(int)
    rows = [(float(p), float(q), float(r), "xyz"[s], int(t), int(u)) for p, q, r, s, t, u in zip(a, b, c, k, y, z)]
    df = spark.createDataFrame(rows, f"a double, b double, c double, k string, {TARGET} int, delay_next_30d int").coalesce(1)
    return md.preprocessing(df, ["a", "b", "c"], ["k"]).fit(df).transform(df).select("features", TARGET, "delay_next_30d").cache()


def classifier(trees, target=TARGET):
    return GBTClassifier(labelCol=target, weightCol="class_weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.85, minInstancesPerNode=3,
                         featureSubsetStrategy="0.85", seed=md.SEED)


def scores(model, rows):
    return [r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect()]


def shape(model):
    return [line for tree in model.trees for line in tree.toDebugString.split("\n")[1:]]


def test_draws_are_sparks(spark):
    own = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom
    for seed, n in ((5, 1), (md.SEED + 1, 40), (md.SEED + 351, 3001)):
        java = own(seed)
        assert bo.drawn(seed, n, 0.85).tolist() == [java.nextDouble() < 0.85 for _ in range(n)]
    java = spark.sparkContext._jvm.scala.util.Random(md.SEED)
    sampling = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.util.random, "SamplingUtils$"), "MODULE$")
    found = bo.Features(md.SEED, 38, 33)
    tag = spark.sparkContext._jvm.scala.reflect.ClassTag.Int()
    numbers = getattr(getattr(spark.sparkContext._jvm.scala.collection.immutable, "Range$"), "MODULE$").apply(0, 38)
    for _ in range(3):
        assert found.draw() == list(sampling.reservoirSampleAndCount(numbers.iterator(), 33, java.nextLong(), tag)._1())


@pytest.mark.parametrize("parts", [1, 3])
def test_few_rows_give_sparks_own_trees(spark, encoded, parts):
    encoded = encoded.repartition(parts).cache()
    weights = md.weights_of(encoded, TARGET, "positive")
    own = bo.fit(encoded, [(classifier(12), weights)])[0]
    other = classifier(12).fit(md.class_weights(encoded, TARGET, "positive"))
    if parts == 1:
        assert shape(own) == shape(other)
    assert scores(own, encoded) == pytest.approx(scores(other, encoded), abs=1e-12)
    assert own.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray(), abs=1e-12)
    assert own.treeWeights == other.treeWeights and own.getLabelCol() == TARGET and own.getMaxIter() == 12


def test_rounds_of_few_rows_are_no_jobs(spark, encoded):
    """Spark's trainer runs a job for every level of every tree."""
    context = spark.sparkContext
    jobs = []
    for trees in (2, 9):
        context.setJobGroup(f"boosted {trees}", "")
        md.train_boosted(encoded, TARGET, trees, md.PipelineModel([]))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"boosted {trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_joint_histograms_give_the_same_trees(spark, encoded, monkeypatch):
    weights = md.weights_of(encoded, TARGET, "positive")
    plain = bo.fit(encoded, [(classifier(6), weights)])[0]
    monkeypatch.setattr(bo, "FEW_ROWS", 100)
    joint = bo.fit(encoded, [(classifier(6), weights)])[0]
    assert scores(joint, encoded) == pytest.approx(scores(plain, encoded), abs=1e-9)
    assert joint.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-9)


def test_many_tasks_fit_what_one_does(spark, encoded, monkeypatch):
    """Without draws the trees do not depend on where a row is; two labels at once, and a task whose folder is gone."""
    targets = [TARGET, "delay_next_30d"]
    wanted = [(classifier(4, t).setSubsamplingRate(1.0), md.weights_of(encoded, t, "positive")) for t in targets]
    alone = bo.fit(encoded, wanted)
    for name, value in (("FEW_ROWS", 100), ("ONE_TASK", 100), ("MANY_ROWS", 1000)):
        monkeypatch.setattr(bo, name, value)
    opened, lost = [], []
    step, begin = bo.Spread._step, bo.Spread.open

    def losing(self, asked):
        if len(self.done) == 6 and not lost:
            lost.append(self.handles.collect()[0][1])
            shutil.rmtree(lost[0])
        return step(self, asked)

    def opening(self):
        begin(self)
        opened.append([folder for _, folder in self.handles.collect()])

    monkeypatch.setattr(bo.Spread, "_step", losing)
    monkeypatch.setattr(bo.Spread, "open", opening)
    spread = bo.fit(encoded, wanted)
    assert len(opened) == 2 and len(opened[0]) == 3 and lost
    for one, many in zip(alone, spread):
        assert scores(many, encoded) == pytest.approx(scores(one, encoded), abs=1e-9)
    assert not any(bo.os.path.exists(folder) for folders in opened for folder in folders)


def test_labels_that_are_no_labels_are_refused(spark, encoded):
    odd = encoded.withColumn(TARGET, F.when(F.col(TARGET) == 1, F.lit(None)).otherwise(F.col(TARGET)))
    with pytest.raises(Exception):
        bo.fit(odd, [(classifier(2), (1.0, 2.0))])
