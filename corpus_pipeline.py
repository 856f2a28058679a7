"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared folder and
reads it back as the next stage's documents. Every stage works on all rows it gets, its decisions take effect, and all
but the last return the columns of ``documents``. There is no SQL for the whole chain, as decontamination and packing
have none; tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm import decontaminate, jaccard_join, line_rules, packing, site_lines
from landpulse.session import durable

NEAR_WORDS, NEAR_PER_CENT = 5, 80  # shingle size and least similarity of near duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are rejected."""
    return _sized(line_rules.clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents without any text left go."""
    kept = site_lines.drop_lines(docs, "source", "text").filter((F.col("__part") >= 0) & ((F.col("__dropped") == 0) | (F.col("__dropped") < F.col("__lines"))))
    changed = F.when(F.col("__dropped") > 0, F.col("__kept")).otherwise(F.col("text"))
    return _sized(kept.select(*[(changed if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of least doc_id stays; rows without an id come last.

    Rows whose id is null, negative or repeated are linked like all others: they are stored once under numbers of their own.
    Of equal rows one stays. Documents without words are similar to nothing and all stay.
    """
    odd = durable(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null or doc_id < 0").select(F.col("doc_id").alias("__odd")))
    same = F.col("doc_id").eqNullSafe(F.col("__odd"))
    numbered = durable(docs.join(odd, same, "left_semi").withColumn("__key", -2 - F.monotonically_increasing_id()))
    keyed = docs.join(odd, same, "left_anti").withColumn("__key", F.col("doc_id").cast("long")).unionByName(numbered)
    linked = durable(jaccard_join.link(keyed.select(F.col("__key").alias("doc_id"), "text"), size=NEAR_WORDS, threshold=NEAR_PER_CENT))
    named = linked.select(F.col("doc_id").alias("__key"), "component_id").join(numbered.select("__key", F.col("doc_id").alias("own")), "__key", "left").select(
        "component_id", F.struct((F.col("__key") < 0) & F.col("own").isNull(), F.when(F.col("__key") < 0, F.col("own")).otherwise(F.col("__key")), F.col("__key").alias("key")).alias("least"))
    stays = durable(named.groupBy("component_id").agg(F.min("least").alias("least")).select(F.col("least.key").alias("__key")))
    return keyed.join(stays, "__key", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents stands in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
