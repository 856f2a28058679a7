"""Registration of named queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6  # doubles are compared to six decimals: sums of floats depend on their order


class Tables:
    """The parquet tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # the footer is read once per query
        return table

    def sql(self, template: str) -> DataFrame:
        """Run SQL whose ``{table}`` placeholders are tables of this folder; see ``adapters``."""
        names = [n for n in ("orders", "lineitem", "customer", "nation", "events", "pages", "documents") if f"{{{n}}}" in template]
        return self.spark.sql(template, **{n: getattr(self, n) for n in names})


def comparable(df: DataFrame, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Dates as ISO text, decimals and whole numbers that may be null as doubles, doubles rounded."""
    def plain(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if field.name in nullable:
            return value.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return value.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(value.cast("double"), DIGITS).alias(field.name)
        return value

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, nullable: tuple[str, ...] = ()):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: comparable(build(Tables(spark, folder)), nullable)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(expression: str) -> str:
    """SQL rounding that matches ``comparable``; adding zero turns -0 into 0."""
    return f"(ROUND(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0)"


def iso(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"
