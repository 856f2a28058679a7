"""Small fixed tables as plan expressions: no Python rows are shipped, and their size is known to the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    empty = not rows
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in (rows or [tuple(None for _ in fields)])
    ]
    table = spark.range(1).select(F.inline(F.array(*structs)))
    return table.filter(F.lit(False)) if empty else table
