"""Checks that stop a job early: required, forbidden and unique columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def forbid_columns(columns: Iterable[str], forbidden: Iterable[str], name: str = "table") -> None:
    present = sorted(set(columns) & set(forbidden))
    if present:
        raise ValueError(f"{name} contains forbidden columns: {', '.join(present)}")


def duplicate_count(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier row's key."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def require_unique(df: DataFrame, key: list[str], name: str = "table") -> DataFrame:
    """Raise if a key repeats; stands in for one-to-one join validation."""
    repeated = df.groupBy(*key).count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{name} has duplicate keys in {', '.join(key)}")
    return df


def unique_rows(df: DataFrame, key: list[str], name: str = "table") -> DataFrame:
    """The same rows, one per key; a repeated key raises when the rows are computed, so no extra job is needed."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row"))
    repeated = F.raise_error(F.lit(f"{name} has duplicate keys in {', '.join(key)}"))
    return counted.select(F.when(F.col("__n") > 1, repeated.cast(df.select(row.alias("r")).schema["r"].dataType)).otherwise(F.col("__row")).alias("__row")).select("__row.*")


def present(column: str, name: str = "table") -> Column:
    """The column, raising where it is null."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{name} has missing or invalid values in {column}")).cast("date"))


def require_values(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """Raise if a column has nulls; snapshots, cycles and transitions need every event to carry a date."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    empty = {c: counted[c] for c in columns if counted[c]}
    if empty:
        raise ValueError(f"{name} has missing or invalid values: {empty}")
    return df
