"""Writers (S6-S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The columns of the register export, in order.
REGISTER_COLUMNS = [
    "project_id", "project_name", "state", "district", "implementing_agency", "project_type", "current_stage",
    "days_in_current_stage", "risk_band", "risk_30d", "risk_60d", "risk_90d", "trend", "snapshot_date",
]


ROWS_PER_FILE = 5_000_000


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "csv", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per value of ``by``.

    The rebalance hint brings a value's rows together and lets adaptive execution cut only values that are too large
    for one task; no file gets more than ``rows_per_file`` rows.
    """
    spread = df.hint("rebalance", *[F.col(c) for c in by])
    spread.write.mode("overwrite").partitionBy(*by).option("header", "true").option("escape", '"').option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table; CSV gets a header."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').format(fmt).save(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def register_export(projects: DataFrame, risks: DataFrame) -> DataFrame:
    """Latest state of every project with its risk, in the 14 export columns."""
    from_risk = [c for c in REGISTER_COLUMNS if c in risks.columns and c != "project_id"]
    kept = projects.drop(*from_risk)
    return kept.join(risks.select("project_id", *from_risk), "project_id", "left").select(*REGISTER_COLUMNS)


def write_register(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
