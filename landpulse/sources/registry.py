"""Readers of registry CSV files."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse import schemas
from landpulse.functions.literals import literal_table
from landpulse.functions.numeric import whole_number


HEADERS_AT_ONCE = 32


def column_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of every file; contents are not read, and Spark lists many folders in parallel."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file in any store that Spark reads, unpacked if its name says so; None if it cannot be read.

    Only the first buffer of the file is fetched.
    """
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = place.getFileSystem(settings).open(place)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(place)
            plain = stream if codec is None else codec.createInputStream(stream)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()
    except Py4JJavaError:
        return None


def first_lines(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int, str | None]]:
    """(path, length, first line) of every file that is not empty, headers fetched side by side.

    The driver gets file names and headers, as it gets names and lengths whenever Spark lists files.
    """
    files = [(r["path"], r["length"]) for r in listed_files(spark, paths).filter("length > 0").orderBy("path").collect()]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return [(path, length, line) for (path, length), line in zip(files, pool.map(lambda f: first_line(spark, f[0]), files))]


def csv_layouts(spark: SparkSession, paths: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """(columns, files) of each different header."""
    layouts: dict[str, list[str]] = {}
    for path, _, line in first_lines(spark, paths):
        if line is not None:
            layouts.setdefault(line, []).append(path)
    return [(next(csv.reader([line.lstrip("\ufeff")]), []), files) for line, files in sorted(layouts.items())]


def skipped_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of the files that ``scan_csv_files`` leaves out, as they cannot be read.

    Files of length zero have neither header nor rows; Spark's readers pass over them, and so does this table.
    """
    unread = [(path, length) for path, length, line in first_lines(spark, paths) if line is None]
    return literal_table(spark, unread, "path string, length bigint")


def _read_layout(spark: SparkSession, columns: list[str], files: list[str], schema: str, line_breaks: bool) -> DataFrame:
    own = ", ".join(f"`{c}` string" for c in columns)
    table = spark.read.schema(own).option("ignoreCorruptFiles", "true").csv(
        files, header=True, quote='"', escape='"', multiLine=line_breaks, encoding="UTF-8")
    return table.select(*[F.col(f"`{c}`") if c in columns else F.lit(None).cast("string").alias(c) for c in column_names(schema)])


def scan_csv_files(spark: SparkSession, pattern: str | list[str], schema: str, line_breaks: bool = False, required: list[str] | None = None) -> DataFrame:
    """Every file matching a glob, columns taken by the names in each file's own header.

    Of each file the header is fetched first, then every file is read once, with the files of its layout. A column that a layout lacks is null, unless it is ``required``: then this raises.
    Header-only files give no rows; ``skipped_files`` names those that cannot be read. ``line_breaks`` allows line
    breaks inside quotes, at the price of one task per file.
    """
    parts = []
    for columns, files in csv_layouts(spark, pattern):
        missing = [c for c in required or [] if c not in columns]
        if missing:
            raise ValueError(f"{files[0]} and {len(files) - 1} more: missing required columns: {', '.join(missing)}")
        parts.append(_read_layout(spark, columns, files, schema, line_breaks))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def read_text_csv(spark: SparkSession, paths: str | list[str], schema: str, line_breaks: bool = False, required: list[str] | None = None) -> DataFrame:
    """All-string CSV with a header and doubled quotes, read by column name; a missing path raises."""
    return scan_csv_files(spark, paths, schema, line_breaks, required)


def union_layouts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables whose column sets differ, matching columns by name."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def lenient_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast known columns; '' and unreadable values become null."""
    types = schemas.TYPED if types is None else types
    return df.withColumns({
        c: whole_number(F.col(c), t) if t in ("int", "bigint") else F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(t)
        for c, t in types.items() if c in df.columns
    })


def read_registry_table(spark: SparkSession, pattern: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Glob scan, required-column contract and lenient types in one step."""
    return lenient_types(scan_csv_files(spark, pattern, schema, required=required or ["project_id"]))


def read_policy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small policy table, whole numbers typed as the schema says."""
    names = column_names(schema)
    kinds = {c: part.split()[1] for c, part in zip(names, schema.split(", "))}
    text = read_text_csv(spark, path, ", ".join(f"{c} string" for c in names))
    return text.withColumns({c: whole_number(F.col(c), k) for c, k in kinds.items() if k in ("int", "bigint")})


# The two transitions without a benchmark yet, and the two statutory deadlines.
STAGE_POLICY = [
    ("3a_to_3A", "3a", "3A", "empirical_pending", None, "LOW", 100, "NO"),
    ("3A_to_3D", "3A", "3D", "empirical_pending", None, "LOW", 100, "NO"),
]
LEGAL_POLICY = [
    ("RFCTLARR_S15", "Objections", "Preliminary Notification", "Objection Submission", "60", "statutory"),
    ("RFCTLARR_S19", "Declaration", "Section 11 Preliminary Notification", "Section 19 Declaration", "365", "statutory"),
]


def stage_policy(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, STAGE_POLICY,
        "stage_transition string, from_stage string, to_stage string, benchmark_type string, benchmark_days int, "
        "confidence string, minimum_observations_required int, usable_for_ml_label string",
    )


def legal_policy(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, LEGAL_POLICY,
        "rule_id string, process_area string, from_event string, to_event string, deadline_days string, "
        "deadline_type string",
    )
