"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "secret_scan", "jaccard_join", "suffix_dedup", "toxicity", "quality_fm", "line_rules", "site_lines", "token_store", "packing", "turn_repair", "hard_negatives", "html_extract"]


def load():
    for module in MODULES:
        import_module(f"landpulse.llm.{module}")
    tables = import_module("landpulse.llm.tables")
    pipeline = import_module("corpus_pipeline")
    named, checks = dict(tables.QUERIES), dict(tables.ORACLES)
    named["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        checks["pipeline"] = pipeline.ORACLE_SQL
    return named, checks
