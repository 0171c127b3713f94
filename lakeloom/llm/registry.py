"""Queries opN_<name> of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with NAME, query(spark, sf_dir) and ORACLE_SQL (None where SQL cannot express the query).
MODULES = ("bpe", "exact_dedup", "secret_scan", "mixture", "warc", "langid", "flac", "license_scan", "line_dedup", "near_dup")


def _modules():
    return [importlib.import_module(f"lakeloom.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
