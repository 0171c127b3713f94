"""The registry of queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold a QUERIES dict of name -> (callable, SQL or None).
MODULES: tuple[str, ...] = ("corpus_cleaning", "duplicates", "training_data", "ledgers", "star", "planning", "models", "extras", "layout", "curriculum", "scripts", "evidence")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        part = importlib.import_module(f"lakeloom.plans.{name}").QUERIES
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict[str, Query]:
    return {name: call for name, (call, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
