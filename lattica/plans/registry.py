"""All queries of the core, collected from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("q_text", "q_graph", "q_retrieval", "q_eval", "q_build", "q_more", "q_plan", "q_score", "q_files")

Query = Callable[[SparkSession, str], DataFrame]


def _each():
    for name in MODULES:
        yield importlib.import_module(f"lattica.plans.{name}")


def queries() -> dict[str, Query]:
    return {k: f for m in _each() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _each() for k, s in m.SQL.items()}
