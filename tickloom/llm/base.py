"""Registry of the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class LlmQuery:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


LLM_QUERIES: dict[str, LlmQuery] = {}


def llm_query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under ``name``; ``sql`` is its twin where SQL can express it."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = LlmQuery(name, run, sql)
        return run

    return register
