"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changes, corpus, finding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus.QUERIES | finding.QUERIES | changes.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus.SQL | finding.SQL | changes.SQL
