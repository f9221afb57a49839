"""Registered queries: each dirties a table by rule, runs an operator, and states the expected result as SQL.

The tables are clean, so the SQL says what must come out from the clean source instead of repeating the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        REGISTRY[name] = Entry(query, sql)
        return query

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def titled(x: str) -> str:
    """SQL for title case by words."""
    return (f"list_aggregate(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')")
