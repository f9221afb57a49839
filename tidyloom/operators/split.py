"""Split of one wide table into entity, metrics and dimension tables that share an id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import AUTO_ID, ROW_SEQ, CleanConfig
from tidyloom.operators.columns import NUMERIC_TYPES, TEMPORAL_TYPES, quoted
from tidyloom.operators.keys import (
    ColumnStats,
    add_surrogate_id,
    attribute_columns,
    column_stats,
    detect_relaxed_id,
    rank_by_cardinality,
)


@dataclass(frozen=True)
class SplitResult:
    full: DataFrame
    entity: DataFrame
    metrics: DataFrame
    dimension: DataFrame
    id_column: str


def metric_columns(df: DataFrame, id_column: str) -> list[str]:
    """The id, all numbers and dates, and whatever is named after a date or time."""
    chosen = [
        f.name for f in df.schema
        if isinstance(f.dataType, (NUMERIC_TYPES, *TEMPORAL_TYPES))
        or "date" in f.name.lower() or "time" in f.name.lower()
    ]
    return list(dict.fromkeys([id_column, *chosen]))


def entity_columns(
    df: DataFrame, id_column: str, top: int = 3, stats: ColumnStats | None = None
) -> list[str]:
    """The id and the attributes with the fewest distinct values."""
    names = [c for c in attribute_columns(df) if c != id_column]
    return [id_column] + [c for c, _ in rank_by_cardinality(df, names, top, stats)]


def dimension_columns(df: DataFrame, id_column: str, used: set[str]) -> list[str]:
    """The id and the text columns no other table took."""
    return [id_column] + [
        f.name for f in df.schema
        if f.name != id_column and f.name not in used and isinstance(f.dataType, T.StringType)
    ]


def split_tables(
    df: DataFrame, config: CleanConfig = CleanConfig(), stats: ColumnStats | None = None
) -> SplitResult:
    """Choose the id, adding a surrogate where no column qualifies, and project the three tables.

    All three come from one frame.  Hand in a materialized one: each then reads only its own columns.
    """
    stats = stats or column_stats(df, config)
    if stats.rows == 0:
        return SplitResult(df, df, df, df, "id")
    id_column = detect_relaxed_id(df, config, stats)
    if id_column is None:
        id_column, df = AUTO_ID, add_surrogate_id(df)

    def project(names: list[str]) -> DataFrame:
        return df.select(*[F.col(quoted(c)) for c in names])

    metrics = metric_columns(df, id_column)
    entity = entity_columns(df, id_column, config.entity_columns, stats)
    dimension = dimension_columns(df, id_column, {*metrics, *entity})
    metrics = [c for c in metrics if c != ROW_SEQ]
    return SplitResult(df, project(entity), project(metrics), project(dimension), id_column)
