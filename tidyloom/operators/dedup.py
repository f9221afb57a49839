"""Duplicate removal that survives hot keys and is the same on every run.

Both forms are plain grouped minima.  Spark reduces them map-side before the shuffle, so a row or key that makes up a
third of the table reaches the reducer once per map task and never as one big group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.config import ROW_SEQ
from tidyloom.operators.columns import data_columns, quoted


def dedup_full(df: DataFrame) -> DataFrame:
    """One row per distinct content; the lowest row sequence stays."""
    names = data_columns(df)
    if ROW_SEQ not in df.columns:
        return df.dropDuplicates(names) if names else df
    # Rows without any data column are all alike, and no rows stay no rows.
    keys = [F.col(quoted(c)) for c in names] or [F.lit(1).alias("__all")]
    return df.groupBy(*keys).agg(F.min(ROW_SEQ).alias(ROW_SEQ)).select(*[F.col(quoted(c)) for c in df.columns])


def dedup_subset(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """One row per distinct value of ``subset``: the one with the lowest row sequence.

    The least sequence of each key is a hashed aggregate of numbers; only the rows it names are then fetched by their
    sequence, which must be unique.  So whole rows are neither sorted nor kept as aggregates, and no key is a join key.
    Without a row sequence the smallest remaining columns decide, which keeps the result repeatable.
    """
    keys = [c for c in subset if c in data_columns(df)]
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if ROW_SEQ in rest:
        least = df.groupBy(*[F.col(quoted(c)) for c in keys]).agg(F.min(ROW_SEQ).alias(ROW_SEQ)).select(ROW_SEQ)
        return df.join(least, ROW_SEQ, "left_semi").select(*[F.col(quoted(c)) for c in df.columns])
    survivor = F.min(F.struct(*[F.col(quoted(c)) for c in rest])).alias("__row")
    kept = df.groupBy(*[F.col(quoted(c)) for c in keys]).agg(survivor)
    return kept.select(*[
        F.col(quoted(c)) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns
    ])


def dedup_report(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """One row: rows in, duplicates removed, rows out.  Both counts come from one grouping."""
    keys = [c for c in (subset or data_columns(df)) if c in data_columns(df)]
    groups = df.groupBy(*[F.col(quoted(c)) for c in keys]).agg(F.count(F.lit(1)).alias("n"))
    counted = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_out"))
    return counted.select(
        "rows_in", (F.col("rows_in") - F.col("rows_out")).alias("duplicates_removed"), "rows_out"
    )
