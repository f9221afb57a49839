"""Column-set operators: names, noise columns, technical columns, projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import NOISE_NAME_PREFIXES, ROW_SEQ, TECHNICAL_COLS
from tidyloom.functions.dates import render_date
from tidyloom.functions.names import clean_name, unique_names

NUMERIC_TYPES = T.NumericType
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    """Column reference that survives dots, spaces and backquotes in the name."""
    return f"`{name.replace('`', '``')}`"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TECHNICAL_COLS]


def name_mapping(columns: Iterable[str]) -> list[tuple[str, str]]:
    """Pairs of raw and clean name, in column order; technical columns keep theirs."""
    raw = list(columns)
    kept = [c for c in raw if c in TECHNICAL_COLS]
    fresh = unique_names(kept + [clean_name(c) for c in raw if c not in TECHNICAL_COLS])[len(kept):]
    names = iter(fresh)
    return [(c, c if c in TECHNICAL_COLS else next(names)) for c in raw]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns by position, so names that differ only in case stay apart."""
    return df.toDF(*[clean for _, clean in name_mapping(df.columns)])


def noise_named(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c.startswith(NOISE_NAME_PREFIXES)]


def drop_noise_named(df: DataFrame) -> DataFrame:
    """Drop left-over row-index columns such as ``unnamed_0``."""
    return df.drop(*noise_named(df.columns))


def empty_columns(df: DataFrame, columns_per_job: int = 100) -> list[str]:
    """Columns without a single value; none if the frame has no rows.  One aggregate per ``columns_per_job``."""
    names = df.columns
    empty: list[str] = []
    for start in range(0, len(names), columns_per_job):
        chunk = names[start:start + columns_per_job]
        counts = df.agg(
            F.count(F.lit(1)), *[F.count(F.col(quoted(c))) for c in chunk]
        ).head()
        if counts[0]:
            empty += [c for c, n in zip(chunk, counts[1:]) if n == 0]
    return empty


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def drop_technical(df: DataFrame) -> DataFrame:
    return df.drop(ROW_SEQ)


def project_raw_columns(df: DataFrame, raw_columns: Iterable[str], mapping: Mapping[str, str]) -> DataFrame:
    """Keep the cleaned counterparts of ``raw_columns`` that are still there, in their order."""
    wanted = [mapping.get(c, c) for c in raw_columns]
    return df.select(*[F.col(quoted(c)) for c in wanted if c in df.columns])


def dates_to_text(df: DataFrame) -> DataFrame:
    """Render every date and timestamp column as ISO date text."""
    return df.select(*[
        render_date(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, TEMPORAL_TYPES)
        else F.col(quoted(f.name))
        for f in df.schema
    ])


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, leaving all typing to the cleaner."""
    return df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])


def typed_voids(df: DataFrame) -> DataFrame:
    """Columns of nulls without a type become text, so that they can be stored."""
    voids = {f.name: F.col(quoted(f.name)).cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)}
    return df.withColumns(voids) if voids else df


def tag_rows(df: DataFrame) -> DataFrame:
    """Add the row sequence that later decides which duplicate survives."""
    return df if ROW_SEQ in df.columns else df.withColumn(ROW_SEQ, F.monotonically_increasing_id())


def tag_in_order(df: DataFrame, place: list[str], moved: bool) -> DataFrame:
    """Replace the ``place`` columns, which say where each row stood in its source, by the row sequence.

    Rows that were not ``moved`` still lie in that order and are numbered where they are.  Others are dealt out by
    range first; rows of one place come from one task, in the order it gave them.
    """
    if moved:
        local = df.withColumn("__local", F.monotonically_increasing_id())
        df = local.repartitionByRange(*place).sortWithinPartitions(*place, "__local").drop("__local")
    return df.withColumn(ROW_SEQ, F.monotonically_increasing_id()).drop(*place)
