"""Missing values: a number for numeric columns, a sentinel text for the rest, nothing for id columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import PRESENT_SENTINEL, SPARSE_SENTINEL, CleanConfig
from tidyloom.functions.dates import render_date
from tidyloom.functions.names import is_id_name
from tidyloom.operators.columns import NUMERIC_TYPES, TEMPORAL_TYPES, data_columns, quoted
from tidyloom.operators.quantiles import quantiles


def fillable_columns(df: DataFrame, config: CleanConfig) -> tuple[list[str], list[str]]:
    """Numeric and other columns that are not id-named."""
    numeric, other = [], []
    for name in data_columns(df):
        if not is_id_name(name, config.id_name_tokens):
            (numeric if isinstance(df.schema[name].dataType, NUMERIC_TYPES) else other).append(name)
    return numeric, other


def numeric_fills(
    df: DataFrame, columns: list[str], config: CleanConfig, at_most: int | None = None
) -> dict[str, float]:
    """Fill value per numeric column; a column without values gets none."""
    if not columns or config.numeric_impute == "none":
        return {}
    if config.numeric_impute == "mean":
        found = df.agg(*[F.avg(F.col(quoted(c))) for c in columns]).head()
    else:
        medians = quantiles(df, {c: [0.5] for c in columns}, config.quantile_error, config.exact_rows, at_most)
        found = [medians[c][0] for c in columns]
    return {c: float(v) for c, v in zip(columns, found) if v is not None}


def sentinel_fills(columns: list[str], rows: int, non_null: dict[str, int]) -> dict[str, str]:
    """Sentinel per column: one text where most rows hold a value, another where most do not."""
    return {c: PRESENT_SENTINEL if non_null[c] > rows / 2 else SPARSE_SENTINEL for c in columns} if rows else {}


def _text(c: Column, data_type: T.DataType) -> Column:
    return render_date(c) if isinstance(data_type, TEMPORAL_TYPES) else c.cast("string")


def apply_fills(df: DataFrame, numbers: dict[str, float], sentinels: dict[str, str]) -> DataFrame:
    """Fill in one projection.  Filled numbers become double, filled dates become ISO text."""
    out = []
    for field in df.schema:
        c = F.col(quoted(field.name))
        if field.name in numbers:
            c = F.coalesce(c.cast("double"), F.lit(numbers[field.name]))
        elif field.name in sentinels:
            c = F.coalesce(_text(c, field.dataType), F.lit(sentinels[field.name]))
        out.append(c.alias(field.name))
    return df.select(*out)


def impute(
    df: DataFrame,
    config: CleanConfig = CleanConfig(),
    rows: int | None = None,
    non_null: dict[str, int] | None = None,
) -> DataFrame:
    """Fill every non-id column.  Known row and value counts spare the counting aggregate."""
    numeric, other = fillable_columns(df, config)
    if config.date_missing == "null":
        other = [c for c in other if not isinstance(df.schema[c].dataType, TEMPORAL_TYPES)]
    if rows is None or non_null is None:
        counted = df.agg(F.count(F.lit(1)), *[F.count(F.col(quoted(c))) for c in other]).head()
        rows, non_null = counted[0], dict(zip(other, counted[1:]))
    return apply_fills(df, numeric_fills(df, numeric, config, rows), sentinel_fills(other, rows, non_null))
