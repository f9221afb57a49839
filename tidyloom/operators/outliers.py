"""Interquartile-range clamping.  Rows are never removed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.config import CleanConfig
from tidyloom.operators.columns import NUMERIC_TYPES, data_columns, quoted
from tidyloom.operators.quantiles import quantiles


def clamp_outliers(
    df: DataFrame, columns: Iterable[str] | None = None, config: CleanConfig = CleanConfig()
) -> DataFrame:
    """Clamp each numeric column to ``[Q1 - k*IQR, Q3 + k*IQR]``; nulls stay null, results are double.

    All quartiles come from the same passes, whatever the number of columns.
    """
    if columns is None:
        columns = [c for c in data_columns(df) if isinstance(df.schema[c].dataType, NUMERIC_TYPES)]
    quartiles = quantiles(df, {c: [0.25, 0.75] for c in columns}, config.quantile_error, config.exact_rows)
    out = []
    for name in df.columns:
        c = F.col(quoted(name))
        q1, q3 = quartiles.get(name, (None, None))
        if q1 is not None:
            reach = config.outlier_iqr_factor * (q3 - q1)
            number = c.cast("double")
            c = F.when(c.isNotNull(), F.least(F.greatest(number, F.lit(q1 - reach)), F.lit(q3 + reach)))
        out.append(c.alias(name))
    return df.select(*out)
