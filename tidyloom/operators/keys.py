"""Key detection, surrogate ids, ordering by key and cardinality ranking."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import AUTO_ID, ROW_SEQ, CleanConfig
from tidyloom.functions.names import is_id_name
from tidyloom.operators.columns import NUMERIC_TYPES, TEMPORAL_TYPES, data_columns, quoted
from tidyloom.storage import materialize, sized_shuffles

SKETCH_LG_K = 14
# The sketch's standard error is below 1 %, so an estimate off by more than this is a ten-sigma event; closer calls are
# settled by an exact count.
SKETCH_MARGIN = 0.1
SKETCH_GROUPS = 64


def _sketchable(c: Column, data_type: T.DataType) -> Column:
    return c if isinstance(data_type, (T.IntegerType, T.LongType, T.StringType)) else c.cast("string")


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``column, n``: exact numbers of distinct values, one row per column.

    Each column is grouped by its own values, which are reduced where they lie and then meet in partitions of their hash;
    what is left of a partition is one number.  Counting them all in one aggregate would expand every row into as many
    rows as there are columns.
    """
    def one(column: str) -> DataFrame:
        values = df.select(F.col(quoted(column)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("one"))
        return values.agg(F.count("*").alias("n")).select(F.lit(column).alias("column"), "n")

    return reduce(DataFrame.unionAll, [one(c) for c in columns])


class ColumnStats:
    """Row, value and distinct counts of a table, computed once and shared by all key and split rules.

    One pass counts values and sketches distinct values for every column asked for; sketches are merged per group of
    partitions first, so no single task merges those of all partitions.  An exact distinct count is a
    shuffle of that one column, reduced map-side, and runs only where a decision hangs on it.  Several columns are
    counted side by side, each in partitions of its own; no row is copied for a column that it has no part in.
    """

    def __init__(self, df: DataFrame, columns: Iterable[str]):
        self._df = df
        self._exact: dict[str, int] = {}
        names = list(columns)
        parts, totals = [F.count(F.lit(1)).alias("n")], [F.sum("n")]
        for i, c in enumerate(names):
            value = F.col(f"v{i}")
            parts += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value, SKETCH_LG_K).alias(f"s{i}")]
            totals += [F.sum(f"n{i}"), F.hll_sketch_estimate(F.hll_union_agg(F.col(f"s{i}")))]
        row = (
            df.select(
                (F.spark_partition_id() % SKETCH_GROUPS).alias("__group"),
                *[_sketchable(F.col(quoted(c)), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(names)],
            )
            .groupBy("__group").agg(*parts).agg(*totals).head()
        )
        self.rows: int = row[0] or 0
        self.non_null: dict[str, int] = dict(zip(names, (n or 0 for n in row[1::2])))
        self.estimate: dict[str, int] = dict(zip(names, (e or 0 for e in row[2::2])))

    def distinct(self, *columns: str) -> list[int]:
        """Exact distinct counts; one job for all columns not counted before."""
        fresh = [c for c in dict.fromkeys(columns) if c not in self._exact]
        if fresh:
            with sized_shuffles(self._df):
                self._exact.update({r["column"]: r["n"] for r in distinct_counts(self._df, fresh).collect()})
        return [self._exact[c] for c in columns]

    def bounds(self, column: str) -> tuple[float, float]:
        e = self.estimate[column]
        return e * (1 - SKETCH_MARGIN), min(e * (1 + SKETCH_MARGIN), self.non_null[column])

    def first_key(self, columns: Iterable[str], min_non_null: float, min_distinct: float) -> str | None:
        """First column, in order, whose value and distinct counts reach these shares of the rows."""
        for c in columns:
            if self.non_null[c] < self.rows * min_non_null or self.bounds(c)[1] < self.rows * min_distinct:
                continue
            if self.distinct(c)[0] >= self.rows * min_distinct:
                return c
        return None


def key_candidates(df: DataFrame, config: CleanConfig = CleanConfig()) -> list[str]:
    return [c for c in data_columns(df) if is_id_name(c, config.id_name_tokens)]


def attribute_columns(df: DataFrame) -> list[str]:
    """Columns that hold neither numbers nor dates."""
    return [c for c in data_columns(df)
            if not isinstance(df.schema[c].dataType, (NUMERIC_TYPES, *TEMPORAL_TYPES))]


def column_stats(df: DataFrame, config: CleanConfig = CleanConfig()) -> ColumnStats:
    """Statistics for every column that key detection or the table split may ask about."""
    return ColumnStats(df, dict.fromkeys(key_candidates(df, config) + attribute_columns(df)))


def detect_key(df: DataFrame, config: CleanConfig = CleanConfig(), stats: ColumnStats | None = None) -> str | None:
    """First id-named column that is complete and unique, else the row sequence, else None."""
    candidates = key_candidates(df, config)
    stats = stats or ColumnStats(df, candidates)
    if stats.rows == 0:
        return None
    return stats.first_key(candidates, 1.0, 1.0) or (ROW_SEQ if ROW_SEQ in df.columns else None)


def detect_relaxed_id(
    df: DataFrame, config: CleanConfig = CleanConfig(), stats: ColumnStats | None = None
) -> str | None:
    """First id-named column that is nearly complete and nearly unique."""
    candidates = key_candidates(df, config)
    stats = stats or ColumnStats(df, candidates)
    if stats.rows == 0:
        return None
    return stats.first_key(candidates, config.relaxed_non_null, config.relaxed_distinct)


def sort_by_key(df: DataFrame, key: str | None) -> DataFrame:
    """Global ascending order, nulls first."""
    return df.orderBy(F.col(quoted(key)).asc()) if key and key in df.columns else df


def add_surrogate_id(df: DataFrame, order_by: Iterable[str] | None = None, name: str = AUTO_ID) -> DataFrame:
    """Contiguous ids from 1 in a total order, fixed in a written table so that every reader sees the same ids.

    Rows are range-partitioned and numbered inside their partition; only one count per partition travels on to turn
    local numbers into global ones.
    """
    names = list(order_by or ([ROW_SEQ] if ROW_SEQ in df.columns else df.columns))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*[F.col(quoted(c)) for c in names]) if names else df
    with sized_shuffles(df):
        numbered = materialize(
            ordered.select(
                "*", F.spark_partition_id().alias("__part"), local.alias("__pos")
            ),
            "numbered",
        )
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(
        F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # One row per shuffle partition, so this side is small however large the table is.
    offsets = sizes.select("__part", before.alias("__before"))
    return numbered.join(F.broadcast(offsets), "__part").select(
        *[F.col(quoted(c)) for c in df.columns],
        (F.col("__before") + F.col("__pos") + 1).cast("bigint").alias(name),
    )


def rank_by_cardinality(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    top: int = 3,
    stats: ColumnStats | None = None,
) -> list[tuple[str, int]]:
    """The ``top`` columns with the fewest distinct values and their exact counts; ties keep column order.

    Sketches rule out columns that cannot make it, so only real contenders are counted exactly.
    """
    names = list(columns if columns is not None else attribute_columns(df))
    if not names:
        return []
    stats = stats or ColumnStats(df, names)
    cutoff = sorted(stats.bounds(c)[1] for c in names)[:top][-1]
    contenders = [c for c in names if stats.bounds(c)[0] <= cutoff]
    return sorted(zip(contenders, stats.distinct(*contenders)), key=lambda pair: pair[1])[:top]
