"""Quantiles of many columns at once: exact at any size, or approximate in one pass.

Exact quantiles use no sort of the data, and the number of passes does not depend on its order or on how it is
partitioned.  Each pass counts the values in buckets that keep their order and goes on with the bucket that holds the
wanted rank.  The first pass cuts by magnitude, some fifteen buckets for each power of two; the next ones cut what is left
into 2^17 equal parts.  A double has so few digits that after four passes a bucket holds a single value.  As soon as few
enough values are left for one task, one aggregate picks the value instead, mostly after the first or second pass.

The counts of a task are reduced before the shuffle, and the driver sees one row per wanted quantile and pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidyloom.operators.columns import quoted

BUCKETS = 1 << 17
PER_OCTAVE = 15
#: Below the exponent of the smallest positive double, and above that of the largest.
LEAST_EXPONENT, INFINITE_EXPONENT = -1075, 1025
COLUMNS_PER_JOB = 40

Quantiles = dict[str, list[float | None]]


@dataclass
class _Search:
    """One wanted quantile among the values from ``low`` to ``high``.

    ``rank`` counts from 1 within the ``inside`` values left; all are unknown before the first pass.
    """

    column: str
    probability: float
    rank: int | None = None
    inside: int | None = None
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    @property
    def range(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high

    @property
    def share(self) -> float:
        return self.probability if self.rank is None else (self.rank - 0.5) / self.inside

    @property
    def open(self) -> bool:
        return self.answer is None and self.inside != 0


def _batches(searches: list[_Search]):
    for start in range(0, len(searches), COLUMNS_PER_JOB):
        yield searches[start:start + COLUMNS_PER_JOB]


def _within(column: str, low: float | None, high: float | None) -> Column:
    c = F.col(quoted(column))
    return F.when(c.isNotNull() if low is None else c.between(F.lit(low), F.lit(high)), c)


def _bucket(value: Column, low: float | None, high: float | None) -> Column:
    """The bucket of a value; never lower for a higher value, since each step of the arithmetic keeps the order."""
    if low is None:
        exponent = F.least(F.log2(F.abs(value)), F.lit(float(INFINITE_EXPONENT)))
        magnitude = F.floor((exponent - LEAST_EXPONENT) * PER_OCTAVE)
        return F.when(value == 0, 0).when(value > 0, magnitude).otherwise(-magnitude)
    part = F.floor((value - F.lit(low)) / F.lit(high - low) * BUCKETS)
    return F.when(value.isNotNull(), F.least(part, F.lit(BUCKETS - 1)))


def _pass(df: DataFrame, searches: list[_Search]) -> None:
    """Count the buckets of each range once, and narrow each search to the bucket of its rank."""
    ranges = list(dict.fromkeys(s.range for s in searches))
    values = [(i, _within(*r), r) for i, r in enumerate(ranges)]
    cells = F.array(*[
        F.struct(F.lit(i).alias("range"), v.alias("value"), _bucket(v, low, high).cast("long").alias("bucket"))
        for i, v, (_, low, high) in values
    ])
    counted = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").groupBy(
        "range", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    whole = Window.partitionBy("range")
    counted = counted.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bucket"))})
    wanted = df.sparkSession.createDataFrame(
        [(i, ranges.index(s.range), Decimal(str(s.probability)), s.rank) for i, s in enumerate(searches)],
        "search int, range int, probability decimal(30,20), rank long")
    rank = F.coalesce("rank", F.greatest(F.ceil(F.col("probability") * F.col("total").cast("decimal(18,0)")), F.lit(1)))
    found = counted.join(F.broadcast(wanted), "range").withColumn("rank", rank.cast("long")).where(
        "rank > upto - n AND rank <= upto")
    left = {row["search"]: row for row in found.select(
        "search", "n", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()}
    for i, s in enumerate(searches):
        if i not in left:  # no values at all
            s.inside = 0
            continue
        s.inside, s.low, s.high, s.rank = (left[i][c] for c in ("n", "low", "high", "rank"))
        if s.low == s.high:
            s.answer = s.low


def _pick(df: DataFrame, searches: list[_Search]) -> None:
    """Exact value of each search whose remaining values fit one task."""
    aggregates = [
        F.expr(f"percentile_disc({s.share!r}) WITHIN GROUP (ORDER BY v{i})") for i, s in enumerate(searches)
    ]
    row = df.select(*[_within(*s.range).alias(f"v{i}") for i, s in enumerate(searches)]).agg(*aggregates).head()
    for s, answer in zip(searches, row):
        s.answer, s.inside = answer, 0


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns alone; NaN counts as no value."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[
        (F.nullif(F.col(quoted(c)), F.lit(math.nan)) if c in floating else F.col(quoted(c))).cast("double").alias(c)
        for c in columns
    ])


def exact_quantiles(
    df: DataFrame, probabilities: dict[str, list[float]], exact_rows: int = 200_000, at_most: int | None = None
) -> Quantiles:
    """Lower quantiles, always values of the data as doubles; None for a column without values.

    If the caller knows that the frame has at most ``exact_rows`` rows, one aggregate does.
    """
    df = _values(df, list(probabilities))
    searches = {c: [_Search(c, p) for p in ps] for c, ps in probabilities.items()}
    active = [s for found in searches.values() for s in found]
    if at_most is not None and at_most <= exact_rows:
        for batch in _batches(active):
            _pick(df, batch)
    while active := [s for s in active if s.open]:
        for batch in _batches(active):
            _pass(df, batch)
        for batch in _batches([s for s in active if s.open and s.inside <= exact_rows]):
            _pick(df, batch)
    return {c: [s.answer for s in found] for c, found in searches.items()}


def approx_quantiles(df: DataFrame, probabilities: dict[str, list[float]], error: float) -> Quantiles:
    """One pass, each answer within ``error * rows`` ranks."""
    if not probabilities:
        return {}
    accuracy = math.ceil(1 / error)
    row = _values(df, list(probabilities)).agg(*[
        F.percentile_approx(F.col(quoted(c)), p, accuracy) for c, p in probabilities.items()
    ]).head()
    return {
        c: [None] * len(p) if found is None else [float(v) for v in found]
        for (c, p), found in zip(probabilities.items(), row)
    }


def quantiles(
    df: DataFrame,
    probabilities: dict[str, list[float]],
    error: float = 0.0,
    exact_rows: int = 200_000,
    at_most: int | None = None,
) -> Quantiles:
    if error > 0:
        return approx_quantiles(df, probabilities, error)
    return exact_quantiles(df, probabilities, exact_rows, at_most)
