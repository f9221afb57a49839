"""Column profile and type inference in one aggregate over the data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import CleanConfig
from tidyloom.functions.casts import is_integral, is_number_text, number_candidate, to_double, to_long, to_text
from tidyloom.functions.dates import to_date_column
from tidyloom.functions.names import name_has_token
from tidyloom.functions.text import bare_text, clean_text, settle_text, title_case, unquote
from tidyloom.operators.columns import TEMPORAL_TYPES, data_columns, quoted

INT, FLOAT, DATE, STRING = "int", "float", "date", "string"


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    rows: int
    present: int  # non-null as delivered
    non_null: int  # non-null after text cleaning
    numbers: int
    all_int: bool
    dates: int
    inferred: str

    @property
    def shown(self) -> int:
        """Values left once a date or text column has its type."""
        return self.dates if self.inferred == DATE else self.non_null


def clean_values(df: DataFrame, columns: list[str], config: CleanConfig) -> DataFrame:
    """Values before typing: text is cleaned, NaN is no value, everything else stays.

    Each step is a projection of its own: the next one looks at a value several times, and must not compute it anew.
    """
    steps = {
        T.StringType: (bare_text, unquote, lambda c: settle_text(c, config.na_tokens)),
        T.FloatType: (lambda c: F.when(~F.isnan(c), c),),
        T.DoubleType: (lambda c: F.when(~F.isnan(c), c),),
    }
    wanted = {f.name: steps.get(type(f.dataType), ()) for f in df.schema if f.name in columns}
    for i in range(max(map(len, wanted.values()), default=0)):
        df = df.select(*[
            wanted[c][i](F.col(quoted(c))).alias(c) if i < len(wanted.get(c, ())) else F.col(quoted(c))
            for c in df.columns
        ])
    return df


def _evidence(v: Column, stripped: Column, number: Column, data_type: T.DataType, config: CleanConfig):
    """Three flags per value: is it a number, is that number whole, does it hold a date."""
    no = F.lit(False)
    if isinstance(data_type, T.IntegralType):
        return v.isNotNull(), F.lit(True), no
    if isinstance(data_type, T.NumericType):
        return v.isNotNull(), is_integral(v), no
    if isinstance(data_type, TEMPORAL_TYPES):
        return no, no, v.isNotNull()
    if isinstance(data_type, T.StringType):
        whole = is_integral(stripped.try_cast("double"))
        # No number is also a date, so numbers skip the date rules.
        date = F.when(number, no).otherwise(to_date_column(v, data_type, config.lenient_dates).isNotNull())
        return is_number_text(stripped), F.when(number, whole), date
    return no, no, no


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _profile_chunk(df: DataFrame, columns: list[str], config: CleanConfig) -> DataFrame:
    """Profile of some columns.  Column ``i`` has, per value and then as counts: p present as delivered, c present
    after cleaning, n number, w whole number, d date; v is the value and s its text stripped for number tests."""
    types = [df.schema[c].dataType for c in columns]
    at = range(len(columns))
    df = df.selectExpr(*[f"{quoted(c)} IS NOT NULL AS p{i}" for i, c in enumerate(columns)],
                       *[f"{quoted(c)} AS v{i}" for i, c in enumerate(columns)])
    df = clean_values(df, [f"v{i}" for i in at], config)
    # Each projection names what the next one uses more than once, so that nothing is computed twice per value.
    evidence = [_evidence(F.col(f"v{i}"), F.col(f"s{i}"), F.col(f"n{i}"), types[i], config) for i in at]
    texts = [i for i in at if isinstance(types[i], T.StringType)]
    df = df.select("*", *[number_candidate(F.col(f"v{i}")).alias(f"s{i}") for i in texts])
    df = df.select("*", *[number.alias(f"n{i}") for i, (number, _, _) in enumerate(evidence)])
    df = df.select(
        *[f"p{i}" for i in at], *[f"n{i}" for i in at], *[F.col(f"v{i}").isNotNull().alias(f"c{i}") for i in at],
        *[whole.alias(f"w{i}") for i, (_, whole, _) in enumerate(evidence)],
        *[date.alias(f"d{i}") for i, (_, _, date) in enumerate(evidence)],
    )
    metrics = [F.expr(f"count_if({x}{i}) AS {x}{i}") for i in at for x in "pcnd"]
    metrics += [F.expr(f"coalesce(bool_and(CASE WHEN n{i} THEN w{i} END), false) AS w{i}") for i in at]
    described = []
    for i, name in enumerate(columns):
        forced = config.force_date_names and "date" in name and i in texts
        as_number = "false" if forced else f"try_divide(n{i}, c{i}) >= {config.numeric_threshold}D"
        as_date = f"d{i} > 0" if forced else f"try_divide(d{i}, c{i}) >= {config.date_threshold}D"
        described.append(
            f"struct({_sql_text(name)} AS column, n AS rows, p{i} AS present, c{i} AS non_null, n{i} AS numbers, "
            f"w{i} AS all_int, d{i} AS dates, CASE WHEN c{i} = 0 THEN '{STRING}' "
            f"WHEN {as_number} THEN IF(w{i}, '{INT}', '{FLOAT}') WHEN {as_date} THEN '{DATE}' ELSE '{STRING}' END "
            "AS inferred)"
        )
    counted = df.agg(F.count(F.lit(1)).alias("n"), *metrics)
    return counted.selectExpr(f"inline(array({', '.join(described)}))")


def profile_frame(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """One row per data column: counts of rows, values, numbers and dates, and the inferred type.

    The whole profile is one pass without a shuffle of data.  Very wide tables take one pass per
    ``columns_per_job`` columns, to keep generated code within what the JVM compiles.
    """
    names = data_columns(df)
    step = config.columns_per_job
    chunks = [_profile_chunk(df, names[i:i + step], config) for i in range(0, len(names), step)]
    return reduce(DataFrame.unionAll, chunks)


def profile(df: DataFrame, config: CleanConfig = CleanConfig()) -> list[ColumnProfile]:
    """The profile as plain objects; its size is the number of columns."""
    if not data_columns(df):
        return []
    return [ColumnProfile(**row.asDict()) for row in profile_frame(df, config).collect()]


def typed_value(value: Column, data_type: T.DataType, name: str, inferred: str, config: CleanConfig) -> Column:
    """Cleaned value in its inferred type."""
    if inferred == INT:
        return to_long(value, data_type)
    if inferred == FLOAT:
        return F.nullif(to_double(value, data_type), F.lit(float("nan")))
    if inferred == DATE:
        return to_date_column(value, data_type, config.lenient_dates)
    if config.force_date_names and "date" in name and isinstance(data_type, T.StringType):
        return F.lit(None).cast("string")
    if isinstance(data_type, T.StringType) and not name_has_token(name, config.title_exempt_tokens):
        return title_case(value)
    return to_text(value)


def apply_types(df: DataFrame, profiles: list[ColumnProfile], config: CleanConfig = CleanConfig()) -> DataFrame:
    """Clean, then convert, every profiled column; technical columns pass through."""
    types = {f.name: f.dataType for f in df.schema}
    inferred = {p.column: p.inferred for p in profiles}
    kept = [c for c in df.columns if c in inferred or c not in data_columns(df)]
    return clean_values(df, list(inferred), config).select(*[
        typed_value(F.col(quoted(c)), types[c], c, inferred[c], config).alias(c) if c in inferred
        else F.col(quoted(c))
        for c in kept
    ])


def infer_types(df: DataFrame, config: CleanConfig = CleanConfig()) -> tuple[DataFrame, dict[str, str]]:
    """Typed frame and the map of column to inferred type; an empty frame keeps its types."""
    profiles = profile(df, config)
    if not profiles or profiles[0].rows == 0:
        return df, {p.column: STRING for p in profiles}
    return apply_types(df, profiles, config), {p.column: p.inferred for p in profiles}


def clean_text_columns(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Clean and title-case every text column without touching its type."""
    out = []
    for field in df.schema:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, T.StringType):
            c = clean_text(c, config.na_tokens)
            if not name_has_token(field.name, config.title_exempt_tokens):
                c = title_case(c)
        out.append(c.alias(field.name))
    return df.select(*out)
