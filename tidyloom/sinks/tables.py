"""Sinks for the four tables of a run, and the check that they all arrived."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four outputs of a run.
KINDS = ("fulltable", "entity", "metrics", "dimension")
# These two are written only if they have rows.
OPTIONAL_KINDS = ("metrics", "dimension")
JDBC_BATCH = 1000


def table_name(base: str, kind: str) -> str:
    return f"{base}_{kind}"


def csv_path(folder: str, base: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{base}/{table_name(base, kind)}.csv"


def write_csv(df: DataFrame, path: str, file_rows: int | None = None) -> None:
    """Replace a CSV table: one header per part file, quotes doubled, parts in row order, of ``file_rows`` rows at most."""
    options = {} if file_rows is None else {"maxRecordsPerFile": file_rows}
    df.write.mode("overwrite").options(**options).csv(path, header=True, quote='"', escape='"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table written by ``write_csv`` back, as text unless a schema is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, quote='"', escape='"', multiLine=True)


def sql_type(data_type: T.DataType) -> str:
    """Column type of a database table for a Spark type."""
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "DOUBLE"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(data_type, T.DateType):
        return "DATE"
    return "TEXT"


def sql_columns(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, sql_type(f.dataType)) for f in schema]


def jdbc_options(schema: T.StructType) -> dict[str, str]:
    """Writer options for a table of this schema.

    Spark's DDL reader knows neither DATETIME nor TEXT; for those the database dialect chooses the type.
    """
    typed = [f"`{name}` {kind}" for name, kind in sql_columns(schema) if kind in ("BIGINT", "DOUBLE", "DATE")]
    options = {"batchsize": str(JDBC_BATCH)}
    return options | ({"createTableColumnTypes": ", ".join(typed)} if typed else {})


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Replace a database table, batch by batch from the executors."""
    options = jdbc_options(df.schema) | (properties or {})
    df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=table, **options).save()


def write_catalog(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace a catalog table, kept at ``path`` if one is given."""
    df.write.mode("overwrite").options(**({"path": path} if path else {})).saveAsTable(table)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_all(tables: dict[str, DataFrame], rows: int, write: Callable[[DataFrame, str], None]) -> list[str]:
    """Write the outputs of a run side by side; returns the kinds written.

    The four jobs do not depend on each other, so the cluster works on all of them at once.
    """
    kinds = [k for k in KINDS if k in tables and (rows > 0 or k not in OPTIONAL_KINDS)]
    with ThreadPoolExecutor(max_workers=len(KINDS)) as pool:
        list(pool.map(lambda kind: write(tables[kind], kind), kinds))
    return kinds


def output_check(spark: SparkSession, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """One row per expected output: is it there, and how many rows has it.

    ``read`` opens the output of a kind and raises if there is none.
    """
    checks = None
    for kind in KINDS:
        try:
            counted = read(spark, kind).agg(F.count(F.lit(1)).alias("rows"))
            one = counted.select(F.lit(kind).alias("kind"), F.lit(True).alias("present"), "rows")
        except AnalysisException:
            one = spark.range(1).select(
                F.lit(kind).alias("kind"), F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("rows")
            )
        checks = one if checks is None else checks.unionByName(one)
    return checks
