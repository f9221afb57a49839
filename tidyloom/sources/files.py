"""Scans of files and tables.  Every scan tags rows so that later steps can tell duplicates apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.config import ROW_SEQ
from tidyloom.functions.names import file_format
from tidyloom.operators.columns import all_text, tag_rows
from tidyloom.operators.nested import flatten_json, invalid_payloads
from tidyloom.storage import materialize


def tag_by_place(df: DataFrame) -> DataFrame:
    """Number the rows of a file scan from 0 by the paths of the files and the places of rows in them.

    `tag_rows` numbers them as files are packed into tasks, the largest first; this sequence is the same however large
    files, splits and tasks are.  One scan more counts the rows of each split.  Rows are not shuffled: they meet the
    splits' first numbers, a row per split, which Spark sends around as long as that table is small.
    """
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")
    placed = df.select("*", *place, F.monotonically_increasing_id().alias("__at"))
    splits = placed.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    # Running totals within ranges of splits, then over the ranges, of which there is one per shuffle partition.
    ranged = materialize(splits.orderBy("__file", "__start").withColumn("__part", F.spark_partition_id()), "splits")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__part").orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__part").agg(F.sum("__rows").alias("__rows")).select(
        "__part", F.coalesce(F.sum("__rows").over(earlier.orderBy("__part")), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__within", F.coalesce(F.sum("__rows").over(within), F.lit(0))).join(
        F.broadcast(before), "__part")
    offsets = materialize(numbered.select(
        "__file", "__start", (F.col("__before") + F.col("__within") - F.col("__first")).alias("__offset")), "offsets")
    return placed.join(offsets, ["__file", "__start"], "left").withColumn(ROW_SEQ, F.coalesce(
        F.col("__at") + F.col("__offset"), F.raise_error(F.lit("the splits of a file have changed")).cast("long"),
    )).drop("__file", "__start", "__at", "__offset")


def scan_csv(
    spark: SparkSession, path: str, infer_schema: bool = True, multi_line: bool = True, tag: bool = True,
    by_place: bool = False,
) -> DataFrame:
    """CSV with a header and doubled quotes.

    The defaults read any file right, but each in one piece.  On large data switch off ``infer_schema`` (one scan less, the
    cleaner types the columns anyway) and, if no value holds a line break, ``multi_line``; `scan_csv_splits` reads files
    in splits whatever their values hold.  With ``by_place`` the sequence is that of `tag_by_place`, else of `tag_rows`.
    """
    df = spark.read.csv(path, header=True, inferSchema=infer_schema, multiLine=multi_line, escape='"')
    if not tag:
        return df
    return tag_by_place(df) if by_place else tag_rows(df)


def json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The texts of JSON documents in ``value``: one document per file, or one per line that is not blank."""
    df = spark.read.text(path, wholetext=not lines)
    return df.filter(F.trim("value") != "") if lines else df


def scan_json(
    spark: SparkSession, path: str, lines: bool = False, tag: bool = True, broken: str = "error"
) -> DataFrame:
    """JSON documents to flat rows: one document per file, or one per line.

    A document that is no JSON is an error.  ``broken="skip"`` passes over it; `json_rejects` has those.
    """
    return flatten_json(json_documents(spark, path, lines), "value", tag=tag, broken=broken)


def json_rejects(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The documents that a scan of the same path cannot read, with the file each is in."""
    documents = json_documents(spark, path, lines).withColumn("file", F.input_file_name())
    return invalid_payloads(documents, "value").select("file", F.col("value").alias("document"))


def scan_all_text(df: DataFrame, tag: bool = True) -> DataFrame:
    """Every column as text, typing left to the cleaner."""
    df = all_text(df)
    return tag_rows(df) if tag else df


def scan_table(spark: SparkSession, table: str) -> DataFrame | None:
    """A catalog table; None if it is empty."""
    df = spark.table(table)
    return None if df.isEmpty() else tag_rows(df)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    partitions: int = 1,
) -> DataFrame | None:
    """A database table; None if it is empty.

    With a numeric or temporal ``partition_column`` the table is read in ``partitions`` parallel ranges, whose bounds
    the database itself reports.  Connection details are the caller's.
    """
    reader = spark.read.format("jdbc").options(url=url, **(properties or {}))
    if partition_column is None:
        df = reader.option("dbtable", table).load()
        return None if df.isEmpty() else tag_rows(df)
    extent = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}"
    low, high = reader.option("query", extent).load().head()
    if low is None:
        df = reader.option("dbtable", table).load()
        return None if df.isEmpty() else tag_rows(df)
    ranged = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high),
        numPartitions=partitions, **(properties or {}),
    )
    return tag_rows(ranged.load())


def scan_file(spark: SparkSession, file_name: str, file_path: str, **csv_options) -> DataFrame:
    """Scan by the extension of the name, or else of the path; any other format is an error."""
    found = file_format(file_name, file_path)
    if found == "csv":
        return scan_csv(spark, file_path, **csv_options)
    if found == "json":
        return scan_json(spark, file_path)
    raise ValueError(f"unsupported format {found!r} of {file_name!r}")


def pending_records(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """New registry records in id order; with a limit this is a top-k and no global sort."""
    found = registry.filter(F.col("status") == "NEW").orderBy("id")
    return found if limit is None else found.limit(limit)
