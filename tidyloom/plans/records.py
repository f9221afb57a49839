"""Runs of registered records: uploaded files, tables and API responses, each a dataset of its own.

A record table has the columns ``response`` and ``file_name`` (API), or ``file_name``, ``file_path``, ``table_name`` and
``file_content`` (files; any of the last three may be missing).  Payloads stay where they are, only names and keys come
to the driver.

An API response may come in pages, as APIs give them: rows of one key and file name with a number in ``page`` are one
record, so no response need fit into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidyloom.config import CleanConfig
from tidyloom.functions.names import dataset_name
from tidyloom.operators.nested import invalid_payloads
from tidyloom.plans.pipeline import csv_writer, run_pipeline
from tidyloom.sources.files import scan_file, scan_table
from tidyloom.sources.payloads import scan_api_responses, scan_payload
from tidyloom.storage import discarding, fresh_path

# Fixed value: the path of records that stand for an existing table.
TABLE_UPLOAD = "MULTI_UPLOAD"
RECORD = "_record"
PAGE = "page"
PAGE_SIZE = 1000
STATUS_SCHEMA = "record string, dataset string, status string, rows_count bigint, message string"

TableOpener = Callable[[SparkSession, str], DataFrame | None]


def record_key(records: DataFrame) -> str:
    return "id" if "id" in records.columns else "file_path"


def load_api_record(record: DataFrame) -> DataFrame:
    """Flat rows of one API record, of all its pages; a missing or broken response is an error, and so is one without
    records."""
    if record.isEmpty() or not record.filter("response IS NULL").isEmpty():
        raise ValueError("record has no response")
    if not invalid_payloads(record, "response").isEmpty():
        raise ValueError("response is no valid JSON")
    rows = scan_api_responses(record)
    if not rows.columns:
        raise ValueError("response has no records")
    return rows


def load_file_record(record: DataFrame, listed: Row, open_table: TableOpener = scan_table) -> DataFrame:
    """Rows of one file record: from its table, its content or its path, whichever it names first."""
    spark = record.sparkSession
    if listed["file_path"] == TABLE_UPLOAD:
        if not listed["table_name"]:
            raise ValueError("record stands for a table but names none")
        df = open_table(spark, listed["table_name"])
        if df is None:
            raise ValueError("table is empty")
        return df
    if not listed["file_name"]:
        raise ValueError("record has no file name")
    if listed["has_content"]:
        return scan_payload(record, listed["file_name"])
    if listed["file_path"]:
        return scan_file(spark, listed["file_name"], listed["file_path"])
    raise ValueError("record has neither content nor path")


def _listing(records: DataFrame, key: str) -> DataFrame:
    """Names and keys of all records, and whether they have content."""
    wanted = {"file_name": "string", "file_path": "string", "table_name": "string"}
    fields = [
        (F.col(c) if c in records.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()
    ]
    content = F.length("file_content") > 0 if "file_content" in records.columns else F.lit(False)
    listed = records.select(RECORD, F.col(key).alias("key"), *fields, F.coalesce(content, F.lit(False)).alias("has_content"))
    return listed.distinct() if _paged(records) else listed


def _paged(records: DataFrame) -> bool:
    return "response" in records.columns and PAGE in records.columns


def _record_number(records: DataFrame, key: str) -> Column:
    """What tells records apart, in their order: the number of the row, or for pages a digest of what they share."""
    number = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    if not _paged(records):
        return number
    shared = F.sha2(F.to_json(F.struct(F.col(key).alias("key"), F.col("file_name").alias("name"))), 256)
    return F.when(F.col(PAGE).isNull(), number).otherwise(F.concat(F.lit("p"), shared))


def _pages(listing: DataFrame, size: int) -> Iterator[list[Row]]:
    """The listing in key order, ``size`` records at a time; the driver holds one page and one partition of it."""
    page: list[Row] = []
    for row in listing.orderBy("key", RECORD).toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def run_records(
    records: DataFrame,
    out: str,
    config: CleanConfig = CleanConfig(),
    parallel: int = 4,
    open_table: TableOpener = scan_table,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Run the whole plan for every record, each spread over the cluster, and report how each went.

    Datasets of one name follow each other in key order, so the latest one stays; different names run side by side.
    A failure concerns its own record alone and is reported with its message, never as done.

    The records are written once, each in a partition of its own that its run reads, so no run looks at the payloads of
    others.  Names and keys come to the driver a page at a time, and each page's outcome is written before the next one.
    """
    spark, key, from_api = records.sparkSession, record_key(records), "response" in records.columns
    path, outcomes = fresh_path(spark, "records"), fresh_path(spark, "outcomes")
    numbered = records.withColumn(RECORD, _record_number(records, key))
    numbered.write.partitionBy(RECORD).parquet(path)
    payloads = spark.read.schema(numbered.schema).parquet(path)

    def run_one(name: str, row: Row) -> tuple:
        record = spark.read.schema(records.schema).parquet(f"{path}/{RECORD}={row[RECORD]}")
        try:
            with discarding(spark):
                df = load_api_record(record) if from_api else load_file_record(record, row, open_table)
                raw_columns = df.columns if row["file_path"] == TABLE_UPLOAD else None
                result = run_pipeline(df, [csv_writer(out, name)], config, raw_columns)
            return str(row["key"]), name, "DONE", result.report.rows_in, None
        except Exception as error:  # one bad record must not stop the others
            return str(row["key"]), name, "ERROR", None, str(error).split("\n")[0]

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for page in _pages(_listing(payloads, key), page_size):
            by_name: dict[str, list[Row]] = {}
            for row in page:
                is_table = row["file_path"] == TABLE_UPLOAD and row["table_name"]
                name = row["table_name"] if is_table else dataset_name(row["file_name"], row["key"])
                by_name.setdefault(name, []).append(row)
            done = pool.map(lambda item: [run_one(item[0], row) for row in item[1]], by_name.items())
            status = spark.createDataFrame([o for found in done for o in found], STATUS_SCHEMA)
            status.coalesce(1).write.mode("append").parquet(outcomes)
        if payloads.isEmpty():
            spark.createDataFrame([], STATUS_SCHEMA).write.parquet(outcomes)
    return spark.read.schema(STATUS_SCHEMA).parquet(outcomes)


def finished_runs(status: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs for the log: what ``run_records`` finished, by file name and with the time of now.

    Records that stand for tables are not logged.
    """
    files = registry.filter(F.coalesce(F.col("file_path") != TABLE_UPLOAD, F.lit(True)))
    if _paged(registry):  # one run, however many pages
        same = ["id", "file_name"]
        files = files.where(F.col(PAGE).isNull()).select(same).union(files.where(F.col(PAGE).isNotNull()).select(same).distinct())
    named = files.select(F.col("id").cast("string").alias("record"), "file_name")
    return status.filter("status = 'DONE'").join(named, "record").select(
        "file_name", F.current_timestamp().alias("processed_at"), "rows_count", "status"
    )
