"""Continuous and batch ingest on Structured Streaming.

Two sources, records with a JSON payload and whole files, run through one of two kinds of batch handler: ``land_rows``
flattens a whole batch at once into one growing table, ``run_datasets`` runs the full plan for each dataset by itself.
The checkpoint remembers what was read, so a restart repeats nothing, and each handler replaces what an interrupted
attempt at the same batch left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidyloom.config import CleanConfig
from tidyloom.functions.names import file_format_col
from tidyloom.operators.columns import all_text
from tidyloom.operators.nested import flatten_json, invalid_payloads
from tidyloom.plans.records import finished_runs, run_records
from tidyloom.sinks.runlog import log_runs
from tidyloom.sources.payloads import PLACE, parse_csv_payloads, payload_text, scan_api_responses
from tidyloom.storage import discarding, materialize

API_SCHEMA = "id bigint, api_url string, response string, file_name string, file_path string, status string, page bigint"
#: A response may be as long as a string can be; the reader would drop lines with more than 20 million characters in one.
LONGEST_RESPONSE = 2**31 - 1
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
POLL_INTERVAL = "1 second"
#: Name of the partitions of a landed table, which no cleaned field can have.
BATCH = "_landed_batch"

BatchHandler = Callable[[DataFrame, int], None]


def api_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """API records landing as JSON lines; only new ones pass."""
    reader = spark.readStream.schema(API_SCHEMA).option("maxStringLen", LONGEST_RESPONSE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(landing).filter(F.col("status") == "NEW")


def file_stream(spark: SparkSession, landing: str, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """Whole files as binary payloads."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(landing).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"),
        F.col("content").alias("file_content"),
    )


def start(
    stream: DataFrame, handler: BatchHandler, checkpoint: str, available_now: bool = False,
    interval: str = POLL_INTERVAL,
) -> StreamingQuery:
    """Run ``handler`` on every batch: all that is there now and stop, or every ``interval``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


@dataclass(frozen=True)
class Landed:
    """What a batch holds: its rows, and what of it could not be read, with the reason where there can be several."""

    rows: DataFrame
    rejects: DataFrame


def land_api_rows(batch: DataFrame) -> Landed:
    """API responses, flattened; those that are no JSON are rejects, missing ones are neither."""
    records = materialize(batch, "responses")
    return Landed(scan_api_responses(records), invalid_payloads(records, "response"))


def land_csv_rows(batch: DataFrame) -> Landed:
    """CSV payloads of any headers; records that are too wide and payloads without records are rejects.

    A batch is parsed once, into a table that rows and rejects are read from.
    """
    names = [c for c in ("file_name", "file_path") if c in batch.columns]
    parsed = parse_csv_payloads(batch, keep=names, write=True)
    return Landed(replace(parsed, keep=[]).values("skip").drop(*PLACE), parsed.rejects())


def land_file_rows(batch: DataFrame) -> Landed:
    """Files of any kind by the extension of their name: JSON documents, and all others as CSV.

    A document that is no JSON is a reject, like what of a CSV file cannot be read.
    """
    files = materialize(batch, "files", payloads=True)
    is_json = file_format_col(F.col("file_name"), F.col("file_path")) == "json"
    csv = land_csv_rows(files.where(~is_json))
    text = payload_text(F.col("file_content"), files.schema["file_content"].dataType)
    documents = files.where(is_json).select("file_name", "file_path", text.alias("line"))
    if documents.isEmpty():
        return csv
    rows = [all_text(r) for r in (csv.rows, flatten_json(documents, "line")) if r.columns]
    broken = invalid_payloads(documents, "line").select(
        "file_name", "file_path", F.lit(None).cast("int").alias("record"), F.lit("no JSON").alias("reason"), "line")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else csv.rows
    return Landed(both, csv.rejects.unionByName(broken))


def land_rows(load: Callable[[DataFrame], Landed], out: str) -> BatchHandler:
    """Flatten all payloads of a batch together and add them to the table at ``out``.

    Values land as text, so batches whose types drift apart still share a table; new fields become new columns.  A batch
    without any row writes none.  What cannot be read is kept in ``out/_rejects`` and stops neither the batch nor the
    stream.  Intermediate tables go when the batch is done.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with discarding(batch.sparkSession):
            landed = load(batch)
            if not landed.rejects.isEmpty():
                landed.rejects.write.mode("overwrite").parquet(f"{out}/_rejects/{BATCH}={batch_id}")
            if landed.rows.columns:
                all_text(landed.rows).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return handle


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """What could not be read, with the batch it came in."""
    return spark.read.option("mergeSchema", True).parquet(f"{out}/_rejects")


def landed_rows(spark: SparkSession, out: str) -> DataFrame:
    """Everything landed so far, with the union of all columns."""
    return spark.read.option("mergeSchema", True).parquet(out).drop(BATCH)


def run_datasets(
    out: str, config: CleanConfig = CleanConfig(), parallel: int = 4, log: str | None = None
) -> BatchHandler:
    """Run the whole plan for every record of a batch; how each went is kept in ``out/_status``.

    With ``log`` the finished runs of file records are added to that run log, once per batch however often it is tried.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with discarding(batch.sparkSession):
            records = materialize(batch, f"batch_{batch_id}")
            status = materialize(run_records(records, out, config, parallel), "status")
            status.write.mode("overwrite").parquet(f"{out}/_status/batch_id={batch_id}")
            if log is not None:
                log_runs(records, finished_runs(status, records), log, batch_id)

    return handle


def dataset_status(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/_status")
