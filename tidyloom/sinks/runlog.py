"""The run log: one row per finished file run, with what the registry knows about the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the partitions of a log.
LOGGED = "_logged_batch"


def run_stats(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Join runs ``(file_name, processed_at, rows_count, status)`` with the latest registry record of their file.

    The latest record per file is a grouped maximum, reduced map-side, so a file registered over and over makes no hot
    task.  Runs of unknown files are left out.
    """
    latest = registry.groupBy("file_name").agg(
        F.max_by(F.struct("company_name", "uploaded_by"), F.col("id")).alias("__latest")
    )
    return runs.join(latest, "file_name").select(
        "file_name", "__latest.company_name", "__latest.uploaded_by", "processed_at", "rows_count", "status"
    )


def log_runs(registry: DataFrame, runs: DataFrame, path: str, batch: int | str) -> None:
    """Add the runs of a batch to the log at ``path``.

    Each batch is a partition of its own that is replaced as a whole, so a batch that is tried again logs its runs once.
    """
    run_stats(registry, runs).write.mode("overwrite").parquet(f"{path}/{LOGGED}={batch}")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged runs."""
    return spark.read.parquet(path).drop(LOGGED)
