"""The whole run: clean, find the key, sort, split, write, check."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.config import AUTO_ID, CleanConfig
from tidyloom.operators.columns import dates_to_text, drop_technical, project_raw_columns, quoted
from tidyloom.operators.keys import column_stats, detect_key, sort_by_key
from tidyloom.operators.split import split_tables
from tidyloom.plans.clean import CleanReport, clean
from tidyloom.sinks.tables import csv_path, read_csv, table_name, write_all, write_catalog, write_csv
from tidyloom.storage import sized_shuffles

Writer = Callable[[DataFrame, str], None]


@dataclass(frozen=True)
class PipelineResult:
    tables: dict[str, DataFrame]
    id_column: str
    key: str | None
    report: CleanReport
    written: list[str]

    @property
    def full(self) -> DataFrame:
        return self.tables["fulltable"]


def csv_writer(folder: str, base: str) -> Writer:
    """Writer of one CSV table per kind below ``folder/base``."""
    return lambda df, kind: write_csv(df, csv_path(folder, base, kind))


def csv_opener(folder: str, base: str):
    """Opener of the tables ``csv_writer`` wrote, for the output check."""
    return lambda spark, kind: read_csv(spark, csv_path(folder, base, kind))


def catalog_writer(base: str) -> Writer:
    """Writer of one catalog table per kind, named ``base_kind``."""
    return lambda df, kind: write_catalog(df, table_name(base, kind))


def catalog_opener(base: str):
    """Opener of the tables ``catalog_writer`` wrote, for the output check."""
    return lambda spark, kind: spark.table(table_name(base, kind))


def run_pipeline(
    df: DataFrame,
    writers: Iterable[Writer] = (),
    config: CleanConfig = CleanConfig(),
    raw_columns: Iterable[str] | None = None,
    dedupe_subset: Iterable[str] | None = None,
    remove_outliers: bool = False,
    sort_output: bool = True,
) -> PipelineResult:
    """Clean ``df``, split it into its four tables and hand each to every writer.

    All four tables are projections of one written table, so each reads only its own columns and all agree on the id.
    Each is put in key order on its own, which moves only the columns it needs.  ``raw_columns`` restricts the output
    to those columns of the input.
    """
    cleaned = clean(df, config, dedupe_subset, remove_outliers)
    frame = cleaned.df
    stats = column_stats(frame, config)
    key = detect_key(frame, config, stats)
    if raw_columns is not None:
        frame = project_raw_columns(frame, raw_columns, cleaned.names)
    split = split_tables(frame, config, stats)

    full = split.full.drop(AUTO_ID) if split.id_column == AUTO_ID else split.full
    named = {"fulltable": full, "entity": split.entity, "metrics": split.metrics, "dimension": split.dimension}
    # Surrogate ids follow the row sequence, which is the key of a table without any id column.
    order = AUTO_ID if key and split.id_column == AUTO_ID else key

    def finish(kind: str, table: DataFrame) -> DataFrame:
        if sort_output:
            table = sort_by_key(split.full, order).select(*[F.col(quoted(c)) for c in table.columns])
        table = drop_technical(table)
        return table if kind == "fulltable" else dates_to_text(table)

    tables = {kind: finish(kind, table) for kind, table in named.items()}
    written: list[str] = []
    with sized_shuffles(frame):
        for write in writers:
            written = write_all(tables, stats.rows, write)
    return PipelineResult(tables, split.id_column, key, cleaned.report, written)
