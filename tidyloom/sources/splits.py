"""CSV files with line breaks in quoted cells, read in splits.

A reader that allows such cells takes a file as one piece, because a line break says nothing by itself.  Whether a line
begins inside a quoted cell depends only on the number of quotes before it in its file, so two passes do: the first counts
the quotes of each split, and the counts of the splits before it tell each split how it begins; in the second each split
cuts its own records.  Records that cross a border are put together from their pieces, a few per split.

This holds as long as quotes come in pairs within each record, as in every file of a CSV writer.  A file with stray
quotes, where it would not, is noticed and is an error; `scan_csv` reads it in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.sources.payloads import MOST_HEADERS, CsvPayloads, csv_records
from tidyloom.storage import materialize

_WHOLE, _ENDS, _BEGINS, _INSIDE = range(4)
_PIECES = "file string, start long, n long, kind int, text string"


def _cutter():
    """Cutter of lines into records for ``mapInArrow``; an inner function travels to the executors whole."""
    whole, ends, begins, inside_ = _WHOLE, _ENDS, _BEGINS, _INSIDE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, waiting, n, late = None, 0, [], 0, False  # late: the first record began in an earlier split
        out: list[tuple] = []

        def close() -> None:
            if waiting:
                out.append((*split, n, inside_ if late else begins, "\n".join(waiting)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["file", "start", "n", "kind", "text"])

        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
            lines, begun = batch.column("value").to_pylist(), batch.column("inside")
            quotes = pc.count_substring(batch.column("value"), '"').to_numpy()
            change = [i for i in range(1, len(lines)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]]
            for a, b in zip([0, *change], [*change, len(lines)]):
                if a == b:
                    continue
                if split != (files[a], int(starts[a])):
                    if split:
                        close()
                    split, odd, waiting, n = (files[a], int(starts[a])), int(begun[a].as_py()), [], 0
                    late = odd == 1
                open_ = (odd + np.cumsum(quotes[a:b])) % 2
                first = a
                for last in (np.flatnonzero(open_ == 0) + a).tolist():
                    text = "\n".join([*waiting, *lines[first:last + 1]]) if waiting or last > first else lines[last]
                    out.append((*split, n, ends if late else whole, text))
                    waiting, first, n, late = [], last + 1, n + 1, False
                waiting += lines[first:b]
                odd = int(open_[-1])
            yield flush()
        if split:
            close()
        yield flush()

    return cut


def csv_file_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line``: the records of all files below a path, blank lines left out; ``pos`` grows along a file."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = counted.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # One row per split, with a state each; an inner join would hide a split that the two passes see differently.
    told = lines.join(F.broadcast(states), ["file", "start"], "left").withColumn(
        "inside", F.coalesce("inside", F.raise_error(F.lit("the splits of a file have changed")).cast("boolean")))
    pieces = materialize(told.mapInArrow(_cutter(), _PIECES), "pieces")

    broken = pieces.where(f"kind <> {_WHOLE}")
    along = Window.partitionBy("file").orderBy("start", "n")
    chain = F.sum(F.when(F.col("kind") == _BEGINS, 1).otherwise(0)).over(along)
    joined = broken.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["n"].alias("n"),
                           F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    every = pieces.where(f"kind = {_WHOLE}").select("file", "start", "n", "text").union(joined)
    # A split has no more records than bytes, so places do not meet.
    every = every.select("file", (F.col("start") + F.col("n")).alias("pos"), F.regexp_replace("text", "^﻿", "").alias("text"))
    found = every.select("file", "pos", csv_records(F.col("text")).alias("found"))
    stray = F.raise_error(F.lit("quotes outside of quoted cells: read this file without splits")).cast("string")
    line = F.when(F.size("found") > 1, stray).otherwise(F.get("found", F.lit(0)))
    return found.select("file", "pos", line.alias("line")).where("line IS NOT NULL")


def scan_csv_splits(spark: SparkSession, path: str, broken: str = "error") -> DataFrame:
    """Rows of CSV files with headers, all columns text, with the row sequence.

    Each file is read by as many tasks as it has splits, whatever its cells hold.  Files need not share a header: the
    result has the columns of all.  The sequence follows the paths of the files and the places of records in them, however
    files are packed into tasks.  A record with content beyond its header is an error, or left out with
    ``broken="skip"``.  The driver sees the different headers; one row per file is sent to the executors.
    """
    records = materialize(csv_file_records(spark, path), "records")
    first = records.groupBy("file").agg(F.min("pos").alias("pos"))
    heads = materialize(records.join(F.broadcast(first), ["file", "pos"]).withColumnsRenamed(
        {"line": "__head", "pos": "first"}), "heads")
    told = records.join(F.broadcast(heads), "file").select(
        F.col("file").alias("__payload_seq"), (F.col("pos") - F.col("first")).alias("__pos"), F.col("line").alias("__line"),
        "__head")
    lines = heads.groupBy("__head").agg(F.min("file").alias("file")).orderBy("file").limit(MOST_HEADERS + 1).collect()
    if len(lines) > MOST_HEADERS:
        raise ValueError(f"files have more than {MOST_HEADERS} different headers")
    if not lines:
        raise ValueError(f"no file at {path} has any content")
    return CsvPayloads(told, [r["__head"] for r in lines], [], moved=True).rows(broken)
