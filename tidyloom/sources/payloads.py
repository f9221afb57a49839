"""Datasets that arrive as payloads in a table column.

CSV text is taken apart by two regular expressions, natively and in one go: the first finds the records of a payload, the
second the cells of a record.  Together they accept every text, as a lenient CSV reader does: a cell is quoted if it begins
with a quote, two quotes inside stand for one, what follows the closing quote up to the next comma belongs to the cell,
quotes elsewhere are plain characters, and a quote that is never closed takes in the rest.  All loops are possessive, so
the effort grows with the text and no cell is too long.

Payloads need not share a header: cells go to the columns that their own header names, and the result has the columns of
all headers.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.config import ROW_SEQ
from tidyloom.functions.names import file_format, unique_names
from tidyloom.operators.columns import quoted, tag_in_order
from tidyloom.operators.nested import flatten_json
from tidyloom.storage import materialize, stage

_BREAK = r"(?:\r\n|[\r\n])"
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^",\r\n][^,\r\n]*+|)'
_RECORD = rf"((?:{_CELL},)*+{_CELL})(?:{_BREAK}|\z)"
_FIRST_RECORD = rf"\A(?:[ \t\f\x0B]*+{_BREAK})*+{_RECORD}"
_IN_QUOTES = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)(?:"(.*+))?\z'
#: Payloads of more different headers than this are no tables of one kind; the columns would be theirs all.
MOST_HEADERS = 10_000
PLACE = ["__payload_seq", "__pos"]
WIDE, EMPTY = "more cells than the header", "no record"


def payload_text(content: Column, data_type: T.DataType) -> Column:
    """Text of a binary or text payload without a byte-order mark; broken UTF-8 becomes replacement characters."""
    text = F.make_valid_utf8(content.cast("string")) if isinstance(data_type, T.BinaryType) else content
    return F.regexp_replace(text, "^\ufeff", "")


def csv_records(text: Column) -> Column:
    """The records of a CSV text as they are written, without their line breaks; blank lines are none."""
    plain = F.split(text, _BREAK)
    found = F.when(text.contains('"'), F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))).otherwise(plain)
    return F.filter(found, lambda r: r.rlike(r"\S"))


def csv_cells(record: Column) -> Column:
    """The cells of one record."""
    def value(cell: Column) -> Column:
        inside, after = (F.regexp_extract(cell, _IN_QUOTES, i) for i in (1, 2))
        return F.when(cell.startswith('"'), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), after)).otherwise(cell)

    # With a comma before each cell, the empty match after the last one is none.
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    return F.when(record.contains('"'), F.transform(found, value)).otherwise(F.split(record, ","))


def _header_line(text: Column) -> Column:
    """The first record, null if there is none; nothing behind it is looked at."""
    line = F.regexp_extract(text, _FIRST_RECORD, 1)
    return F.when(line.rlike(r"\S"), line)


def _column_names(header: list[str]) -> list[str]:
    return unique_names([name if name.strip() else f"Unnamed: {i}" for i, name in enumerate(header)])


@dataclass(frozen=True)
class CsvPayloads:
    """Parsed payloads: per record the ``keep`` columns, its place, its line and its payload's header line.

    A payload without any record has one row with neither.
    """

    records: DataFrame
    header_lines: list[str]
    keep: list[str]
    moved: bool

    @property
    def columns(self) -> list[str]:
        """The columns of all headers, in the order of their first payload."""
        return list(dict.fromkeys(n for line in self.header_lines for n in self._names(line)))

    @staticmethod
    def _names(line: str) -> list[str]:
        return _column_names(next(csv.reader(io.StringIO(line, newline=""))))

    def _told(self) -> DataFrame:
        """Records behind the header with their cells, the number of their header, and whether they are too wide."""
        travel = [F.col(quoted(c)) for c in [*self.keep, "__payload_seq", "__pos", "__line"]]
        if not self.header_lines:
            return self.records.select(*travel).where("false").withColumns(
                {"__cells": F.lit(None).cast("array<string>"), "__header": F.lit(0), "__wide": F.lit(False)})
        numbers = F.lit(0)
        if len(self.header_lines) > 1:
            pairs = [F.lit(x) for i, line in enumerate(self.header_lines) for x in (line, i)]
            numbers = F.element_at(F.create_map(*pairs), F.col("__head"))
        told = self.records.where("__pos > 0").select(
            *travel, numbers.alias("__header"), csv_cells(F.col("__line")).alias("__cells"))
        width = F.get(F.array(*[F.lit(len(self._names(line))) for line in self.header_lines]), F.col("__header"))
        beyond = F.slice("__cells", width + 1, F.greatest(F.size("__cells") - width, F.lit(0)))
        return told.withColumn("__wide", F.exists(beyond, lambda c: c != ""))

    def values(self, broken: str = "error") -> DataFrame:
        """The rows as text, empty cells as null, with their place; wide records are an error or left out."""
        told = self._told()
        wide = F.raise_error(F.lit("a record has more cells than the header")).cast("boolean")
        told = told.where(F.when(F.col("__wide"), wide).otherwise(True) if broken == "error" else ~F.col("__wide"))
        names = [self._names(line) for line in self.header_lines]

        def cell(column: str) -> Column:
            at = [own.index(column) if column in own else None for own in names]
            if len(set(at)) == 1:
                return F.get("__cells", F.lit(at[0]))
            return F.get("__cells", F.get(F.array(*[F.lit(i).cast("int") for i in at]), F.col("__header")))

        kept = [F.col(quoted(c)) for c in [*self.keep, *PLACE]]
        cells = told.select(*kept, *[F.nullif(cell(c), F.lit("")).alias(f"c{i}") for i, c in enumerate(self.columns)])
        return cells.toDF(*self.keep, *PLACE, *self.columns)

    def rows(self, broken: str = "error") -> DataFrame:
        """`values` with the row sequence in the order of payloads and of records in them."""
        return tag_in_order(self.values(broken), PLACE, self.moved)

    def rejects(self) -> DataFrame:
        """``keep`` columns, ``record`` (from 1, behind the header), ``reason`` and the line, of what has no rows."""
        kept = [F.col(quoted(c)) for c in self.keep]
        wide = self._told().where("__wide").select(
            *kept, F.col("__pos").alias("record"), F.lit(WIDE).alias("reason"), F.col("__line").alias("line"))
        empty = self.records.where("__head IS NULL").select(
            *kept, F.lit(None).cast("int").alias("record"), F.lit(EMPTY).alias("reason"),
            F.lit(None).cast("string").alias("line"))
        return wide.unionByName(empty)


def parse_csv_payloads(
    df: DataFrame, content: str = "file_content", keep: Iterable[str] = (), write: bool = False
) -> CsvPayloads:
    """Take payloads apart; the driver sees their different header lines only.

    Each payload is parsed where it lies.  With ``write`` the records become a table, for callers that read them more
    than once.
    """
    keep = list(keep)
    kept = [F.col(quoted(c)) for c in keep]
    tagged = df.select(*kept, F.col(quoted(content))).withColumn("__payload_seq", F.monotonically_increasing_id())
    df = tagged if write else stage(tagged)
    travel = [*kept, F.col("__payload_seq")]
    texts = df.select(*travel, payload_text(F.col(quoted(content)), df.schema[content].dataType).alias("__text"))
    heads = texts.select(*travel, "__text", _header_line(F.col("__text")).alias("__head"))
    records = heads.select(*travel, "__head", F.posexplode_outer(csv_records(F.col("__text"))).alias("__pos", "__line"))
    if write:
        records = materialize(records, "records")
        heads = records.where("__pos = 0")
    lines = heads.where("__head IS NOT NULL").groupBy("__head").agg(F.min("__payload_seq").alias("first"))
    lines = [r["__head"] for r in lines.orderBy("first").limit(MOST_HEADERS + 1).collect()]
    if len(lines) > MOST_HEADERS:
        raise ValueError(f"payloads have more than {MOST_HEADERS} different headers")
    return CsvPayloads(records, lines, keep, write or df is not tagged)


def scan_csv_payload(
    df: DataFrame, content: str = "file_content", keep: Iterable[str] = (), broken: str = "error"
) -> DataFrame:
    """Rows of CSV payloads, all columns text, plus the ``keep`` columns of their payload.

    Rows have the columns of all headers and are numbered in the order of payloads and of records in them.  A record with
    content beyond its header's columns is an error, or with ``broken="skip"`` among the `csv_payload_rejects`.
    """
    parsed = parse_csv_payloads(df, content, keep)
    if not parsed.header_lines and broken == "error":
        raise ValueError("no payload has any content")
    return parsed.rows(broken)


def csv_payload_rejects(df: DataFrame, content: str = "file_content", keep: Iterable[str] = ()) -> DataFrame:
    """Records that are wider than their header and payloads without any record, each with the reason."""
    return parse_csv_payloads(df, content, keep).rejects()


def scan_payload(df: DataFrame, file_name: str, content: str = "file_content") -> DataFrame:
    """Payloads of one dataset by its file extension; an unknown one is tried as CSV."""
    if file_format(file_name) == "json":
        text = payload_text(F.col(quoted(content)), df.schema[content].dataType)
        return flatten_json(df.select(text.alias(content)), content, tag=True, broken="error")
    return scan_csv_payload(df, content)


def scan_api_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Flat rows of API responses; missing responses and broken JSON yield none.

    Unlike file scans these rows carry no row sequence.
    """
    return flatten_json(df, response).drop(ROW_SEQ)
