"""Words of texts as flat arrays: runs of ASCII letters and digits and of all other than ASCII characters, A-Z lowered.

Every byte of a character outside ASCII belongs to a word, so words can be cut from UTF-8 bytes, one byte for one byte,
and places in the normalised text are places in the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import id_and_text

SPACE = 32
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
NORMAL = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else SPACE for b in range(256))
BYTES_PER_PART = 4 << 20


class Cut(NamedTuple):
    """``starts`` and ``ends`` of all words in the bytes of some texts, and the number of words before each text."""

    words: pa.BinaryArray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """The words of texts without nulls, given as binary; places count from the first byte of the first text."""
    offsets = np.zeros(len(texts) + 1, "i8")
    flat = np.zeros(0, "u1")
    if len(texts):
        wide = pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], "i8" if wide else "i4")[texts.offset:][:len(texts) + 1].astype("i8")
        if offsets[-1] > offsets[0]:
            raw = memoryview(texts.buffers()[2])[offsets[0]:offsets[-1]]
            flat = np.frombuffer(bytes(raw).translate(NORMAL), "u1")
        offsets = offsets - offsets[0]
    inside = flat != SPACE
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(flat))]  # a text ends the word at its end
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype("i4")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(flat[inside])])
    return Cut(words, starts, ends, np.searchsorted(starts, offsets))


def parts_of(batch: pa.RecordBatch, column: str = "text", size: int = BYTES_PER_PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in a binary column, or one row where that is longer."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype("i8"))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def id_and_bytes(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of the text (null: empty) in ``text``."""
    return id_and_text(df, id_col, text_col, *more).withColumn("text", F.col("text").cast("binary"))


def words_in_sql(text: str) -> str:
    """The same words, as a DuckDB list."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce({text}, ''), '{upper}', '{upper.lower()}')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
