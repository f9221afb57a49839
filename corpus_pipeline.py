"""Cleaning of a corpus, from raw documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidyloom.llm import packing, pii, simhash, suffix_dedup, toxicity
from tidyloom.llm.common import scratch, table
from tidyloom.llm.queries import BYTE_BPE, held_out

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a classifier, learned from the labels outside the held-out part, scores at the threshold or above."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    scored = toxicity.score(docs, *model, keep=rest)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that with the smallest id, null ids last; of rows that share it, or have none, the
    first as numbered in a written table."""
    return simhash.first_rows(docs, shingle=4, max_bits=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has too, in whole characters; no document goes."""
    # Whole characters take more memory per byte, and workers still hold some of earlier stages: smaller chunks.
    found = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), whole_characters=True, chunk_bytes=2 << 20)
    return _with_text(found.withColumn("text", F.col("kept").cast("string")))


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in all texts."""
    return _with_text(pii.pseudonymize(docs))


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a sequence."""
    return packing.pack(docs, BYTE_BPE, capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic), ("simhash", near_duplicates), ("suffix_array", without_repeats), ("pii", pseudonymized),
    ("packing", packed)]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
