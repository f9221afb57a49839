"""The registered queries ``op1_`` to ``op13_`` and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm import (bpe_trie, decontaminate, hamming_search, html_extract, lexical_search, merkle, packing, pii,
                          prefix_trie, simhash, suffix_dedup, toxicity, warc)
from tidyloom.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_found")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("problem")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edited(table(spark, sf_dir, "documents"))
    return found.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.top_k(codes, F.col("vec_id") % 20 == 0, k=10)


def op7_html_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    return toxicity.score(docs, *model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op11_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op12_prefix_trie_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_array_dedup, op2_best_fit_packing, op3_pii_feistel, op4_warc_segments,
        op5_merkle_fingerprints, op6_hamming_top_k, op7_html_boosted_trees, op8_toxicity_ftrl, op9_bpe_trie,
        op10_simhash_vantage_points, op11_aho_corasick_decontamination, op12_prefix_trie_slots,
        op13_bit_sliced_search)}

SQL: dict[str, str] = {"op4_warc_segments": warc.SQL, "op5_merkle_fingerprints": merkle.SQL,
                       "op6_hamming_top_k": hamming_search.SQL, "op11_aho_corasick_decontamination": decontaminate.SQL,
                       "op12_prefix_trie_slots": prefix_trie.SQL, "op13_bit_sliced_search": lexical_search.SQL}
