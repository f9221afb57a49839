"""Toxicity by FTRL-proximal logistic regression over hashed words, their stems, word pairs and skip-grams.

A feature is present in a text or not.  Each coordinate has its own learning rate, and the L1 term keeps a weight at
zero until its feature has earned one, so a model is a short list of weights that goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import id_and_text, ship
from tidyloom.llm.words import distinct, parts_of

BITS = 20
#: Labelled rows to learn from at most; they are the first by a hash of their id, so a uniform sample of all of them.
TRAIN_DOCS = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.3
STEM = 5

_PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_EDGES = "\"'`.,;:!?()[]{}<>*#$%&/\\|~^_=+-@"


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, hashes of it without case and the punctuation around it, and of its stem, the first letters."""
    plain = [w.lower().strip(_EDGES) or w for w in words]
    return tuple(hash_array(np.array(x, object), categorize=False) if words else np.zeros(0, "u8")
                 for x in (plain, [f"{w[:STEM]}\n" for w in plain]))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and the number of the text each is from; repeats included."""
    words, at, offsets = distinct(pc.utf8_split_whitespace(pa.array([t.strip() for t in texts], pa.string())))
    h, stems = (x[at] for x in _hashes(words))
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    one = (of[1:] == of[:-1])
    two = (of[2:] == of[:-2])
    pairs = (h[:-1] * _PAIR + h[1:])[one]
    skips = (h[:-2] * _SKIP + h[2:])[two]
    all_ = np.concatenate([h, stems, pairs, skips])
    all_ = (all_ ^ (all_ >> np.uint64(33))) * _MIX
    numbers = (all_ >> np.uint64(64 - BITS)).astype("i8")
    return numbers, np.concatenate([of, of, of[:-1][one], of[:-2][two]])


def present(texts: list[str]) -> list[np.ndarray]:
    """The distinct features of each text."""
    numbers, of = features(texts)
    both = np.unique(of << BITS | numbers)
    cuts = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
    return [both[a:b] & ((1 << BITS) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def fit(examples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all coordinates and the intercept."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias, bias_n = np.log(rate / (1 - rate)), 0.0

    def weights(i) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in zip(examples, labels):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
            bias_n += g * g
            bias -= 0.02 * g / (1 + np.sqrt(bias_n))
    return weights(slice(None)), bias


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, train_docs: int = TRAIN_DOCS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on at most ``train_docs`` labelled rows outside ``held_out``, a condition on ``doc_id``.

    Rows without id or label teach nothing; of several labels of one id the highest counts, and of several rows of one id
    one does.  Only the hash-sampled labels are joined, and the one task that fits sees a row for each and no more.  Without labels the score is 0.5 throughout.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(known.limit(train_docs)), "doc_id")
    # Of rows that share an id one teaches, that of the least hash; hashes and rows are reduced where they lie.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    least = rows.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    rows = rows.join(F.broadcast(least), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (p for b in batches for p in parts_of(b)):
            found = [f.astype("<i4").tobytes() for f in present(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, pa.binary())],
                                             ["doc_id", "label", "features"])

    def train(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("label").to_pylist(),
                          group.column("features").to_pylist()), key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[2]))
        w, bias = fit([np.frombuffer(r[2], "<i4") for r in rows], np.array([min(max(r[1], 0), 1) for r in rows], float))
        used = np.flatnonzero(w)
        return pa.table({"feature": np.append(used, -1), "weight": np.append(w[used], bias)})

    model = (rows.mapInArrow(extract, "doc_id long, label int, features binary").groupBy(F.lit(0).alias("all"))
             .applyInArrow(lambda t: train(t), "feature long, weight double").collect())
    weights = np.zeros(1 << BITS, "f4")
    for r in model:
        if r.feature >= 0:
            weights[r.feature] = r.weight
    return weights, next((r.weight for r in model if r.feature < 0), 0.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and ``score`` (0 to 1) of every row.

    Null texts count as empty and score the intercept; null ids and repeated rows are scored like any other.  Kept
    columns, of any name, stay as they are; the others are left out; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    used = np.flatnonzero(weights)
    values = weights[used].astype("f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[used] = values
        for part, texts in (p for b in batches for p in parts_of(b)):
            numbers, of = features(texts)
            hit = np.flatnonzero(table[numbers])
            both = np.unique(of[hit] << BITS | numbers[hit])
            total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], len(texts)) + bias
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            rest = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores)], [*rest.schema.names, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, score double").toDF("doc_id", *keep, "score")
