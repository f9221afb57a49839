"""Exact ranked lexical search over bit-sliced Bloom signatures.

Each document has a Bloom signature of its terms, and of how often each occurs: a term is entered once for each of a few
thresholds that its count reaches.  Documents of like size share a block, whose signatures are kept in slices: one
bitmap of documents for each bit place.  The bitmaps of a term's places, combined, hold every document that has the
term, and few others.  So the sum over an item's terms of what each could score at most, where the bitmaps show it, is
never less than a document's true score.

A search reads the slices twice.  The first reading finds the documents with the highest bounds, and the k-th best exact
score among these is a score that every result must reach.  The second finds all documents whose bound reaches it; all
of these are scored exactly on their whole text, and whatever else there is cannot be among the best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm.common import written
from tidyloom.llm.terms import cut, id_and_bytes, parts_of, words_in_sql

#: Counts at which a term is entered once more.
THRESHOLDS = np.array([1, 2, 3, 5, 9, 17, 33])
#: Slices per entry and bits per entry of the largest document of a size class: at most 2 in 300 entries are false.
HASHES, BITS_PER_ENTRY = 4, 12
BLOCK_BITS = 1 << 23
#: Terms of the items of one search, counted once per item; more items take several searches.
TERMS_PER_SEARCH = 1 << 18
#: Keys and item numbers that a join sends to all executors at most, some 8 MB.
SENT_ENTRIES = 1 << 20
ITEMS_PER_PRODUCT, DOCS_PER_PRODUCT = 64, 2048
SCALE = 1_000_000_000

_BLOCK = ("bits int, keys binary, lengths binary, slices binary, n_docs long, n_terms long, "
          "asked array<long>")


class Items(NamedTuple):
    """Items as lists of term numbers with repeats counted: those of item i are ``terms[starts[i]:starts[i + 1]]``."""

    ids: list[int | None]
    vocabulary: list[bytes]
    starts: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


class Corpus(NamedTuple):
    """What scores need to know: documents with terms, terms with repeats, and the weight of each asked term."""

    docs: int
    terms: int
    weights: np.ndarray

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * self.docs // max(self.terms, 1)


def term_factor(count: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return SCALE * count // (1000 * count + 12 * damping)


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8")


def _places(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The bit places of entries, one row each."""
    x = hashes + np.asarray(level, "u8") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (((x & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype="u8")) % np.uint64(bits)).astype("i8")


class _Block:
    """Documents of one size class on their way into slices."""

    def __init__(self, size_class: int):
        self.bits = BITS_PER_ENTRY << size_class
        self.room = max(1, BLOCK_BITS // self.bits)
        self.keys: list[int] = []
        self.lengths: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, key: int, length: int, hashes: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(key)
        self.lengths.append(length)
        self.hashes.append(hashes)
        self.counts.append(counts)
        return len(self.keys) == self.room

    def row(self) -> dict:
        doc = np.repeat(np.arange(len(self.keys)), [len(h) for h in self.hashes])
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        table = np.zeros((self.bits, len(self.keys)), bool)
        for level, threshold in enumerate(THRESHOLDS):
            reached = counts >= threshold
            table[_places(hashes[reached], level, self.bits), doc[reached][:, None]] = True
        return {"bits": self.bits, "keys": np.array(self.keys, "i8").tobytes(),
                "lengths": np.array(self.lengths, "i8").tobytes(),
                "slices": np.packbits(table, axis=1, bitorder="little").tobytes()}


def _counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of texts; term numbers and counts of all texts, and where those of each begin; terms with repeats."""
    found = cut(texts)
    coded = found.words.dictionary_encode()
    vocabulary = coded.dictionary
    width = max(1, len(vocabulary))
    text = np.repeat(np.arange(len(texts)), np.diff(found.before))
    pairs, counts = np.unique(text * width + coded.indices.to_numpy(), return_counts=True)
    edges = np.searchsorted(pairs, np.arange(len(texts) + 1) * width)
    return vocabulary, pairs % width, counts, edges, np.diff(found.before)


def index(docs: DataFrame, asked: list[bytes]) -> DataFrame:
    """Blocks of slices of ``key, text``, and how often each of the ``asked`` terms occurs in documents of a task.

    Documents without terms are in no block.  A task fills blocks as documents come by, so nothing is shuffled, and holds
    one open block per size class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        frequency = np.zeros(len(wanted), "i8")
        blocks: dict[int, _Block] = {}
        n_docs = n_terms = 0
        fields = pa.schema([("bits", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()),
                            ("slices", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                            ("asked", pa.list_(pa.int64()))])

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([values], fields)

        for part in (p for b in batches for p in parts_of(b)):
            vocabulary, terms, counts, edges, lengths = _counted(part.column("text"))
            number = pc.fill_null(pc.index_in(vocabulary, wanted), -1).to_numpy(zero_copy_only=False)[terms]
            frequency += np.bincount(number[number >= 0], minlength=len(wanted))
            hashes = _hashes(vocabulary.to_pylist())[terms]
            entries = np.searchsorted(THRESHOLDS, counts, "right")
            total = np.concatenate([[0], np.cumsum(entries)])
            n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
            keys = part.column("key").to_pylist()
            for doc in np.flatnonzero(lengths).tolist():
                mine = slice(edges[doc], edges[doc + 1])
                size_class = int(total[mine.stop] - total[mine.start] - 1).bit_length()
                block = blocks.setdefault(size_class, _Block(size_class))
                if block.add(keys[doc], int(lengths[doc]), hashes[mine], counts[mine]):
                    yield row(**blocks.pop(size_class).row())
        for size_class in sorted(blocks):
            yield row(**blocks.pop(size_class).row())
        if n_docs:
            yield row(n_docs=n_docs, n_terms=n_terms, asked=frequency.tolist())

    return docs.select("key", "text").mapInArrow(run, _BLOCK)


def _bounds(row: dict, items: Items, corpus: Corpus, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For shares of the items and of a block's documents: item numbers, first document, keys, and bounds as a matrix."""
    keys, lengths = np.frombuffer(row["keys"], "i8"), np.frombuffer(row["lengths"], "i8")
    slices = np.frombuffer(row["slices"], "u1").reshape(row["bits"], -1)
    damping = corpus.damping(lengths)
    # What a term adds at most once its count is known to reach a threshold: its count is below the next one.
    most = np.append(THRESHOLDS[1:] - 1, 0)
    steps = np.array([term_factor(np.full(len(keys), m), damping) if m else np.full(len(keys), SCALE // 1000) for m in most])
    steps = np.diff(steps, axis=0, prepend=0).astype("f4")
    for a in range(0, len(items.ids), ITEMS_PER_PRODUCT):
        b = min(a + ITEMS_PER_PRODUCT, len(items.ids))
        mine = slice(items.starts[a], items.starts[b])
        terms, column = np.unique(items.terms[mine], return_inverse=True)
        factors = np.zeros((b - a, len(terms)), "f4")
        line = np.repeat(np.arange(b - a), np.diff(items.starts[a:b + 1]))
        factors[line, column] = items.repeats[mine] * corpus.weights[items.terms[mine]]
        places = [_places(hashes[terms], level, row["bits"]) for level in range(len(THRESHOLDS))]
        for first in range(0, len(keys), DOCS_PER_PRODUCT):
            docs = slice(first, min(first + DOCS_PER_PRODUCT, len(keys)))
            part = slice(first // 8, (docs.stop + 7) // 8)
            gain = np.zeros((len(terms), docs.stop - docs.start), "f4")
            shown = np.full((len(terms), part.stop - part.start), 255, "u1")
            for level, at in enumerate(places):
                for j in range(HASHES):  # a count that reaches a threshold reaches the ones below
                    shown &= slices[at[:, j], part]
                if not shown.any():
                    break
                gain += np.unpackbits(shown, axis=1, bitorder="little")[:, :gain.shape[1]] * steps[level, docs]
            # Single precision: a relative margin far above its error keeps the bound a bound.
            yield np.arange(a, b), first, keys[docs], (factors @ gain) * np.float32(1.0001)


def _collect_items(rows: Iterable, vocabulary_of: dict[bytes, int]) -> Items:
    ids, starts, terms, repeats = [], [0], [], []
    for item, text in rows:
        counted: dict[int, int] = {}
        for word in cut(pa.array([bytes(text)], pa.binary())).words.to_pylist():
            number = vocabulary_of.setdefault(word, len(vocabulary_of))
            counted[number] = counted.get(number, 0) + 1
        ids.append(item)
        terms += sorted(counted)
        repeats += [counted[t] for t in sorted(counted)]
        starts.append(len(terms))
    return Items(ids, list(vocabulary_of), np.array(starts), np.array(terms, "i8"), np.array(repeats, "i8"))


_shared: dict[str, tuple] = {}


def _once(name: str, shared: Broadcast) -> tuple:
    """The value of a broadcast with the hashes of its terms, read once per Python worker."""
    if name not in _shared:
        _shared.clear()
        items, corpus = shared.value
        _shared[name] = items, corpus, _hashes(items.vocabulary)
    return _shared[name]


def _highest(blocks: DataFrame, name: str, shared: Broadcast, k: int) -> DataFrame:
    """``item, key, bound``: the documents with the ``k`` highest bounds of each item in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, hashes = _once(name, shared)
        best: list[list[tuple[float, int]]] = [[] for _ in items.ids]
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            for lines, _, keys, bounds in _bounds(row, items, corpus, hashes):
                some = min(k, bounds.shape[1])
                top = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
                for line, found in zip(lines.tolist(), top):
                    mine = [(float(bounds[line - lines[0], d]), int(keys[d])) for d in found]
                    best[line] = heapq.nlargest(k, best[line] + [m for m in mine if m[0] > 0])
        flat = [(i, key, bound) for i, found in enumerate(best) for bound, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in
                                          enumerate((pa.int32(), pa.int64(), pa.float64()))], ["item", "key", "bound"])

    return blocks.mapInArrow(run, "item int, key long, bound double")


def _reaching(blocks: DataFrame, name: str, shared: Broadcast, least: np.ndarray) -> DataFrame:
    """``key, items``: all documents whose bound reaches the least score of an item, and these items as numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, hashes = _once(name, shared)
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            found: dict[int, list[int]] = {}
            for lines, _, keys, bounds in _bounds(row, items, corpus, hashes):
                which, doc = np.nonzero(bounds >= np.maximum(least[lines], 1)[:, None])
                for line, d in zip(lines[which].tolist(), doc.tolist()):
                    found.setdefault(int(keys[d]), []).append(line)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()),
                                              pa.array(list(found.values()), pa.list_(pa.int32()))], ["key", "items"])

    return blocks.mapInArrow(run, "key long, items array<int>")


def _scored(docs: DataFrame, name: str, shared: Broadcast) -> DataFrame:
    """``item, doc_id, score`` of ``doc_id, text, items``: exact scores of whole texts, those above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, _ = _once(name, shared)
        wanted = pa.array(items.vocabulary, pa.binary())
        for part in (p for b in batches for p in parts_of(b)):
            vocabulary, terms, counts, edges, lengths = _counted(part.column("text"))
            number = pc.fill_null(pc.index_in(vocabulary, wanted), -1).to_numpy(zero_copy_only=False)[terms]
            damping = corpus.damping(lengths)
            ids, out = part.column("doc_id").to_pylist(), []
            for doc, asked in enumerate(part.column("items").to_pylist()):
                mine = slice(edges[doc], edges[doc + 1])
                known = number[mine] >= 0
                value = np.zeros(len(wanted), "i8")
                at = number[mine][known]
                value[at] = corpus.weights[at] * term_factor(counts[mine][known], damping[doc])
                for item in asked:
                    own = slice(items.starts[item], items.starts[item + 1])
                    score = int(items.repeats[own] @ value[items.terms[own]])
                    if score > 0:
                        out.append((item, ids[doc], score))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(
                (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, doc_id long, score long")


def _rows_of(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The rows whose text was found, with the items to score.

    Equal texts score alike, so beyond the ``k`` smallest ids none of them can be a result.  Other texts are moved only
    if the keys are too many to send.
    """
    found = written(found.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(
        F.collect_list("item").alias("items")), "to_score")
    entries = found.agg(F.coalesce(F.sum(F.size("items") + 2), F.lit(0))).first()[0]
    rows = docs.join(F.broadcast(found) if entries <= SENT_ENTRIES else found, "key")
    alike = Window.partitionBy("key", F.xxhash64(F.lit(1), "text")).orderBy(F.col("doc_id").asc_nulls_last())
    return rows.withColumn("n", F.row_number().over(alike)).where(f"n <= {k}").select("doc_id", "text", "items")


def _search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    items = _collect_items(rows, {})
    found = written(index(docs, items.vocabulary), "slices")
    told = found.where("n_docs IS NOT NULL")
    n_docs, n_terms = told.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    frequency = np.zeros(len(items.vocabulary), "i8")
    for term, n in told.select(F.posexplode("asked")).groupBy("pos").agg(F.sum("col")).collect():  # one row per asked term
        frequency[term] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype("i8")
    corpus = Corpus(n_docs, n_terms, weights)
    name, shared = uuid4().hex, spark.sparkContext.broadcast((items, corpus))
    blocks = found.where("bits IS NOT NULL").select("bits", "keys", "lengths", "slices")

    # Exact scores of the documents with the highest bounds give the score that a result has to reach.
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    seeds = _highest(blocks, name, shared, k).withColumn("n", F.row_number().over(by_bound)).where(f"n <= {k}")
    seeds = written(seeds.select("key", F.array("item").alias("items")), "seeds")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = _scored(_rows_of(docs, seeds, k), name, shared)
    first = first.withColumn("rank", F.row_number().over(by_score)).where(f"rank = {k}")
    least = np.zeros(len(items.ids), "i8")
    for item, score in first.select("item", "score").collect():  # at most one row per item
        least[item] = score

    reaching = _reaching(blocks, name, shared, least)
    scores = _scored(_rows_of(docs, reaching, k), name, shared)
    best = scores.withColumn("rank", F.row_number().over(by_score)).where(f"rank <= {k}")
    ids = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", per_search: int = TERMS_PER_SEARCH,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` rows of ``docs`` that score highest for each row of ``items``.

    Scores are positive; an item with fewer such documents has fewer rows.  Equal scores go by ascending id, null ids
    last.  Each row is a document, and each row of ``items`` an item, of its own, repeated ones too.  Null and empty
    texts have no terms: such documents are never found and do not count, such items find nothing.  Other columns are
    left out, so their names cannot clash.  An empty table on either side gives an empty result.

    Items come to the driver in shares of bounded size, each of which is a search of its own.
    """
    # The key leads back from slices to texts; a text that shares it by chance is scored once more than needed.
    docs = id_and_bytes(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    items = id_and_bytes(items, item_id_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    items = written(items.withColumn("n", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    shares = max(1, -(-int(size) // per_search))
    found = None
    for share in range(shares):
        mine = items.where(F.pmod(F.xxhash64("n"), F.lit(shares)) == share).select("item_id", "text")
        one = _search(docs, [tuple(r) for r in mine.toLocalIterator()], k)
        found = one if found is None else found.union(one)
    return found


#: The same by scoring every document that has a term of the item.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words_in_sql("text")} AS ws FROM documents),
s AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, {words_in_sql("text")} AS ws FROM benchmark),
t AS (SELECT q, term, count(*) AS repeats FROM (SELECT q, unnest(ws) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws) * n) // l AS m FROM d, s WHERE len(ws) > 0),
scores AS (SELECT q, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM t JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, r, doc_id),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
           FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
"""
