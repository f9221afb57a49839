"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints within ``max_bits`` of each other are within half of it on one of their two halves.  For each half, a
vantage-point tree splits the distinct codes by their Hamming distance to a vantage point.  A code's leaf is its home
shard; by the triangle inequality its partners can only be in leaves whose boundaries it comes near to, and it visits
those as well.  Inside a shard the same split is repeated until blocks are small enough to compare bit by bit.  Equal
texts and equal fingerprints are one code from the start, and a shard returns a spanning forest, not its pairs.

The tree of shards has a bounded number of leaves and is the only thing sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import free_name, id_and_text, written
from tidyloom.llm.components import components

SEED = 42
CODES_PER_SHARD = 16_000
#: Bounds the tree that tasks get: 12 bytes a leaf.  Past it shards grow, and are split further inside their task.
MOST_SHARDS = 1 << 15
SAMPLE_PER_SHARD = 8
BLOCK = 1 << 22

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[shingle - 1:] - 1 if len(words) >= shingle else ends[-1:] - 1
    starts = np.concatenate([[0], ends])[:len(last)]
    count, ones = len(last), np.zeros(64, "i8")
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, 1 << 16):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)].tolist(),
                                                           last[at:at + (1 << 16)].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype="i8")
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 row_col: str | None = None) -> DataFrame:
    """``doc_id, code``, the fingerprint as a signed long, of every row, and the long ``row_col`` if it is given; null
    texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), "u8", batch.num_rows)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(codes.view("i8"))], [*rest.schema.names, "code"])

    more = (row_col,) if row_col else ()
    return id_and_text(docs, id_col, text_col, *more).mapInArrow(
        run, ", ".join(["doc_id long", *(f"`{c}` long" for c in more), "code long"]))


def halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = codes.view("u8")
    return (codes >> np.uint64(32)).astype("u4"), codes.astype("u4")


class VantageTree:
    """Leaves of a tree over 32-bit codes, split by distance to vantage points."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = SEED):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.children: list[tuple[int, int]] = []  # a node, or -1 - leaf
        self.leaves = 0
        self.root = self._build(sample, leaves, np.random.default_rng(seed))

    def _build(self, sample: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves > 1 and len(sample) > 1:
            vantage = rng.choice(sample)
            distance = np.bitwise_count(sample ^ vantage)
            radius = int(np.median(distance))
            inner = distance <= radius
            if inner.all():
                radius -= 1
                inner = distance <= radius
            if inner.any():
                node = len(self.vantage)
                self.vantage.append(int(vantage))
                self.radius.append(radius)
                self.children.append((0, 0))
                first = self._build(sample[inner], (leaves + 1) // 2, rng)
                self.children[node] = (first, self._build(sample[~inner], leaves // 2, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, codes: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that codes within ``reach`` of the given ones may be in, with the positions of those."""
        todo = [(self.root, np.arange(len(codes)))]
        while todo:
            node, mine = todo.pop()
            if not len(mine):
                continue
            if node < 0:
                yield -1 - node, mine
                continue
            distance = np.bitwise_count(codes[mine] ^ np.uint32(self.vantage[node])).astype("i8")
            inner, outer = self.children[node]
            todo.append((inner, mine[distance - reach <= self.radius[node]]))
            todo.append((outer, mine[distance + reach > self.radius[node]]))


class Forest:
    """Sets of positions, joined by batches of pairs."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def join_codes(codes: np.ndarray, keys: np.ndarray, queries: np.ndarray, members: np.ndarray, max_bits: int,
               forest: Forest) -> None:
    """Link each query to each member within ``max_bits``, among those whose ``keys`` are within half of that."""
    rng = np.random.default_rng(SEED)
    todo = [(queries, members)]
    while todo:
        q, m = todo.pop()
        if not len(q) or not len(m):
            continue
        if len(q) * len(m) > BLOCK and len(m) > 256:
            # The vantage point splits members in two; queries go where partners can be.  The half's distances are
            # tried first, then those of whole codes, should all members have one half.
            for values, reach in ((keys, max_bits // 2), (codes, max_bits)):
                vantage = values[rng.choice(m)]
                of_m = np.bitwise_count(values[m] ^ vantage).astype("i8")
                radius = int(np.median(of_m))
                inner = of_m <= radius if (of_m > radius).any() else of_m < radius
                radius = radius if (of_m > radius).any() else radius - 1
                if inner.any():
                    break
            else:
                inner = None
            if inner is not None:
                of_q = np.bitwise_count(values[q] ^ vantage).astype("i8")
                todo.append((q[of_q - reach <= radius], m[inner]))
                todo.append((q[of_q + reach > radius], m[~inner]))
                continue
        rows = max(1, BLOCK // len(m))
        for at in range(0, len(q), rows):
            part = q[at:at + rows]
            i, j = np.nonzero(np.bitwise_count(codes[part][:, None] ^ codes[m][None, :]) <= max_bits)
            forest.join(part[i], m[j])


def links(codes: DataFrame, max_bits: int) -> DataFrame:
    """Edges ``a, b`` that connect distinct ``code`` values within ``max_bits`` as all their pairs would."""
    total = codes.count()
    leaves = min(MOST_SHARDS, max(1, total // CODES_PER_SHARD))
    sample = np.array([r.code for r in codes.orderBy(F.xxhash64("code"), "code")
                       .limit(SAMPLE_PER_SHARD * leaves).collect()], "i8")
    trees = [VantageTree(h, leaves) for h in halves(sample)]
    reach = max_bits // 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("code").to_numpy()
            for t, (tree, keys) in enumerate(zip(trees, halves(values))):
                home = np.empty(len(keys), "i4")
                for leaf, mine in tree.route(keys, 0):
                    home[mine] = leaf
                for leaf, mine in tree.route(keys, reach):
                    mine = mine[home[mine] <= leaf]  # of two shards, the pair is found in the later one
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), 2 * leaf + t, "i4")), pa.array(home[mine] == leaf),
                         pa.array(values[mine])], ["shard", "home", "code"])

    def compare(group: pa.Table) -> pa.Table:
        at_home = group.column("home").to_numpy()
        values = group.column("code").to_numpy()
        keys = halves(values)[group.column("shard")[0].as_py() % 2]
        forest = Forest(len(values))
        join_codes(values.view("u8"), keys, np.arange(len(values)), np.flatnonzero(at_home), max_bits, forest)
        linked = np.flatnonzero(forest.root != np.arange(len(values)))
        return pa.table({"a": values[linked], "b": values[forest.root[linked]]})

    return (codes.mapInArrow(route, "shard int, home boolean, code long").groupBy("shard")
            .applyInArrow(compare, "a long, b long"))


def groups(of_docs: DataFrame, least: Column, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``code, root`` of the distinct codes, and ``root, least``, the smallest ``least`` of the rows of each group."""
    codes = written(of_docs.groupBy("code").agg(F.min(least).alias("least")), "codes")
    roots = components(links(codes.select("code"), max_bits))
    of_codes = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "root", F.coalesce("root", "code"))
    return of_codes.select("code", "root"), of_codes.groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, code, component_id`` of every row.

    Rows link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest ``doc_id``
    reachable.  Null and empty texts have fingerprint 0 and link like any other.  Repeated rows and ids are rows of
    their own; a component of null ids alone has a null id.  Extra columns are left out; an empty table gives an empty
    one.
    """
    of_docs = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    of_codes, least = groups(of_docs, F.col("doc_id"), max_bits)
    least = least.withColumnRenamed("least", "component_id")
    return of_docs.join(of_codes.join(least, "root").select("code", "component_id"), "code") \
        .select("doc_id", "code", "component_id")


def first_rows(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of `near_duplicates`: that with the smallest id, null ids last.

    Rows are told apart by a number that is fixed in a written table, so of rows that share an id, or have none, one
    stays too.  Columns of any name are kept.
    """
    key = free_name(docs, "_row")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    of_docs = written(fingerprints(rows, shingle, id_col, text_col, key), "fingerprints")
    _, least = groups(of_docs, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row")), max_bits)
    return rows.join(least.select(F.col("least.row").alias(key)), key, "left_semi").drop(key)
