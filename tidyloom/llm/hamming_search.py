"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are cut into substrings, each with an index from value to codes.  If two codes differ in at most
``m * (r + 1) - 1`` bits, one of their ``m`` substrings differs in at most ``r``.  So a query looks up all substring
values at radius 0, then 1, and so on, verifies what it finds with whole codes, and stops as soon as its k-th verified
distance is within what the radii so far are sure to cover.

Distinct codes are dealt to blocks and the query set to chunks.  Each chunk meets each block in one visit, which builds
the index of the block once and takes the queries by slices; it returns the best codes per query, and the best of these
are the answer.  A code that many rows have is searched once, and is found as its ``k`` smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm.common import ship, written
from tidyloom.llm.words import spread

BITS = 64
CODES_PER_BLOCK = 1 << 16
#: A slice bounds what a search holds at once; a chunk is what one built index serves, fewer slices where tasks are few.
QUERIES_PER_SLICE, SLICES_PER_CHUNK = 512, 64


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, code``: bit i is set where component i is positive, of at most 64 components; longer vectors raise.

    Null vectors and rows without id are left out, since there is nothing to compare or to name; null components count
    as not positive.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            codes = np.zeros(len(lists), "u8")
            offsets = lists.offsets.to_numpy()
            lengths = np.diff(offsets)
            if len(lengths) and lengths.max() > BITS:
                raise ValueError(f"a vector has {lengths.max()} components, more than {BITS}")
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(0).to_numpy()
            at = spread(np.zeros(len(lengths), "i8"), lengths).astype("u8")
            np.bitwise_or.at(codes, np.repeat(np.arange(len(lists)), lengths), (values > 0).astype("u8") << at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes.view("i8"))], ["vec_id", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "vec_id long, code long")


class MultiIndex:
    """Indexes of a block's codes by substring."""

    def __init__(self, codes: np.ndarray, width: int | None = None):
        self.codes = codes
        self.width = width or int(np.clip(round(np.log2(max(len(codes), 2))), 4, 16))
        self.shifts = list(range(0, BITS, self.width))
        self.widths = [min(self.width, BITS - s) for s in self.shifts]
        self.order, self.starts = [], []
        for part, width in zip(self.parts(codes), self.widths):
            self.order.append(np.argsort(part, kind="stable"))
            self.starts.append(np.searchsorted(part[self.order[-1]], np.arange((1 << width) + 1)))

    def parts(self, codes: np.ndarray) -> list[np.ndarray]:
        return [((codes >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype("i8")
                for s, w in zip(self.shifts, self.widths)]

    def nearest(self, queries: np.ndarray, tie: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the positions and distances of its ``k`` nearest codes, or all, by distance and ``tie``."""
        count = len(self.shifts)
        best_q, best_c, best_d = (np.zeros(0, "i8") for _ in range(3))
        open_ = np.arange(len(queries))
        for radius in range(self.width + 1):
            found_q, found_c = [best_q], [best_c]
            parts = self.parts(queries[open_])
            for j, (part, width) in enumerate(zip(parts, self.widths)):
                for flips in combinations(range(width), radius):
                    value = part ^ sum(1 << b for b in flips)
                    first = self.starts[j][value]
                    sizes = self.starts[j][value + 1] - first
                    if sizes.any():
                        found_q.append(np.repeat(open_, sizes))
                        found_c.append(self.order[j][spread(first, sizes)])
            best_q, best_c = np.concatenate(found_q), np.concatenate(found_c)
            best_d = np.bitwise_count(queries[best_q] ^ self.codes[best_c]).astype("i8")
            # A code is there at most once by each part and once from before, so as many entries hold k codes or more.
            up_to = np.bincount(best_q * (BITS + 1) + best_d, minlength=len(queries) * (BITS + 1))
            enough = up_to.reshape(-1, BITS + 1).cumsum(1) >= k * (count + 1)
            bound = np.where(enough.any(1), enough.argmax(1), BITS)
            near = best_d <= bound[best_q]
            pair = np.unique(best_q[near] * len(self.codes) + best_c[near])
            best_q, best_c = pair // len(self.codes), pair % len(self.codes)
            best_d = np.bitwise_count(queries[best_q] ^ self.codes[best_c]).astype("i8")
            order = np.lexsort((tie[best_c], best_d, best_q))
            best_q, best_c, best_d = best_q[order], best_c[order], best_d[order]
            rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            best_q, best_c, best_d = (x[rank < k] for x in (best_q, best_c, best_d))
            # All codes within this distance have been found; with all found, nothing is left to cover.
            covered = count * (radius + 1) - 1
            within = np.bincount(best_q[best_d <= covered], minlength=len(queries))
            done = within >= min(k, len(self.codes))
            out = done[best_q] & np.isin(best_q, open_)
            for q in np.flatnonzero(done[open_]):
                q = open_[q]
                mine = slice(*np.searchsorted(best_q, [q, q + 1]))
                yield int(q), best_c[mine], best_d[mine]
            best_q, best_c, best_d = (x[~out] for x in (best_q, best_c, best_d))
            open_ = open_[~done[open_]]
            if not len(open_):
                return


def top_k(codes: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` nearest rows of ``vec_id, code`` for each row that is a query.

    A query is a row like any other, so it finds itself; ties go to the smaller id, and if there are fewer than ``k``
    rows all are found.  A repeated row or id counts once; of an id with several codes each code is searched.  An empty
    table gives an empty one.
    """
    codes = written(codes.select("vec_id", "code").distinct(), "codes")
    # Rows per code are cut to k before they meet, however many share it.
    members = codes.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(f"n <= {k}")
    members = written(members, "members")
    distinct = members.where("n = 1")
    asked = codes.where(is_query).select("code").distinct()
    blocks = max(1, -(-distinct.count() // CODES_PER_BLOCK))
    slices = max(1, -(-asked.count() // QUERIES_PER_SLICE))
    tasks = 2 * codes.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-slices // SLICES_PER_CHUNK), min(slices, -(-tasks // blocks)))

    def gather(table: pa.Table, name: str, key: str) -> pa.Table:
        table = table.sort_by("code")
        out = {key: table.column(key)[:1], name: pa.array([table.column("code").to_numpy().tobytes()], pa.binary())}
        if "least" in table.schema.names:
            out["least"] = pa.array([table.column("least").to_numpy().tobytes()], pa.binary())
        return pa.table(out)

    def spread_by(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64("code"), F.lit(count)).cast("int").alias(column)

    block_rows = distinct.select("code", F.col("vec_id").alias("least"), spread_by("block", blocks)).groupBy(
        "block").applyInArrow(lambda t: gather(t, "codes", "block"), "block int, codes binary, least binary")
    chunk_rows = asked.select("code", spread_by("chunk", chunks)).groupBy("chunk").applyInArrow(
        lambda t: gather(t, "queries", "chunk"), "chunk int, queries binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            own, least, asked = (np.frombuffer(row[c], "i8") for c in ("codes", "least", "queries"))
            index = MultiIndex(own.view("u8"))
            for at in range(0, len(asked), QUERIES_PER_SLICE):
                some = asked[at:at + QUERIES_PER_SLICE]
                found = list(index.nearest(some.view("u8"), least, k))
                if not found:
                    continue
                sizes = [len(c) for _, c, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some[[q for q, _, _ in found]], sizes)),
                     pa.array(own[np.concatenate([c for _, c, _ in found])]),
                     pa.array(np.concatenate([d for _, _, d in found]).astype("i4"))], ["query", "code", "distance"])

    # The query set against all rows: each chunk of queries visits each block.
    visits = block_rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    pairs = visits.join(chunk_rows, "chunk").repartition(min(blocks * chunks, 20_000), "block", "chunk")
    near = pairs.select("codes", "least", "queries").mapInArrow(search, "query long, code long, distance int")
    near = near.join(members.select("code", "vec_id"), "code")
    order = Window.partitionBy("query").orderBy("distance", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return codes.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(
        best.select("query", "rank", "vec_id", "distance"), "query").select("query_id", "rank", "vec_id", "distance")


#: The same by comparing the query set with all rows, with the same rules for nulls and repeated rows.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS bits FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, q.bits, v.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, v.bits),
        lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
      FROM v q JOIN v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, bits ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10
"""
