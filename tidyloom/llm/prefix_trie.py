"""Trie of conversations by shared first turns, as a node table addressed by minimal perfect hashes.

A prefix is known by a digest: the exclusive or of a digest of each turn at its place.  So the digests of all prefixes
of a conversation are one running aggregate, which can be cut anywhere and put together again; a conversation of any
length is spread over as many tasks as its rows fill.  Rows with one digest must agree on depth, parent digest and last
turn, which is checked for each node; a collision stops the run instead of joining two nodes.

What is summed over a subtree is summed by shards that each hold whole paths: every node is counted once, in the shard of
its smallest member, whose path holds all nodes above it.  A shard enumerates the distinct digests of its paths, gives
each a slot by a minimal perfect hash that is verified against the digest, scatters what is counted into flat arrays,
and adds each depth into the slots of its parents, deepest first.  A node of many shards is the sum of what they have for
it, so a first turn that most conversations share is no hot group.  Paths are cut into bands of depths, each a row set
of its own; what lies below a band is added to where the path leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm.common import ship, written

#: First turns that are borrowed at most, and what a conversation borrows them from.
MOST_SHARED, FAMILY = 5, 100
#: Path rows per shard, and depths per band.
ROWS_PER_SHARD, BAND = 200_000, 4096
#: Parents with more children than this, and than a share of all nodes, are sent to all executors: 10,000 rows at most.
MANY_CHILDREN, SHARE_OF_NODES = 1000, 10_000
NODE = ["d1", "d2"]


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: each of n keys has its own slot below n.

    Level by level, keys are hashed into a bitmap with room for twice as many; a key alone in its place is settled, the
    rest go to the next level.  A key's slot is the rank of its place among all settled ones.  The keys are kept by slot,
    so a lookup can verify what it found; unknown keys have slot -1.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.size = len(first)
        self.levels: list[tuple[int, np.ndarray]] = []  # (places, slot of each place or -1)
        left, taken = np.arange(self.size), 0
        self.first, self.second = np.zeros(self.size, "u8"), np.zeros(self.size, "u8")
        while len(left):
            places = 2 * len(left) + 1
            at = self._hash(first[left], second[left], len(self.levels), places)
            alone = np.bincount(at, minlength=places)[at] == 1
            slots = np.full(places, -1)
            settled = np.sort(at[alone])
            slots[settled] = taken + np.arange(len(settled))
            self.first[slots[at[alone]]], self.second[slots[at[alone]]] = first[left[alone]], second[left[alone]]
            self.levels.append((places, slots))
            taken, left = taken + len(settled), left[~alone]

    @staticmethod
    def _hash(first: np.ndarray, second: np.ndarray, level: int, places: int) -> np.ndarray:
        x = first ^ (second * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) + np.uint64(level)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(places)).astype("i8")

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(first), -1), np.arange(len(first))
        for level, (places, slots) in enumerate(self.levels):
            found = slots[self._hash(first[open_], second[open_], level, places)]
            hit = found >= 0
            hit[hit] = ((self.first[found[hit]] == first[open_[hit]]) & (self.second[found[hit]] == second[open_[hit]]))
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        return out


def _turn(role: str, text: str) -> list[Column]:
    """``x1, x2``: 120 bits of the SHA-256 of role and text; and the code points of the text in ``size``."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(f"x{i}") for i, at in enumerate((1, 16), 1)]
    return [*half, F.char_length(text_).cast("long").alias("size")]


def _at_place(place: Column) -> list[Column]:
    """``z1, z2``: the digest of a turn at its place, counted from 1."""
    return [F.xxhash64(F.lit(i), place, "x1", "x2").alias(f"z{i}") for i in (1, 2)]


def _xor(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``conv, depth, d1, d2, p1, p2, x1, x2, size, last``: each prefix of each rebuilt conversation, as a digest with
    that of the prefix one shorter, and the last turn's digest and length.  Depth 0 is the root that all share."""
    ship(turns.sparkSession)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), *_turn(role_col, text_col))
    in_order = [F.col("turn").asc_nulls_first(), F.col("x1"), F.col("x2")]
    # A range of the order is a part; a conversation that is longer than a part continues in the next one.
    parted = written(rows.repartitionByRange(F.col("conv"), *in_order).withColumn("part", F.spark_partition_id()), "turns")
    counts = parted.groupBy("part", "conv").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    lengths = counts.groupBy("conv").agg(F.sum("n").alias("own")).select(
        "conv", "own", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), shared_turns(F.col("conv")).alias("h"))
    first = Window.partitionBy("conv").orderBy(*in_order)
    heads = parted.where(F.col("conv") % FAMILY == 0).withColumn("place", F.row_number().over(first)).where(
        f"place <= {MOST_SHARED}").select(F.col("conv").alias("base"), "place", "x1", "x2", "size")
    borrowed = lengths.join(heads, "base").where("place <= h").select(
        "conv", F.col("place").cast("long").alias("depth"), "x1", "x2", "size", *_at_place(F.col("place").cast("long")))
    borrowed = written(borrowed, "borrowed")
    taken = borrowed.groupBy("conv").agg(F.count("*").alias("taken"), F.bit_xor("z1").alias("h1"), F.bit_xor("z2").alias("h2"))
    convs = lengths.join(taken, "conv", "left").select(
        "conv", "h", "h1", "h2", F.coalesce("taken", F.lit(0)).alias("taken"),
        (F.coalesce("taken", F.lit(0)) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))

    within = Window.partitionBy("part", "conv").orderBy(*in_order)
    own = parted.withColumn("place", F.row_number().over(within)).join(
        counts.join(convs, "conv").drop("n"), ["part", "conv"])
    own = own.withColumn("place", F.col("place") + F.col("before")).where("place > h")
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
    own = own.select("part", "conv", "turn", "x1", "x2", "size", "depth", "total", "h1", "h2", *_at_place(F.col("depth")))
    running = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = written(own.withColumns({f"r{i}": F.bit_xor(f"z{i}").over(running) for i in (1, 2)}), "own")
    ends = own.groupBy("part", "conv").agg(F.bit_xor("z1").alias("e1"), F.bit_xor("z2").alias("e2"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", "conv", *[F.bit_xor(f"e{i}").over(earlier).alias(f"b{i}") for i in (1, 2)])
    own = own.join(ends, ["part", "conv"]).select(
        "conv", "depth", *[_xor(_xor(F.col(f"r{i}"), F.col(f"b{i}")), F.col(f"h{i}")).alias(f"d{i}") for i in (1, 2)],
        "z1", "z2", "x1", "x2", "size", (F.col("depth") == F.col("total")).alias("last"))

    of_conv = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    borrowed = borrowed.withColumns({f"d{i}": F.bit_xor(f"z{i}").over(of_conv) for i in (1, 2)}).join(
        convs.select("conv", "total"), "conv")
    borrowed = borrowed.select("conv", "depth", "d1", "d2", "z1", "z2", "x1", "x2", "size",
                               (F.col("depth") == F.col("total")).alias("last"))
    none = F.lit(None).cast("long")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("d1"),
                         F.lit(0).cast("long").alias("d2"), none.alias("p1"), none.alias("p2"), none.alias("x1"),
                         none.alias("x2"), F.lit(0).cast("long").alias("size"), (F.col("total") == 0).alias("last"))
    below = own.unionByName(borrowed).select(
        "conv", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("z1")).alias("p1"),
        F.col("d2").bitwiseXOR(F.col("z2")).alias("p2"), "x1", "x2", "size", "last")
    return below.unionByName(roots)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct digest, verified: ``conv`` the smallest member, ``n_convs``, ``n_ends``."""
    same = ["depth", "p1", "p2", "x1", "x2", "size"]
    found = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_") for c in same])
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same])
    collision = F.raise_error(F.lit("two prefixes share a digest")).cast("long")
    return found.withColumn("n_convs", F.when(alike, F.col("n_convs")).otherwise(collision)).drop(*[f"{c}_" for c in same])


def _band(depth: Column, band: int) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / band)


def _accumulate(table: pa.Table, band: int) -> pa.Table:
    """The sums of a shard's paths by node, from ``d1, d2, p1, p2, depth, leaves, saved``."""
    def column(name: str) -> np.ndarray:
        values = table.column(name).combine_chunks()
        return values.fill_null(0).to_numpy(zero_copy_only=False)

    first, second = column("d1").view("u8"), column("d2").view("u8")
    key = np.lexsort((second, first))
    one = np.ones(len(key), bool)
    one[1:] = (first[key][1:] != first[key][:-1]) | (second[key][1:] != second[key][:-1])
    key = key[one]
    slots = SlotTable(first[key], second[key])
    at = slots.slots(first, second)
    node = slots.slots(first[key], second[key])
    if len(np.unique(node)) != len(key) or (at < 0).any():
        raise ValueError("a digest has no slot of its own")
    depth, parent = np.zeros(slots.size, "i8"), np.full(slots.size, -1)
    depth[node] = column("depth")[key]
    parent[node] = slots.slots(column("p1").view("u8")[key], column("p2").view("u8")[key])
    # The root has no parent, and what the top of a lower band has is added to the band above as a carry.
    parent[(depth == 0) | (depth > 1) & ((depth - 1) % band == 0)] = -1
    sums = {name: np.zeros(slots.size, "i8") for name in ("leaves", "saved")}
    for name, values in sums.items():
        np.add.at(values, at, column(name))
    order = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order], prepend=-1))
    for a, b in zip(edges[::-1], np.append(edges[1:], len(order))[::-1]):
        level = order[a:b]
        level = level[parent[level] >= 0]
        for values in sums.values():
            np.add.at(values, parent[level], values[level])
    return pa.table({"d1": slots.first.view("i8"), "d2": slots.second.view("i8"), **sums})


def _subtrees(rows: DataFrame, nodes: DataFrame, band: int, per_shard: int) -> DataFrame:
    """``d1, d2, leaves, saved``: childless nodes and saved tokens in the subtree of each node."""
    counted = nodes.select("conv", "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
                           ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    below = counted.where(f"depth > {band}").groupBy("conv", _band(F.col("depth"), band).alias("b")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = below.select("conv", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "b"), lambda i: i * band)).alias("depth"), "leaves", "saved")
    counted = counted.union(below).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    shards = max(1, -(-rows.count() // per_shard))
    shard = F.pmod(F.xxhash64("conv", _band(F.col("depth"), band)), F.lit(shards)).alias("shard")
    dealt = rows.select("conv", "depth", "d1", "d2", "p1", "p2").join(counted, ["conv", "depth"], "left").select(
        shard, "d1", "d2", "p1", "p2", "depth", "leaves", "saved")
    sums = dealt.groupBy("shard").applyInArrow(lambda t: _accumulate(t, band), "d1 long, d2 long, leaves long, saved long")
    return sums.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(rows: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256`` of the nodes where conversations end: the hash of their ids, ascending, joined by commas.

    Ids are put in order by range and joined in pieces where they lie; only the pieces of a node meet in one task, which
    feeds them to the hash one after the other.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, conv = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv"))
            edge = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])) if len(d1) else []
            parts = [conv[a:b] for a, b in zip(edge, [*edge[1:], len(d1)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1[edge]), pa.array(d2[edge]), pa.array([int(p[0]) for p in parts], pa.int64()),
                 pa.array([",".join(map(str, p.tolist())) for p in parts], pa.string())], ["d1", "d2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"d1": node[0], "d2": node[1], "ends_sha256": state.hexdigest()}], fields)

        fields = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])
        node = state = None
        for batch in batches:
            done = []
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
                if node != (d1, d2):
                    done += [out()] if node else []
                    node, state = (d1, d2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from done
        if node:
            yield out()

    ended = rows.where("last").select("d1", "d2", "conv")
    ended = ended.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv")
    joined = ended.mapInArrow(pieces, "d1 long, d2 long, first long, ids string")
    joined = joined.repartition(*NODE).sortWithinPartitions("d1", "d2", "first")
    return joined.mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", band: int = BAND, per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes of the subtree), ``saved_tokens`` (code points that sharing saves in the subtree), ``ends_sha256``
    (hash of the ids of the conversations that end here).

    Turns go by number, null first; turns of one number go by a hash of role and text, so repeated rows are turns of
    their own and their order does not matter.  Null roles and texts count as empty.  Rows without conversation id belong
    to none and are left out.  Other columns are left out, so their names cannot clash.  Without any conversation there is
    no node.  Conversations of any length and any number of equal ones are taken whole.
    """
    rows = written(paths(turns, conv_col, turn_col, role_col, text_col), "paths")
    nodes = written(_nodes(rows), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").join(_subtrees(rows, nodes, band, per_shard), NODE).join(
        _ends(rows), NODE, "left")
    nodes = written(nodes.fillna({"n_children": 0}), "trie")

    # Parents with many children would make hot keys; there are few of them.
    many = max(MANY_CHILDREN, nodes.count() // SHARE_OF_NODES)
    parents = nodes.where("n_children > 0").select(
        F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children")
    large = F.broadcast(parents.where(f"n_children > {many}").drop("n_children"))
    small = parents.where(f"n_children <= {many}").drop("n_children")
    keys = ["p1", "p2"]
    linked = nodes.join(large, keys).unionByName(nodes.join(large, keys, "left_anti").join(small, keys, "left"))
    empty = hashlib.sha256(b"").hexdigest()
    return linked.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

#: The same by listing every prefix of every conversation as a whole.
SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n,
        {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(turn ORDER BY n) AS turns FROM t GROUP BY c),
h AS (SELECT *, CAST({_CRC32} AS BIGINT) % 6 AS h FROM l),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
      FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
p AS (SELECT c, len(turns) AS whole, d, list_slice(turns, 1, d) AS path
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS c, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole = d), '')) AS ends
      FROM p GROUP BY path, d),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS saved FROM n LEFT JOIN k USING (path)),
s AS (SELECT above, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved
      FROM (SELECT list_slice(path, 1, u) AS above, n_children, saved
            FROM (SELECT *, unnest(range(d + 1)) AS u FROM f)) GROUP BY above)
SELECT f.c AS conv_id, f.d AS depth, o.c AS parent_conv_id, f.n_convs, f.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON s.above = f.path LEFT JOIN n o ON f.d > 0 AND o.path = list_slice(f.path, 1, f.d - 1)
"""
