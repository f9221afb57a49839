"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``a, b`` that is not itself the smallest of its component.

    Each round links every neighbourhood to its minimum, so stars remain after a number of rounds that grows with the
    logarithm of the nodes.  Every round is a written table; no edges come to the driver.
    """
    linked = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        linked = written(linked, "edges")
        now = tuple(linked.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return linked.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = linked.union(linked.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = small.union(least).distinct()
