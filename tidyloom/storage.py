"""Where intermediate tables go.

A run cuts its lineage by writing a parquet table into the shared folder the cluster names in
``spark.checkpoint.dir``.  A written table outlives any executor, is read back with column pruning, and gives every
later step the very same rows.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BYTES_PER_PIECE = 128 * 1024
# Estimates count compressed bytes, so a partition of this size is a few hundred megabytes in memory.
SHUFFLE_BYTES = 64 * 1024 * 1024
MOST_SHUFFLE_PARTITIONS = 200_000
# Writer options for rows that may be whole files: each row is looked at before a page or row group goes on.  Parquet looks
# at every hundredth at the earliest, and both writer and reader would hold what it has let through.
PAYLOAD_OPTIONS = {
    "parquet.block.size": 4 * 1024 * 1024, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.check.estimate": False,
}

# The paths given out in each `discarding` block of a thread.
_collected = threading.local()
_sizing_lock = threading.Lock()
# By session: its shuffle partitions, then those that running blocks ask for.
_sizes: dict[int, list[int]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder of this application: in ``spark.checkpoint.dir``, else below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{configured.rstrip('/')}/{spark.conf.get('spark.app.id')}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}/{label}"
    for paths in getattr(_collected, "blocks", []):
        paths.append(path)
    return path


def materialize(df: DataFrame, label: str, payloads: bool = False) -> DataFrame:
    """Write ``df`` as parquet and return the table read back; ``payloads`` says that its rows may be whole files.

    Counting the result afterwards is cheap, it reads file footers only, and unlike metrics observed on the way it
    cannot count a task twice that ran again after an executor was lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**PAYLOAD_OPTIONS if payloads else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread puts below the shared folder in the block when it ends; results must be out by then."""
    paths: list[str] = []
    blocks = _collected.__dict__.setdefault("blocks", [])
    blocks.append(paths)
    try:
        yield
    finally:
        blocks.remove(paths)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def estimated_bytes(df: DataFrame) -> int:
    """What all inputs of a plan are estimated at; for a scan that rests on the sizes of its files.

    The estimate of a whole plan multiplies the sides of a join, which says nothing about what it shuffles.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


@contextmanager
def sized_shuffles(df: DataFrame) -> Iterator[None]:
    """Raise the number of shuffle partitions to what a shuffle of ``df`` needs, while in the block.

    The session default suits no particular table: at 100 TB, 200 partitions hold 500 GB each.  Adaptive execution
    merges partitions that turn out small, but does not split large ones of a grouping.
    """
    spark, key = df.sparkSession, "spark.sql.shuffle.partitions"
    wanted = min(estimated_bytes(df) // SHUFFLE_BYTES, MOST_SHUFFLE_PARTITIONS)
    # Datasets may run side by side in one session: the largest wish of those at work counts.
    session = spark._jsparkSession.hashCode()
    with _sizing_lock:
        sizes = _sizes.setdefault(session, [int(spark.conf.get(key))])
        sizes.append(wanted)
        spark.conf.set(key, str(max(sizes)))
    try:
        yield
    finally:
        with _sizing_lock:
            sizes.remove(wanted)
            spark.conf.set(key, str(max(sizes)))
            if len(sizes) == 1:
                del _sizes[session]


def _has_shuffle(node) -> bool:
    """Does a physical plan move rows between partitions?  Asks for the distributions its nodes need, so it works on
    plans to which no exchanges have been added yet, and sending a small table around does not count."""
    name = node.nodeName()
    if name == "Exchange" or name.startswith(("TakeOrdered", "CollectLimit", "GlobalLimit")):
        return True
    children = node.children()
    for i in range(children.size()):
        need = node.requiredChildDistribution().apply(i).getClass().getSimpleName()
        if need.startswith(("ClusteredDistribution", "OrderedDistribution", "AllTuples", "StatefulOp")):
            return True
    return any(_has_shuffle(children.apply(i)) for i in range(children.size()))


def _pieces(df: DataFrame) -> tuple[int, int]:
    """How many partitions a frame has, and into how many its estimated size could usefully be cut."""
    size = estimated_bytes(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Asking a plan with shuffles for its partitions would run them; what comes out of a shuffle is spread already.
    shuffled = _has_shuffle(df._jdf.queryExecution().sparkPlan())
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if shuffled else df.rdd.getNumPartitions()
    return partitions, min(cores, size // BYTES_PER_PIECE)


def stage(df: DataFrame, always: bool = False) -> DataFrame:
    """Write an input that leaves cores idle once, spread over all of them, and return that table.

    A file that cannot be split is one task however large the cluster is, in each pass over it again.  An input with
    enough partitions is left as it is, unless ``always`` asks for a table because the input is slow to read; even then
    it is not shuffled.
    """
    if not df.columns or any(kind in f.dataType.simpleString() for f in df.schema for kind in ("void", "interval")):
        return df
    partitions, useful = _pieces(df)
    if useful >= 2 * max(partitions, 1):
        return materialize(df.repartition(useful), "staged")
    return materialize(df, "staged") if always else df
