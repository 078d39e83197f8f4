"""Shared plumbing of the operators: the cluster's shared folder, written intermediates, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.runtime import discard, fresh_path, remove, settled, shared_dir, shuffle_partitions

__all__ = ["components", "dir_size_partitions", "discard", "file_system", "fresh_path", "map_batches", "own_names", "plain_names", "remove", "shared_dir", "shuffle_partitions", "unused", "written"]

#: Rows that are turned into Python objects at a time; the Arrow batches that hold them are bounded in bytes by Spark
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB where it is unset).
BATCH_ROWS = 256

#: ``df`` written to the shared folder and read back: its lineage ends there and survives lost executors.
written = settled


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with as many underscores before it as make it no column of the frames, whatever their case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ... in order, so that no name of its own meets one of an operator's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def own_names(df: DataFrame) -> list[Column]:
    """The columns of ``plain_names(df)`` under their own names again."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns)]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it, for a URI of any scheme pyarrow knows or a plain path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose function gets slices of at most ``rows`` rows, so few texts at a time are Python objects."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(1, b.num_rows), rows):
                yield b.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(sliced(batches))

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star steps.

    Returns (node, root) for every node that has an edge to another node; root is the component's least node.
    Null ends and self-loops are ignored; repeated edges count once; no edge gives no row. Every round is written to
    the shared folder; only a count comes to the driver. A hub's minimum is pre-aggregated before the shuffle and the
    join that spreads it is an ordinary shuffled join, which adaptive execution splits when the hub is skewed.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = written(now, "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        # large star: every node's larger neighbours are linked to its least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and itself, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        now = nxt
        # stable when it is a set of stars: the same edges as a round before
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)


def dir_size_partitions(rows: int, per_task: int, least: int) -> int:
    """How many tasks share ``rows`` rows at ``per_task`` each, at least ``least``."""
    return max(least, -(-rows // per_task))
