"""Session settings, written intermediates, and numbering without a global window."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = context.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="vantage-")
        at = _OWN[key]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/vantage-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing will read again. Other frames are left alone."""
    for df in frames:
        if path := getattr(df, "settled_at", None):
            remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[Column | str], out: str, value: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (1 where none is given) over the rows before a row in the order, as a long.

    Rows are dealt by ranges of the order; each range is summed up on its own, and only a sum for each range reaches the
    driver. Rows that tie in the whole order are in one range and stand in any order among themselves.
    """
    spark = df.sparkSession
    one = F.lit(1) if value is None else value
    n = shuffle_partitions(spark)
    dealt = settled(df.withColumn("_one", one.cast("long")).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, so_far = [], 0
    for r in dealt.groupBy("_range").agg(F.sum("_one").alias("n")).orderBy("_range").collect():  # a row for each partition
        before.append((r["_range"], so_far))
        so_far += r["n"] or 0
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(offsets, "_range").withColumn(out, F.col("_before") + F.coalesce(F.sum("_one").over(inside), F.lit(0)))
    return placed.select(*df.columns, out)


def session(name: str = "vantage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; those given win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    builder = SparkSession.builder.appName(name).config(map={**defaults, **{k.replace("_", "."): v for k, v in conf.items()}})
    return (builder.master(master) if master else builder).getOrCreate()
