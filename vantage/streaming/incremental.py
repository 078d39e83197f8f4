"""Incremental analysis of arriving snapshots with Structured Streaming.

Rows of entry points (or any keyed work items) arrive as files. Each micro-batch keeps what earlier batches worked out
for the same key and version, works out the rest, and appends it; a batch that is run again writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantage.operators.incremental import latest


def known(spark: SparkSession, store: str) -> DataFrame | None:
    """What the store holds, or None before the first batch."""
    try:
        return spark.read.parquet(store)
    except AnalysisException:
        return None


def process(batch: DataFrame, batch_id: int, store: str, key: list[str], order: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Work out the rows of a batch whose key the store doesn't have. Of equal keys in a batch the last by ``order`` counts."""
    spark = batch.sparkSession
    rows = latest(batch, key, order)
    old = known(spark, store)
    if old is not None:
        old = old.where(F.col("batch_id") != batch_id)
        rows = rows.join(old.select(*key).distinct(), key, "left_anti")
    work(rows).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(store)


def start(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: list[str], order: list[str], work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Follow a folder of JSON-lines snapshots until what is there now is worked out; a later start goes on from there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(lambda df, n: process(df, n, store, key, order, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_versions(events: DataFrame, key: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """The newest version of each key in a stream of (key..., version, time), late rows beyond ``lateness`` left out."""
    return events.withWatermark(time, lateness).groupBy(*key, F.window(time, "1 day")).agg(F.max_by("version", time).alias("version"), F.max(time).alias("at"))
