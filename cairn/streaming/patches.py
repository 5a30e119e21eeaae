"""Annotation patches as a stream: each micro-batch adds a small table to the store, and now and then they are merged.

A store is a folder of ``base/v=n`` tables, the annotations after all batches below ``n``, and ``delta/v=n`` tables, the
patches of batch ``n``. A batch writes its own patches only, and a repeated batch writes them again in the same place; every
``COMPACT`` batches the base is written anew and what it holds is deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import NO_SEGMENT, patch
from ..sources.stores import versions, write_versioned

SCHEMA = "point_id long, segment_id int, class_id int, sent long"
STORED = "point_id long, segment_id int, class_id int"
#: Batches between two merges.
COMPACT = 50


def last_of_batch(batch: DataFrame) -> DataFrame:
    """The last patch of each point in a batch."""
    return batch.groupBy("point_id").agg(F.max_by(F.struct("segment_id", "class_id"), F.struct("sent", "segment_id", "class_id")).alias("p")).select("point_id", "p.*")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The annotations after all batches: the newest base and, of the patches since, the last of each point that has a segment."""
    bases = versions(spark, f"{store}/base")
    at = bases[-1] if bases else 0
    old = spark.read.parquet(f"{store}/base/v={at}") if bases else spark.createDataFrame([], STORED)
    deltas = [v for v in versions(spark, f"{store}/delta") if v >= at]
    if not deltas:
        return old
    each = [spark.read.parquet(f"{store}/delta/v={v}").select("point_id", "segment_id", "class_id", F.lit(v).alias("batch")) for v in deltas]
    said = F.when(F.col("segment_id").isNotNull() & (F.col("segment_id") != NO_SEGMENT), 1).otherwise(0)
    every = reduce(lambda a, b: a.unionByName(b), each)
    # of a point that no patch gives a segment, the first counts if the base lacks it
    order = F.struct(said, F.when(said == 1, F.col("batch")).otherwise(-F.col("batch")))
    last = every.groupBy("point_id").agg(F.max_by(F.struct("segment_id", "class_id"), order).alias("p")).select("point_id", "p.*")
    return patch(old, last)


def compact(spark: SparkSession, store: str) -> None:
    """Write a new base and delete the tables that it holds."""
    deltas = versions(spark, f"{store}/delta")
    if not deltas:
        return
    at = deltas[-1] + 1
    write_versioned(current(spark, store), f"{store}/base", at)
    for v in deltas:
        _delete(spark, f"{store}/delta/v={v}")
    for v in versions(spark, f"{store}/base"):
        if v < at:
            _delete(spark, f"{store}/base/v={v}")


def apply_patches(spark: SparkSession, source: str, store: str, checkpoint: str, available_now: bool = True):
    """Start the job; the batch number names the batch's table, so a repeated batch rewrites its own."""

    def merge(batch: DataFrame, number: int) -> None:
        write_versioned(last_of_batch(batch), f"{store}/delta", number)
        if number % COMPACT == COMPACT - 1:
            compact(spark, store)

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
