"""Global ranks without bringing all rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch, beyond its last row; a batch is what a Python worker holds at once.
TILE_BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a local master may leave it unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return folder or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, kept in the shared folder, for a broadcast if it has at most ``most`` rows; a larger one is joined by a shuffle."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def broadcasts_by_measured_size(spark: SparkSession) -> None:
    """Let Spark broadcast a join's side on its own only by the size measured when that side has been shuffled.

    Before a job runs Spark guesses sizes from those of files.  A row of a file may become 256 pixels and a tile is one binary value to it, so
    its guess for a raster is thousands of times too small, and the whole raster would go through the driver.  Broadcasts that are asked for stay.
    """
    guess, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(guess))
    spark.conf.set(guess, "-1")


def in_small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once when whole tiles are passed to it.  The session's own bound is only ever lowered.

    The bound is in bytes: a tile of several channels has more than a million of them, a pixel row some tens, and few rows in a batch would slow those.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > TILE_BATCH_BYTES:
        spark.conf.set(name, str(TILE_BATCH_BYTES))


def distributed_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row by ``order``, which should be unique.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the rows of all
    partitions before, and only those counts come to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = checkpointed(ranged.withColumn("rank_part", F.spark_partition_id()).withColumn("rank_row", F.monotonically_increasing_id()))
    counts = {r["rank_part"]: (r["count"], r["low"]) for r in numbered.groupBy("rank_part").agg(F.count("*").alias("count"), F.min("rank_row").alias("low")).collect()}
    starts, at = [], 0
    for part in sorted(counts):
        n, low = counts[part]
        starts.append((part, at - low))
        at += n
    offsets = spark.createDataFrame(starts, "rank_part int, rank_start long")
    return numbered.join(F.broadcast(offsets), "rank_part").withColumn(name, F.col("rank_row") + F.col("rank_start")).drop("rank_part", "rank_row", "rank_start")
