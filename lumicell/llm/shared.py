"""Small helpers that several corpus operators use."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of whole texts; a batch is what a Python worker holds at once.
TEXT_BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local master may leave it unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the rows in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once when whole texts are passed to it.

    The session's own bound is only ever lowered, so a frame that runs later never meets larger batches.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(name, str(TEXT_BATCH_ROWS))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch; empty batches pass unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of numbers of several batches at a time, about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) * batch.num_rows >= rows:
            yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(batch.num_columns)]
            held = []
    if held:
        yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(held[0].num_columns)]


def power_of_two(least: int, most: int) -> int:
    """The smallest power of two that is ``least`` or more, but never above ``most``."""
    n = 1
    while n < least and n < most:
        n *= 2
    return n


def uniform_bits(column, bits: int, seed: str = ""):
    """The leading ``bits`` (at most 32) of an MD5 over ``seed`` and the column's text, as a long; null counts as its own value."""
    text = F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("\u0000")))
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), 32 - bits)


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a stage that returns the columns it is given: it sees ``doc_id``, ``text`` and ``source`` and plain names for all others, so that names with dots, quotes or other case do no harm."""

    @functools.wraps(stage)
    def run(documents: DataFrame, *args, **options) -> DataFrame:
        names = documents.columns
        plain = documents.toDF(*[n if n in ("doc_id", "text", "source") else f"other_{i}" for i, n in enumerate(names)])
        return stage(plain, *args, **options).toDF(*names)

    return run


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it as long as a column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
