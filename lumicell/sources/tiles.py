"""Rasters stored as tiles: little-endian blocks of rows, one binary value for each tile."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicell.operators.gather import by_tile, packed
from lumicell.sources.cells import unique_stems

TILE = 256


def pixels_to_tiles(pixels: DataFrame, side: int = TILE, dtype: str = "<f8", level: int = 0) -> DataFrame:
    """``image_id, channel, level, tile_y, tile_x, y0, x0, height, width, dtype, data`` from pixel rows; absent pixels are 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image_id, channel, ty, tx = key
        y, x = rows["y"].to_numpy() - ty * side, rows["x"].to_numpy() - tx * side
        grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype)
        grid[y, x] = rows["value"].to_numpy()
        return pd.DataFrame([(image_id, channel, level, ty, tx, ty * side, tx * side, *grid.shape, dtype, grid.tobytes())], columns=names)

    names = ["image_id", "channel", "level", "tile_y", "tile_x", "y0", "x0", "height", "width", "dtype", "data"]
    kind = dict(pixels.dtypes)["image_id"]
    schema = f"image_id {kind}, channel string, level int, tile_y long, tile_x long, y0 long, x0 long, height int, width int, dtype string, data binary"
    by, kinds = ["image_id", "channel"], {"value": "<f8"}
    narrow = pixels.select("image_id", "channel", *[F.col(c).cast("long").alias(c) for c in ("y", "x")], F.col("value").cast("double").alias("value"))
    return by_tile(packed(narrow, by, side, 0, kinds), by, side, kinds, run, schema)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet by image and channel, so that readers skip the others; row groups keep tile ranges for more skipping."""
    tiles.sortWithinPartitions("image_id", "channel", "tile_y", "tile_x").write.mode("overwrite").partitionBy("image_id", "channel").parquet(path)


def tiles_in_window(tiles: DataFrame, y0: int, x0: int, height: int, width: int, side: int = TILE) -> DataFrame:
    """Tiles that meet a window, by a condition on tile numbers that reaches the scan."""
    return tiles.filter(f"tile_y between {y0 // side} and {(y0 + height - 1) // side} and tile_x between {x0 // side} and {(x0 + width - 1) // side}")


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    """Pixel rows ``image_id, channel, y, x, value`` of tiles, unpacked by Arrow batches, a tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y0, x0, h, w, dtype, data = (batch.column(k)[i].as_py() for k in range(2, 8))
                value = np.frombuffer(data, dtype).astype(float)
                y, x = np.divmod(np.arange(h * w), w)
                take = pa.array(np.full(h * w, i, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(y + y0), pa.array(x + x0), pa.array(value)], names=["image_id", "channel", "y", "x", "value"])

    kind = dict(tiles.dtypes)
    narrow = tiles.select("image_id", "channel", F.col("y0").cast("long").alias("y0"), F.col("x0").cast("long").alias("x0"), "height", "width", "dtype", "data")
    return narrow.mapInArrow(run, f"image_id {kind['image_id']}, channel {kind['channel']}, y long, x long, value double")


def _commits(spark: SparkSession, path: str) -> tuple[object, object, list[tuple[int, str]], int]:
    """The file system, the folder of commits, ``(number, folder of the version)`` of each commit in order, and the next free number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    taken = [int(n.removeprefix("taken-")) for n in found if n.startswith("taken-")]
    return files, folder, sorted((int(n[:8]), n[9:]) for n in found if n[:8].isdigit()), max(taken, default=0) + 1


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole segmentation; an error if there is none."""
    commits = _commits(spark, path)[2]
    if not commits:
        raise FileNotFoundError(f"no segmentation in {path}")
    return f"{path}/{commits[-1][1]}"


def write_segmentation(cells: DataFrame, mask: DataFrame, path: str, model: str, markers: list[str], nuclear: str | None, names: dict[int, str]) -> None:
    """A pair of cell table (text by image) and mask tiles (Parquet by image), with what made them, as one transaction.

    All is written to a folder of its own first; then one empty file, whose name has the next number and that folder, makes it the current
    version.  So a reader meets either the old pair or the new one, whenever a job stops.  Numbers are taken before, by a file that only one
    writer can make; if two write at once, the later number counts.  The version before stays for those who read it; older ones are removed.

    ``names`` are the images' file names, from which the pair's names come; equal stems get numbers.
    """
    spark = cells.sparkSession
    version = f"version-{uuid.uuid4()}"
    here = spark._jvm.org.apache.hadoop.fs.Path
    files, folder, _, number = _commits(spark, path)
    while not files.createNewFile(here(folder, f"taken-{number:08d}")):
        number += 1
    cells.write.option("header", True).option("sep", "\t").partitionBy("image_id").csv(f"{path}/{version}/cells")
    labelled = mask.select("image_id", F.lit("mask").alias("channel"), "y", "x", F.col("label").cast("double").alias("value"))
    write_tiles(pixels_to_tiles(labelled, dtype="<u4"), f"{path}/{version}/mask")
    about = spark.createDataFrame([(model, markers, nuclear)], "model_name string, marker_names array<string>, nuclear_channel_name string")
    about.coalesce(1).write.json(f"{path}/{version}/about")
    pairs = [(i, f"{stem}_cells.tsv", f"{stem}_masks") for i, stem in zip(names, unique_stems(list(names.values())))]
    spark.createDataFrame(pairs, "image_id long, cells_file string, mask_file string").coalesce(1).write.json(f"{path}/{version}/pairs")
    files.createNewFile(here(folder, f"{number:08d}-{version}"))
    for n, old in _commits(spark, path)[2][:-2]:
        files.delete(here(folder, f"{n:08d}-{old}"), False)
        files.delete(here(f"{path}/{old}"), True)


def read_segmentation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(cells with image_id and the name of their file, what made them)`` of the current version."""
    path = current_version(spark, path)
    pairs = spark.read.schema("image_id long, cells_file string, mask_file string").json(f"{path}/pairs")  # a row for each image
    cells = spark.read.option("header", True).option("sep", "\t").option("inferSchema", True).csv(f"{path}/cells").withColumn("image_id", F.col("image_id").cast("long"))
    about = spark.read.schema("model_name string, marker_names array<string>, nuclear_channel_name string").json(f"{path}/about")
    return cells.join(pairs.select("image_id", F.col("cells_file").alias("file")), "image_id"), about


def read_segmentation_mask(spark: SparkSession, path: str) -> DataFrame:
    """The mask tiles of the current version."""
    return spark.read.parquet(f"{current_version(spark, path)}/mask")


def read_mask_tiles(tiles: DataFrame) -> DataFrame:
    return tiles_to_pixels(tiles).filter("value > 0").select("image_id", "y", "x", F.col("value").cast("long").alias("label"))
