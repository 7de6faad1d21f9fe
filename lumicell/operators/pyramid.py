"""Overviews and fields of view from stored tiles: levels of resolution, and counts of windows from summed-area tables.

A pyramid is a tile table in which level k + 1 has half the rows and columns of level k; each level is its own partition, so an overview
reads the tiles of one level.  A window's counts come from four corners of the summed table of each tile that it meets, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import few, in_small_batches
from lumicell.operators.blocks import AT, array_of
from lumicell.operators.mask import TILE
from lumicell.operators.raster import FOV_ATTEMPTS, FOV_LEAST_FRACTION, FOV_SIZE, OVERVIEW_SIZE, fov_candidates, nuclear_threshold, overview_level, percentiles, pick_good_fov

_TILE = ["image_id", "channel", "level", "tile_y", "tile_x", "y0", "x0", "height", "width", "dtype", "data"]


def _schema(tiles: DataFrame) -> str:
    kind = dict(tiles.dtypes)["image_id"]
    return f"image_id {kind}, channel string, level int, tile_y long, tile_x long, y0 long, x0 long, height int, width int, dtype string, data binary"


def halved(grid: np.ndarray) -> np.ndarray:
    """Means of the finite values of 2 x 2 pixels, not a number where there are none; a last odd row or column is a pair with nothing."""
    h, w = (-(-n // 2) for n in grid.shape)
    four = np.full((2 * h, 2 * w), np.nan)
    four[: grid.shape[0], : grid.shape[1]] = grid
    four = four.reshape(h, 2, w, 2).swapaxes(1, 2).reshape(h, w, 4)
    good = np.isfinite(four)
    return np.where(good.any(2), np.where(good, four, 0).sum(2) / np.maximum(good.sum(2), 1), np.nan)


def next_level(tiles: DataFrame, side: int = TILE) -> DataFrame:
    """The tiles of half the resolution.  Each tile is halved where it is; four neighbours meet in one new tile of the same (even) side."""
    if side % 2:
        raise ValueError("the side of tiles must be even")
    in_small_batches(tiles.sparkSession)

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [halved(array_of(r)) for r in batch.select(["height", "width", "dtype", "data"]).to_pylist()]
            new = {"height": pa.array([s.shape[0] for s in small], pa.int32()), "width": pa.array([s.shape[1] for s in small], pa.int32()), "dtype": pa.array(["<f8"] * len(small)), "data": pa.array([s.tobytes() for s in small], pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y0, x0 = r["tile_y"] * side, r["tile_x"] * side
                grid = np.full((max(p["y0"] + p["height"] for p in r["parts"]) - y0, max(p["x0"] + p["width"] for p in r["parts"]) - x0), np.nan)
                for p in r["parts"]:
                    grid[p["y0"] - y0 :, p["x0"] - x0 :][: p["height"], : p["width"]] = array_of(p)
                told = (r["image_id"], r["channel"], r["level"], r["tile_y"], r["tile_x"], y0, x0, *grid.shape, "<f8", grid.tobytes())
                kinds = (batch.schema.field("image_id").type, pa.string(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(told, kinds)], names=_TILE)

    halves = tiles.select(*_TILE).mapInArrow(halve, _schema(tiles.select(*_TILE)))
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    placed = halves.select("image_id", "channel", (F.col("level") + 1).alias("level"), half("tile_y"), half("tile_x"), F.struct(half("y0"), half("x0"), "height", "width", "dtype", "data").alias("part"))
    return placed.groupBy("image_id", "channel", "level", "tile_y", "tile_x").agg(F.collect_list("part").alias("parts")).mapInArrow(join, _schema(tiles))  # four parts at most


def write_pyramid(tiles: DataFrame, path: str, levels: int, side: int = TILE) -> None:
    """The tiles and ``levels`` halvings of them; each level is made from the stored one before."""
    for level in range(levels + 1):
        made = tiles if level == 0 else next_level(tiles.sparkSession.read.parquet(f"{path}/level={level - 1}").withColumn("level", F.lit(level - 1)), side)
        made.drop("level").sortWithinPartitions("image_id", "channel", "tile_y", "tile_x").write.mode("overwrite").parquet(f"{path}/level={level}")


def level_sizes(images: DataFrame, levels: int) -> DataFrame:
    """``image_id, level, height, width`` of a pyramid."""
    size = lambda c: F.ceil(F.col(c) / F.pow(F.lit(2), F.col("level"))).alias(c)
    every = images.select("image_id", "height", "width", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return every.select("image_id", "level", size("height"), size("width"))


def picked(extent: int, scale: float) -> np.ndarray:
    """Indices of an overview along one side: ``trunc(linspace(0, extent - 1, out))``."""
    out = max(round(extent / scale), 1)  # half to even
    at = np.floor(np.arange(out) * ((extent - 1) / (out - 1) if out > 1 else 0.0)).astype(np.int64)
    at[-1] = extent - 1 if out > 1 else 0
    return at


def overview(tiles: DataFrame, sizes: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """``image_id, channel, oy, ox, value`` of an overview whose longer side is at most ``max_size``, from the smallest level that is large enough.

    ``sizes(image_id, level, height, width)`` lists the stored levels.  Only tiles of the chosen level are read; no pixel becomes a row before it is picked.
    """
    in_small_batches(tiles.sparkSession)
    chosen = few(overview_level(sizes, max_size).select("image_id", F.col("level").cast("int").alias("level"), F.col("height").alias("full_height"), F.col("width").alias("full_width")))
    levels = [r["level"] for r in chosen.select("level").distinct().collect()]  # a few numbers
    met = tiles.filter(F.col("level").isin(levels)).join(chosen, ["image_id", "level"])
    kind = dict(tiles.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scale = max(r["full_height"] / max_size, r["full_width"] / max_size, 1.0)
                rows, columns = picked(r["full_height"], scale), picked(r["full_width"], scale)
                oy, ox = (np.flatnonzero((at >= r[start]) & (at < r[start] + r[n])) for at, start, n in ((rows, "y0", "height"), (columns, "x0", "width")))
                if not len(oy) or not len(ox):
                    continue
                value = array_of(r)[np.ix_(rows[oy] - r["y0"], columns[ox] - r["x0"])].astype(float)
                y, x = np.repeat(oy, len(ox)), np.tile(ox, len(oy))
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * len(y), batch.schema.field("image_id").type), pa.array([r["channel"]] * len(y), pa.string()), pa.array(y), pa.array(x), pa.array(value.ravel())], names=["image_id", "channel", "oy", "ox", "value"])

    narrow = met.select("image_id", "channel", "y0", "x0", "height", "width", "dtype", "data", "full_height", "full_width")
    return narrow.mapInArrow(run, f"image_id {kind}, channel string, oy long, ox long, value double")


def dapi_threshold(tiles: DataFrame, sizes: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """``image_id, threshold`` of the nuclear channel; see ``raster.dapi_threshold``."""
    return nuclear_threshold(percentiles(overview(tiles, sizes, max_size), ["image_id"], (0.2, 0.995)))


def _sums(inside: np.ndarray) -> np.ndarray:
    """The summed-area table, with a first row and column of zeros."""
    out = np.zeros((inside.shape[0] + 1, inside.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(inside, 0), 1, out=out[1:, 1:])
    return out


def positive_fraction(tiles: DataFrame, thresholds: DataFrame, windows: DataFrame, by: list[str], side: int = TILE) -> DataFrame:
    """``by, fraction`` of finite pixels above the image's threshold, 0 without any, for windows ``(image_id, …, y0, x0, height, width)`` and one channel's tiles.

    A window goes to the tiles that it meets, and each gives its two counts by one look-up in its summed-area tables.
    """
    span = lambda low, n: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor((F.col(low) + F.col(n) - 1) / side)))
    in_small_batches(tiles.sparkSession)
    rest = [c for c in by if c != "image_id"]
    kinds = dict(windows.dtypes)
    placed = windows.withColumn("tile_y", span("y0", "height")).withColumn("tile_x", span("x0", "width"))
    window = F.struct(*[F.col(c).alias(f"by_{c}") for c in rest], *[F.col(c).cast("long").alias(f"w_{c}") for c in ("y0", "x0", "height", "width")])
    listed = placed.groupBy(*AT).agg(F.collect_list(window).alias("windows"))
    met = tiles.select("image_id", *[F.col(c).cast("long").alias(c) for c in AT[1:]], "y0", "x0", "height", "width", "dtype", "data").join(listed, AT).join(few(thresholds.select("image_id", "threshold")), "image_id")
    types = {c: pa.int64() if kinds[c] in ("bigint", "int") else pa.string() for c in rest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grid = array_of(r).astype(float)
                tables = [_sums(np.isfinite(grid) & (grid > r["threshold"])), _sums(np.isfinite(grid))]
                top, low, height, width = (np.array([w[f"w_{c}"] for w in r["windows"]]) for c in ("y0", "x0", "height", "width"))
                ya, yb = (np.clip(v - r["y0"], 0, grid.shape[0]) for v in (top, top + height))
                xa, xb = (np.clip(v - r["x0"], 0, grid.shape[1]) for v in (low, low + width))
                counts = [t[yb, xb] - t[ya, xb] - t[yb, xa] + t[ya, xa] for t in tables]
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * len(top), batch.schema.field("image_id").type), *(pa.array([w[f"by_{c}"] for w in r["windows"]], types[c]) for c in rest), *map(pa.array, counts)], names=["image_id", *rest, "positive", "good"])

    columns = ", ".join(f"{c} {'long' if types[c] == pa.int64() else 'string'}" for c in rest)
    counted = met.mapInArrow(run, f"image_id {dict(tiles.dtypes)['image_id']}, {columns}, positive long, good long")
    fraction: Column = F.coalesce(F.sum("positive") / F.nullif(F.sum("good"), F.lit(0)), F.lit(0.0))
    return counted.groupBy(*by).agg(fraction.alias("fraction"))


def first_good_fov(tiles: DataFrame, drawn: DataFrame, thresholds: DataFrame, least: float = FOV_LEAST_FRACTION, side: int = TILE) -> DataFrame:
    """The first of the drawn windows with enough nuclear pixels; see ``raster.first_good_fov``."""
    return pick_good_fov(positive_fraction(tiles, thresholds, drawn, ["image_id", "attempt", "y0", "x0"], side), least)


def random_fov(tiles: DataFrame, sizes: DataFrame, size: int = FOV_SIZE, seed: int | None = 42, least: float = FOV_LEAST_FRACTION, attempts: int = FOV_ATTEMPTS, side: int = TILE) -> DataFrame:
    """``image_id, attempt, y0, x0, fraction``: the first draw with enough nuclear pixels, from tiles of a pyramid."""
    full = tiles.filter("level = 0")
    images = sizes.filter("level = 0").select("image_id", "height", "width")
    return first_good_fov(full, fov_candidates(images, size, seed, attempts), dapi_threshold(tiles, sizes), least, side)
