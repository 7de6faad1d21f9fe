"""Neighbourhoods on segmentation masks ``(image_id, y, x, label)``, where absent pixels are background.

Work is done on square tiles with a halo: a pixel goes to its own tile and to those whose halo it is in, so
that each tile is complete by itself and has a bounded size.  The forms by joins of pixel rows give the same
rows and serve as a check.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.functions.values import DEFAULT_BUFFER_PX
from lumicell.operators.gather import by_tile, packed

TILE = 256
COMPARTMENTS = ("all", "nucleus", "cytoplasm_membrane")


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets no farther than ``radius``."""
    r = int(np.floor(radius))
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def shifted(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """``grid[y - dy, x - dx]`` at ``[y, x]``, zero beyond the sides."""
    out = np.zeros_like(grid)
    h, w = grid.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = grid[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
    return out


def boundary_grid(labels: np.ndarray) -> np.ndarray:
    """Labelled pixels with a 4-neighbour of another label; beyond the sides is background."""
    differs = np.zeros(labels.shape, bool)
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        differs |= shifted(labels, dy, dx) != labels
    return differs & (labels > 0)


def rows_to_boundary(boundary: np.ndarray) -> np.ndarray:
    """How far each pixel's nearest boundary pixel in its own column is; 2^40 or so without any."""
    none = 1 << 40
    y = np.arange(boundary.shape[0])[:, None]
    above = np.maximum.accumulate(np.where(boundary, y, -none), 0)
    below = np.minimum.accumulate(np.where(boundary, y, 2 * none)[::-1], 0)[::-1]
    return np.minimum(y - above, below - y)


def near_grid(boundary: np.ndarray, radius: float) -> np.ndarray:
    """Pixels whose exact Euclidean distance to a boundary pixel is at most ``radius``, in two passes whatever the radius.

    Along columns the distance g to the nearest boundary pixel; along rows such a pixel then covers all within sqrt(radius^2 - g^2),
    and covered stretches are added up by their ends.
    """
    height, width = boundary.shape
    most = math.floor(radius * radius)
    reach = np.array([math.isqrt(most - g * g) for g in range(math.isqrt(most) + 1)])
    g = rows_to_boundary(boundary)
    y, x = np.nonzero(g < len(reach))
    w = reach[g[y, x]]
    ends = np.bincount(y * (width + 1) + np.maximum(x - w, 0), minlength=height * (width + 1)) - np.bincount(y * (width + 1) + np.minimum(x + w + 1, width), minlength=height * (width + 1))
    return np.cumsum(ends.reshape(height, width + 1), 1)[:, :width] > 0


def tile_grid(rows: pd.DataFrame, tile_y: int, tile_x: int, side: int, halo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(labels, y, x, own)``: a tile with its halo as an array, the places of its rows in it, and which are in its core."""
    y, x = (rows[c].to_numpy() - t * side + halo for c, t in (("y", tile_y), ("x", tile_x)))
    grid = np.zeros((side + 2 * halo, side + 2 * halo), np.int64)
    grid[y, x] = rows["label"].to_numpy()
    return grid, y, x, (y >= halo) & (y < halo + side) & (x >= halo) & (x < halo + side)


def mask_flags(mask: DataFrame, buffer: float = DEFAULT_BUFFER_PX, side: int = TILE) -> DataFrame:
    """``image_id, y, x, label, boundary, near``; ``near``: within ``buffer`` of a boundary pixel of any cell.

    A pixel at the image's edge is a boundary, as nothing lies beyond it.
    """
    halo = int(np.ceil(buffer)) + 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image_id, ty, tx = key
        grid, y, x, own = tile_grid(rows, ty, tx, side, halo)
        boundary = boundary_grid(grid)
        near = near_grid(boundary, buffer)
        y, x = y[own], x[own]
        return pd.DataFrame({"image_id": image_id, "y": y + ty * side - halo, "x": x + tx * side - halo, "label": grid[y, x], "boundary": boundary[y, x], "near": near[y, x]})

    narrow = mask.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x", "label")])
    kind, by, kinds = dict(mask.dtypes)["image_id"], ["image_id"], {"label": "<i8"}
    return by_tile(packed(narrow, by, side, halo, kinds), by, side, kinds, run, f"image_id {kind}, y long, x long, label long, boundary boolean, near boolean")


def inner_boundaries(mask: DataFrame, side: int = TILE) -> DataFrame:
    return mask_flags(mask, 0, side).filter("boundary").select("image_id", "y", "x", "label")


def inner_boundaries_by_join(mask: DataFrame) -> DataFrame:
    """The same by pixel rows: fewer than four 4-neighbours have the pixel's label."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    seen = mask.select("image_id", F.explode(steps).alias("s"), "y", "x", "label").select("image_id", F.expr("y + s.dy").alias("y"), F.expr("x + s.dx").alias("x"), "label")
    same = seen.groupBy("image_id", "y", "x", "label").agg(F.count("*").alias("same"))
    return mask.join(same, ["image_id", "y", "x", "label"], "left").filter(F.coalesce("same", F.lit(0)) < 4).select("image_id", "y", "x", "label")


def display_boundaries(mask: DataFrame, windows: DataFrame, images: DataFrame, side: int = TILE) -> DataFrame:
    """Boundary pixels inside windows, where a window's own edge is no boundary; local coordinates."""
    from lumicell.operators.raster import check_windows, read_region

    check_windows(windows, images)
    inside = read_region(mask, windows, side)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    seen = inside.select("image_id", "region_id", F.explode(steps).alias("s"), "fy", "fx", "label").select("image_id", "region_id", F.expr("fy + s.dy").alias("fy"), F.expr("fx + s.dx").alias("fx"), "label")
    same = seen.groupBy("image_id", "region_id", "fy", "fx", "label").agg(F.count("*").alias("same"))
    last = lambda c, extent: (F.col(c) == 0).cast("int") + (F.col(c) == F.col(extent) - 1).cast("int")
    expected = 4 - last("fy", "height") - last("fx", "width")
    joined = inside.join(same, ["image_id", "region_id", "fy", "fx", "label"], "left")
    return joined.filter(F.coalesce("same", F.lit(0)) < expected).select("image_id", "region_id", "fy", "fx", "label")


def compartment_mask(mask: DataFrame, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX, side: int = TILE) -> DataFrame:
    """Mask pixels of a compartment: all, those farther than ``buffer`` from any boundary, or those within it."""
    if compartment not in COMPARTMENTS:
        raise ValueError(f"unknown compartment {compartment}")
    if buffer < 0:
        raise ValueError("the buffer cannot be negative")
    if compartment == "all":
        return mask.select("image_id", "y", "x", "label")
    near = F.col("near") if compartment == "cytoplasm_membrane" else ~F.col("near")
    return mask_flags(mask, buffer, side).filter(near).select("image_id", "y", "x", "label")


def compartment_mask_by_join(mask: DataFrame, compartment: str, buffer: float = DEFAULT_BUFFER_PX) -> DataFrame:
    """The same by pixel rows: boundary pixels spread over a disk, then joined."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk(buffer)])
    edge = inner_boundaries_by_join(mask)
    near = edge.select("image_id", "y", "x", F.explode(steps).alias("s")).select("image_id", F.expr("y + s.dy").alias("y"), F.expr("x + s.dx").alias("x")).distinct()
    return mask.join(near, ["image_id", "y", "x"], "left_semi" if compartment == "cytoplasm_membrane" else "left_anti")


def mask_violations(mask: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, problem`` for masks that do not fit their image."""
    bounds = mask.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("label").alias("least"), F.count_if(F.col("label").isNull()).alias("nulls"))
    joined = bounds.join(images.select("image_id", "height", "width"), "image_id", "full")
    outside = (F.col("y0") < 0) | (F.col("x0") < 0) | (F.col("y1") >= F.col("height")) | (F.col("x1") >= F.col("width"))
    problem = (
        F.when(F.col("height").isNull(), "no image").when(F.col("y0").isNull(), "no mask").when(outside, "outside the image")
        .when((F.col("least") < 0) | (F.col("nulls") > 0), "label negative or missing")
    )
    return joined.select("image_id", problem.alias("problem")).filter("problem is not null")


def validate_mask(mask: DataFrame, images: DataFrame) -> None:
    from lumicell.operators.raster import require

    require(mask_violations(mask, images), "a mask does not fit its image")
