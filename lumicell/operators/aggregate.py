"""Statistics of pixels by label, calls by threshold, and morphology."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import few
from lumicell.functions.values import DEFAULT_BUFFER_PX, close, column, finite, when_finite
from lumicell.operators.gather import by_tile, packed
from lumicell.operators.mask import COMPARTMENTS, TILE, boundary_grid, near_grid, shifted, tile_grid
from lumicell.operators.match import map_cells_to_labels
from lumicell.operators.raster import require

AT = ["image_id", "y", "x"]
BINS = 30
#: Rows of the tallest label whose hull is counted together with others, numbers that such labels have in one array, and what stands where a label has no edge.
HULL_ROWS, HULL_VALUES, NO_EDGE = 512, 1 << 18, 1 << 62
#: Weight of a border pixel by the code of its border neighbourhood (2 an edge, 10 a diagonal neighbour).
PERIMETER_WEIGHTS = {
    **dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0),
    **dict.fromkeys((21, 33), math.sqrt(2)),
    **dict.fromkeys((13, 23), (1 + math.sqrt(2)) / 2),
}


def with_threshold(parts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows with their image's threshold; an image without one is an error, raised by the task that meets it."""
    own = few(thresholds.select("image_id", F.col("threshold").cast("double").alias("threshold")))
    none = F.raise_error(F.concat(F.lit("no threshold, or no such channel, for image "), F.col("image_id").cast("string"))).cast("double")
    return parts.join(own, "image_id", "left").withColumn("threshold", F.when(F.col("threshold").isNull(), none).otherwise(F.col("threshold")))


def label_counts(label: np.ndarray, value: np.ndarray, inside: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """``labels, whole, denominator, positive, finite, total`` of labelled pixels."""
    names, at = np.unique(label, return_inverse=True)
    good = inside & np.isfinite(value)
    count = lambda chosen: np.bincount(at[chosen], minlength=len(names))
    return names, np.bincount(at, minlength=len(names)), count(inside), count(inside & ~np.isnan(value) & (value > threshold)), count(good), np.bincount(at[good], value[good], len(names)).astype(float)


def added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("image_id", "label").agg(
        F.sum("whole").alias("whole_pixels"), F.sum("denominator").alias("denominator_pixels"), F.sum("positive").alias("positive_pixels"), F.sum("finite").alias("finite_pixels"),
        F.when(F.sum("finite") > 0, F.sum("total")).alias("intensity_sum"),
    )


PARTS = "label long, whole long, denominator long, positive long, finite long, total double"


def pixel_statistics_by_label(pixels: DataFrame, mask: DataFrame, thresholds: DataFrame, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX, side: int = TILE) -> DataFrame:
    """Per image and label: ``whole_pixels, denominator_pixels, positive_pixels, finite_pixels, intensity_sum``.

    ``pixels`` has one channel; ``thresholds(image_id, threshold)`` has every image, else it is an error.  The whole cell counts every
    mask pixel, the others those of the compartment; a pixel that is not finite is in the denominator only.

    Mask and values meet once by tile, the mask with a halo where a compartment needs it, and a tile gives one partial row for each
    of its labels.
    """
    if compartment not in COMPARTMENTS:
        raise ValueError(f"unknown compartment {compartment}")
    halo = 0 if compartment == "all" else int(np.ceil(buffer)) + 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image_id, ty, tx, threshold = key
        masked = rows["label"].to_numpy() > 0
        grid, y, x, own = tile_grid(rows[masked], ty, tx, side, halo)
        values = np.full(grid.shape, np.nan)
        rest = rows[~masked]
        values[rest["y"].to_numpy() - ty * side + halo, rest["x"].to_numpy() - tx * side + halo] = rest["value"].to_numpy()
        y, x = y[own], x[own]
        inside = np.ones(len(y), bool)
        if halo:
            near = near_grid(boundary_grid(grid), buffer)[y, x]
            inside = near if compartment == "cytoplasm_membrane" else ~near
        return pd.DataFrame(dict(zip(["label", "whole", "denominator", "positive", "finite", "total"], label_counts(grid[y, x], values[y, x], inside, threshold)))).assign(image_id=image_id)

    long = lambda c: F.col(c).cast("long").alias(c)
    labelled = mask.select("image_id", long("y"), long("x"), long("label"), F.lit(float("nan")).alias("value"))
    placed = pixels.select("image_id", long("y"), long("x"), F.lit(0).cast("long").alias("label"), F.col("value").cast("double").alias("value"))
    kind, by, kinds = dict(mask.dtypes)["image_id"], ["image_id"], {"label": "<i8", "value": "<f8"}
    pieces = packed(labelled, by, side, halo, kinds).unionByName(packed(placed, by, side, 0, kinds))
    return added(by_tile(pieces, by, side, kinds, run, f"{PARTS}, image_id {kind}", lambda met: with_threshold(met, thresholds)))


def pixel_counts_by_label(*args, **options) -> DataFrame:
    return pixel_statistics_by_label(*args, **options).select("image_id", "label", "whole_pixels", "denominator_pixels", "positive_pixels")


def cell_statistics(statistics: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per table row ``(image_id, row_index, mask_label)``: denominator, mean (null without finite pixels) and fraction (0 without pixels)."""
    joined = resolved.join(statistics.withColumnRenamed("label", "mask_label"), ["image_id", "mask_label"], "left")
    return joined.select(
        "image_id", "row_index", "mask_label", F.coalesce("denominator_pixels", F.lit(0)).alias("denominator_pixels"),
        (F.col("intensity_sum") / F.nullif("finite_pixels", F.lit(0))).alias("mean_intensity"),
        F.coalesce(F.col("positive_pixels") / F.nullif("denominator_pixels", F.lit(0)), F.lit(0.0)).alias("positive_fraction"),
    )


def threshold_calls(cells: DataFrame, cutoff: float) -> DataFrame:
    """``positive``: there are pixels and more than ``cutoff`` of them are positive."""
    if not 0 <= cutoff <= 1:
        raise ValueError("the cut-off must be from 0 to 1")
    return cells.withColumn("positive", (F.col("denominator_pixels") > 0) & (F.col("positive_fraction") > cutoff))


def phenotype_by_threshold(cells: DataFrame, mask: DataFrame, pixels: DataFrame, thresholds: DataFrame, cutoff: float, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX, channels: DataFrame | None = None, channel: str | None = None) -> DataFrame:
    """``image_id, row_index, mask_label, denominator_pixels, mean_intensity, positive_fraction, positive`` for the cells of all images.

    ``channels(image_id, name)`` lists what each image has: with it, an image with cells but without ``channel`` is an error.
    """
    if channels is not None:
        own = channels.filter(F.col("name") == channel).select("image_id").distinct()
        require(cells.select("image_id").distinct().join(own, "image_id", "left_anti"), f"an image has no channel {channel}")
    statistics = pixel_statistics_by_label(pixels, mask, thresholds, compartment, buffer)
    return threshold_calls(cell_statistics(statistics, map_cells_to_labels(cells, mask)), cutoff)


def intensity_statistics(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Per image, label and channel the finite mean, population deviation, least and most; null without finite pixels."""
    value = when_finite(F.col("value"))
    joined = mask.select(*AT, "label").join(pixels, AT)
    return joined.groupBy("image_id", "label", "channel").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def morphology_basic(mask: DataFrame) -> DataFrame:
    """Area, centroid, bounding box (upper ends exclusive), extent and equivalent diameter of each label."""
    found = mask.groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("y").alias("y_min"), F.min("x").alias("x_min"), (F.max("y") + 1).alias("y_max"), (F.max("x") + 1).alias("x_max"),
    )
    return with_extent(found)


def with_extent(found: DataFrame) -> DataFrame:
    """Adds extent and equivalent diameter to areas and boxes."""
    box = (F.col("y_max") - F.col("y_min")) * (F.col("x_max") - F.col("x_min"))
    return found.withColumn("extent", F.col("area") / box).withColumn("diameter", F.sqrt(4 * F.col("area") / F.lit(math.pi)))


def morphology_ellipse(mask: DataFrame) -> DataFrame:
    """Axes and eccentricity of the ellipse with the label's second central moments."""
    found = mask.groupBy("image_id", "label").agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    return with_ellipse(found).select("image_id", "label", "major_axis", "minor_axis", "eccentricity")


def with_ellipse(found: DataFrame) -> DataFrame:
    """Adds axes and eccentricity to second central moments ``xx, yy, xy``."""
    middle, spread = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    large, small = middle + spread, F.greatest(middle - spread, F.lit(0.0))
    eccentricity = F.when(large > 0, F.sqrt(1 - small / large)).otherwise(0.0)
    return found.withColumns({"major_axis": 4 * F.sqrt(large), "minor_axis": 4 * F.sqrt(small), "eccentricity": eccentricity})


def perimeter_weights(labels: np.ndarray) -> np.ndarray:
    """The part of its label's perimeter that each pixel contributes; right for pixels two or more from the sides."""
    border = boundary_grid(labels)
    code = np.ones(labels.shape, np.int64)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                code += (10 if dy and dx else 2) * (shifted(border, dy, dx) & (shifted(labels, dy, dx) == labels))
    weights = np.zeros(50)
    weights[list(PERIMETER_WEIGHTS)] = list(PERIMETER_WEIGHTS.values())
    return np.where(border, weights[code], 0.0)


def morphology_perimeter(mask: DataFrame, side: int = TILE) -> DataFrame:
    """Perimeter of each label from its border pixels' border neighbourhoods.

    A border pixel has a 4-neighbour that is not of its label.  Tiles with a halo of two give partial sums.
    """
    halo = 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image_id, ty, tx = key
        grid, y, x, own = tile_grid(rows, ty, tx, side, halo)
        names, at = np.unique(grid[y[own], x[own]], return_inverse=True)
        return pd.DataFrame({"image_id": image_id, "label": names, "part": np.bincount(at, perimeter_weights(grid)[y[own], x[own]], len(names))})

    kind = dict(mask.dtypes)["image_id"]
    narrow = mask.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x", "label")])
    by, kinds = ["image_id"], {"label": "<i8"}
    parts = by_tile(packed(narrow, by, side, halo, kinds), by, side, kinds, run, f"image_id {kind}, label long, part double")
    return parts.groupBy("image_id", "label").agg(F.sum("part").alias("perimeter"))


def hull_pixels(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Pixels whose centre is in the convex hull of the edge midpoints of a label's pixels, by its row ends.

    All is in half pixels, so it is exact.  Inner pixels of a row cannot touch the hull; the hull's pixels are counted row by row between its crossings.
    """
    ends = np.concatenate([np.stack((2 * rows + dy, 2 * x + dx), 1) for x, side in ((left, -1), (right, 1)) for dy, dx in ((0, side), (1, 0), (-1, 0))])
    points = sorted(set(map(tuple, ends.tolist())))

    def chain(ordered: Iterator) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    first, last = int(rows.min()), int(rows.max())
    low, high = np.full(last - first + 1, np.iinfo(np.int64).max), np.full(last - first + 1, np.iinfo(np.int64).min)
    for corners in (chain(iter(points)), chain(reversed(points))):
        for (ay, ax), (by, bx) in zip(corners, corners[1:]):
            (ay, ax), (by, bx) = sorted(((ay, ax), (by, bx)))
            y = np.arange(-(-ay // 2), by // 2 + 1)
            y = y[(y >= first) & (y <= last)]
            if by == ay:
                for x in (ax, bx):
                    low[y - first], high[y - first] = np.minimum(low[y - first], -(-x // 2)), np.maximum(high[y - first], x // 2)
                continue
            crossing = ax * (by - ay) + (2 * y - ay) * (bx - ax)  # over by - ay
            low[y - first] = np.minimum(low[y - first], -(-crossing // (2 * (by - ay))))
            high[y - first] = np.maximum(high[y - first], crossing // (2 * (by - ay)))
    return int(np.maximum(high - low + 1, 0).sum())


def hulls_pixels(rows: np.ndarray, left: np.ndarray, right: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hull_pixels`` of many labels at once; ``ends`` are the places after each label's last row, a row may come more than once.

    Labels of like height are stacked, and their hulls grow together, one half pixel of height after another.
    """
    starts = np.append(0, ends[:-1])
    first = np.minimum.reduceat(rows, starts)
    height = np.maximum.reduceat(rows, starts) - first + 1
    found = np.zeros(len(ends), np.int64)
    for i in np.flatnonzero(height > HULL_ROWS):
        own = slice(starts[i], ends[i])
        found[i] = hull_pixels(rows[own], left[own], right[own])
    order = np.argsort(height, kind="stable")
    order = order[height[order] <= HULL_ROWS]
    while len(order):
        widest = 4 * int(height[order[0]]) + 16
        some = order[: HULL_VALUES // widest]
        some = some[2 * height[some] + 1 <= widest]
        order = order[len(some) :]
        n = ends[some] - starts[some]
        label = np.repeat(np.arange(len(some)), n)
        place = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(len(label))
        at, tall = 2 * (rows[place] - first[some][label]), int(height[some].max())
        sides = []
        for x, side in ((left[place], 1), (-right[place], -1)):  # the right side is the left one of the mirror image
            edge = np.full((len(some), 2 * tall + 1), NO_EDGE)
            for dy, dx in ((0, 0), (1, -1), (2, 0)):
                np.minimum.at(edge, (label, at + dy), 2 * x + dx)
            sides.append(side * _hull_side(edge))
        inside = np.arange(tall) < height[some][:, None]
        found[some] = np.where(inside, np.maximum(sides[1] - sides[0] + 1, 0), 0).sum(1)
    return found


def _hull_side(edge: np.ndarray) -> np.ndarray:
    """For each label the first column, in every pixel row, that is not left of the hull; ``edge`` has its least place, in half pixels, at every half pixel of height."""
    labels, heights = edge.shape
    every = np.arange(labels)
    y, x, size = np.zeros((labels, heights), np.int64), np.zeros((labels, heights), np.int64), np.zeros(labels, np.int64)
    for k in range(heights):
        here = np.flatnonzero(edge[:, k] < NO_EDGE)
        over = here[size[here] > 1]
        while len(over):
            a, b = size[over] - 2, size[over] - 1
            ya, xa = y[over, a], x[over, a]
            over = over[(y[over, b] - ya) * (edge[over, k] - xa) - (x[over, b] - xa) * (k - ya) <= 0]
            size[over] -= 1
            over = over[size[over] > 1]
        y[here, size[here]], x[here, size[here]] = k, edge[here, k]
        size[here] += 1
    corner = np.zeros((labels, heights), np.int64)
    for k in range(int(size.max()) - 1):
        some = every[size > k + 1]
        corner[some, y[some, k]] = k
    corner = np.maximum.accumulate(corner, 1)[:, 1::2]  # the corner before the middle of each pixel row
    middle, last = np.arange(1, heights, 2), np.minimum(corner + 1, size[:, None] - 1)
    own = every[:, None]
    ya, xa, yb, xb = y[own, corner], x[own, corner], y[own, last], x[own, last]
    high = np.maximum(yb - ya, 1)
    return -(-(xa * high + (middle - ya) * (xb - xa)) // (2 * high))


def morphology_solidity(mask: DataFrame, together: int = 64) -> DataFrame:
    """Area over the pixels of the convex hull.  Rows of a label are cut down to their ends first; those of ``together`` neighbouring labels meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label", kind="stable")
        label, y, left, right, n = (rows[c].to_numpy() for c in ("label", "y", "left", "right", "n"))
        starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        shares = [c.sum() / hull_pixels(a, b, d) for a, b, d, c in zip(*(np.split(v, starts[1:]) for v in (y, left, right, n)))]
        return pd.DataFrame({"image_id": key[0], "label": label[starts], "solidity": shares})

    kinds = dict(mask.dtypes)
    ends = mask.groupBy("image_id", "label", F.col("y").cast("long").alias("y")).agg(F.min("x").cast("long").alias("left"), F.max("x").cast("long").alias("right"), F.count("*").alias("n"))
    grouped = ends.withColumn("chunk", F.floor(F.col("label") / together)).groupBy("image_id", "chunk")
    return grouped.applyInPandas(run, f"image_id {kinds['image_id']}, label {kinds['label']}, solidity double")


#: Columns of a measurement table that have a physical size: name in pixels, name in microns, power of the pixel size.
PHYSICAL = (("cx", "Centroid X µm", 1), ("cy", "Centroid Y µm", 1), ("area", "Area µm²", 2), ("perimeter", "Perimeter µm", 1), ("diameter", "Equivalent diameter µm", 1), ("major_axis", "Major axis length µm", 1), ("minor_axis", "Minor axis length µm", 1))
#: Names of the same in pixels and of what has no size.
IN_PIXELS = {
    "cy": "Centroid Y px", "cx": "Centroid X px", "area": "Area px", "perimeter": "Perimeter px", "eccentricity": "Eccentricity", "solidity": "Solidity", "extent": "Extent",
    "diameter": "Equivalent diameter px", "major_axis": "Major axis length px", "minor_axis": "Minor axis length px",
    "y_min": "Bounding box Y min px", "x_min": "Bounding box X min px", "y_max": "Bounding box Y max px", "x_max": "Bounding box X max px",
}


#: Names of a channel's statistics in a cell table.
CELL_STATISTICS = {"mean": "Cell Mean", "sd": "Cell Std Dev", "least": "Cell Min", "most": "Cell Max"}


def physical_units(measured: DataFrame, images: DataFrame, default_um: float) -> DataFrame:
    """Adds the columns in microns, by each image's ``pixel_size_um`` or the default."""
    size = images.select("image_id", F.coalesce("pixel_size_um", F.lit(default_um)).alias("um"))
    joined = measured.join(size, "image_id")
    return joined.withColumns({name: F.col(c) * F.pow("um", F.lit(power)) for c, name, power in PHYSICAL if c in measured.columns}).drop("um")


def measure_cells(pixels: DataFrame, mask: DataFrame, images: DataFrame, channels: list[str], default_um: float) -> DataFrame:
    """One row for each cell: identifier, morphology in pixels and microns, and four statistics for each channel."""
    if len(set(channels)) < len(channels):
        raise ValueError("channel labels repeat")
    by = ["image_id", "label"]
    shape = morphology_basic(mask).join(morphology_ellipse(mask), by).join(morphology_perimeter(mask), by).join(morphology_solidity(mask), by)
    sized = physical_units(shape, images, default_um)
    wide = intensity_statistics(pixels, mask).groupBy(*by).pivot("channel", channels).agg(*[F.first(s).alias(s) for s in CELL_STATISTICS])
    return named_measurements(sized.join(wide, by, "left"), [column(f"{c}_{s}").alias(f"{c}: {name}") for c in channels for s, name in CELL_STATISTICS.items()])


def named_measurements(sized: DataFrame, intensities: list[Column]) -> DataFrame:
    """Measurements under the names of a cell table."""
    return sized.select(
        "image_id", F.col("label").alias("Cell ID"), *[name for _, name, _ in PHYSICAL[:2]], *[F.col(c).cast("double").alias(n) for c, n in IN_PIXELS.items()], *[column(n) for _, n, _ in PHYSICAL[2:]], *intensities
    )


def phenotype_counts(calls: DataFrame) -> DataFrame:
    """``source, label, n`` from rows ``(source, label)`` over all images."""
    return calls.groupBy("source", "label").agg(F.count("*").alias("n"))


def histogram(values: DataFrame, value: str, low: Column | None = None, high: Column | None = None, bins: int = BINS) -> DataFrame:
    """``image_id, bin, n`` with ``bins`` equal bins for each image, empty ones too; the last is closed, values outside are dropped.

    Without limits the range is that of the image's finite values, widened where it is flat.
    """
    good = values.select("image_id", F.col(value).alias("v")).filter(finite(F.col("v")))
    ranges = good.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    pad = F.when(close(F.col("lo"), F.col("hi")), F.greatest(0.05 * F.abs("lo"), F.lit(0.5))).otherwise(0.0)
    lo, hi = (F.col("lo") - pad, F.col("hi") + pad) if low is None else (low, high)
    ranges = ranges.select("image_id", lo.alias("lo"), hi.alias("hi"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = good.join(ranges, "image_id").filter("v >= lo and v <= hi").groupBy("image_id", place.alias("bin")).agg(F.count("*").alias("n"))
    every = ranges.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, ["image_id", "bin"], "left").select("image_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))

