"""The same statistics, compartments and matches from stored tiles: the way for whole slides.

Tiles ``(image_id, channel, level, tile_y, tile_x, y0, x0, height, width, dtype, data)`` of masks and values meet as whole blocks, by image and
tile number, so no pixel becomes a row.  Where neighbours matter, a mask tile sends strips along its sides to its eight
neighbours.  A tile gives one *state* for each of its labels; states of one label are added up, however many tiles it
covers.  Mask and value tiles must have the same side, and halos may not be wider than it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import few, in_small_batches
from lumicell.functions.values import DEFAULT_BUFFER_PX, column, finite, whole
from lumicell.operators import aggregate as agg
from lumicell.operators.mask import COMPARTMENTS, TILE, boundary_grid, near_grid
from lumicell.operators.match import RADIUS, decide, offers_of
from lumicell.operators.raster import require

AT = ["image_id", "tile_y", "tile_x"]
#: Side of the squares by which a tile's occupied places are indexed, and cells that are looked up in a tile together.
SUB, TOGETHER = 16, 1 << 16
_PART = "channel string, own boolean, y0 long, x0 long, height int, width int, dtype string, data binary"
_PART_NAMES = ["channel", "own", "y0", "x0", "height", "width", "dtype", "data"]


def array_of(tile: dict) -> np.ndarray:
    return np.frombuffer(tile["data"], tile["dtype"]).reshape(tile["height"], tile["width"])


def _mask_parts(masks: DataFrame, halo: int) -> DataFrame:
    """Mask tiles for their own place (null channel), and strips of them for the eight places around."""
    kind = dict(masks.dtypes)["image_id"]
    schema = f"image_id {kind}, tile_y long, tile_x long, {_PART}"
    if not halo:
        return masks.select(*[F.col(c).cast("long") if c != "image_id" else F.col(c) for c in AT], F.lit(None).cast("string").alias("channel"), F.lit(True).alias("own"), *[F.col(c).cast("long").alias(c) for c in ("y0", "x0")], "height", "width", "dtype", "data")

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                grid = array_of(r)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        rows_of = slice(None) if not dy else slice(0, halo) if dy < 0 else slice(-halo, None)
                        columns = slice(None) if not dx else slice(0, halo) if dx < 0 else slice(-halo, None)
                        part = grid[rows_of, columns]
                        if (dy or dx) and not part.any():
                            continue
                        y0, x0 = r["y0"] + (r["height"] - part.shape[0] if dy > 0 else 0), r["x0"] + (r["width"] - part.shape[1] if dx > 0 else 0)
                        rows.append((r["image_id"], r["tile_y"] + dy, r["tile_x"] + dx, None, not (dy or dx), y0, x0, *part.shape, r["dtype"], part.tobytes()))
            if rows:
                kinds = [batch.schema.field("image_id").type, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], names=[*AT, *_PART_NAMES])

    return masks.select(*AT, "y0", "x0", "height", "width", "dtype", "data").mapInArrow(strips, schema)


def meet(masks: DataFrame, values: DataFrame | None = None, halo: int = 0) -> DataFrame:
    """One row for each mask tile: ``image_id, tile_y, tile_x, parts``, with strips of its neighbours and the value tiles of all channels at its place."""
    in_small_batches(masks.sparkSession)
    parts = _mask_parts(masks, halo)
    if values is not None:
        placed = values.select("image_id", *[F.col(c).cast("long").alias(c) for c in AT[1:]], F.coalesce("channel", F.lit("")).alias("channel"), F.lit(True).alias("own"), *[F.col(c).cast("long").alias(c) for c in ("y0", "x0")], "height", "width", "dtype", "data")
        parts = parts.unionByName(placed)
    # nine parts and a tile for each channel at most; a place that only gets strips or values has no labels of its own
    return parts.groupBy(*AT).agg(F.collect_list(F.struct(*_PART_NAMES)).alias("parts")).filter(F.exists("parts", lambda p: p["own"] & p["channel"].isNull()))


class Place:
    """A mask tile with its halo, and the values of its channels."""

    def __init__(self, row: dict, halo: int = 0):
        parts = row["parts"]
        own = next(p for p in parts if p["own"] and p["channel"] is None)
        self.image_id, self.y0, self.x0, self.halo = row["image_id"], own["y0"], own["x0"], halo
        h, w = self.shape = own["height"], own["width"]
        self.grid = np.zeros((h + 2 * halo, w + 2 * halo), np.int64)
        for p in parts:
            if p["channel"] is None:
                y, x = p["y0"] - own["y0"] + halo, p["x0"] - own["x0"] + halo  # a tile may end before its side does
                here = self.grid[max(y, 0) : max(y + p["height"], 0), max(x, 0) : max(x + p["width"], 0)]
                here[:] = array_of(p)[max(-y, 0) :, max(-x, 0) :][: here.shape[0], : here.shape[1]]
        self.core = self.cut(self.grid)
        self.values = {p["channel"]: p for p in parts if p["channel"] is not None}

    def cut(self, grid: np.ndarray) -> np.ndarray:
        return grid[self.halo : self.halo + self.shape[0], self.halo : self.halo + self.shape[1]]

    def value(self, channel: str) -> np.ndarray:
        """A channel's values on the mask tile; not a number where it has none."""
        full = np.full(self.shape, np.nan)
        if channel in self.values:
            got = array_of(self.values[channel])[: self.shape[0], : self.shape[1]]
            full[: got.shape[0], : got.shape[1]] = got
        return full

    def inside(self, compartment: str, buffer: float) -> np.ndarray:
        if compartment == "all":
            return np.ones(self.shape, bool)
        near = self.cut(near_grid(boundary_grid(self.grid), buffer))
        return near if compartment == "cytoplasm_membrane" else ~near


def halo_for(compartment: str, buffer: float) -> int:
    if compartment not in COMPARTMENTS:
        raise ValueError(f"unknown compartment {compartment}")
    if buffer < 0:
        raise ValueError("the buffer cannot be negative")
    return 0 if compartment == "all" else int(np.ceil(buffer)) + 2


# Masks from masks


def _tiles_of(met: DataFrame, channel: str, halo: int, chosen: Callable[[Place], np.ndarray]) -> DataFrame:
    """Mask tiles in which only the chosen pixels keep their labels; tiles without any stay, so that readers find the whole image."""
    kind = dict(met.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = Place(row, halo)
                data = np.where(chosen(place), place.core, 0).astype("<u4" if place.core.max(initial=0) < 1 << 32 else "<i8")
                values = (row["image_id"], channel, 0, row["tile_y"], row["tile_x"], place.y0, place.x0, *place.shape, data.dtype.str, data.tobytes())
                kinds = [batch.schema.field("image_id").type, pa.string(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["image_id", "channel", "level", "tile_y", "tile_x", "y0", "x0", "height", "width", "dtype", "data"])

    return met.mapInArrow(run, f"image_id {kind}, channel string, level int, tile_y long, tile_x long, y0 long, x0 long, height int, width int, dtype string, data binary")


def boundary_tiles(masks: DataFrame) -> DataFrame:
    """Mask tiles of the inner boundaries: labelled pixels with a 4-neighbour of another label; beyond the image is background."""
    return _tiles_of(meet(masks, None, 1), "boundary", 1, lambda place: place.cut(boundary_grid(place.grid)))


def compartment_tiles(masks: DataFrame, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX) -> DataFrame:
    """Mask tiles of a compartment: all, what is farther than ``buffer`` from any boundary, or what is within it.

    Distances are exact and take two passes over a tile, whatever the buffer.
    """
    halo = halo_for(compartment, buffer)
    return _tiles_of(meet(masks, None, halo), compartment, halo, lambda place: place.inside(compartment, buffer))


# Statistics


def pixel_statistics(values: DataFrame, masks: DataFrame, thresholds: DataFrame, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX) -> DataFrame:
    """``image_id, label, whole_pixels, denominator_pixels, positive_pixels, finite_pixels, intensity_sum`` of one channel; see ``pixel_statistics_by_label``."""
    halo = halo_for(compartment, buffer)
    kind = dict(masks.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = Place(row, halo)
                keep = place.core > 0
                value = place.value(next(iter(place.values), ""))
                found = agg.label_counts(place.core[keep], value[keep], place.inside(compartment, buffer)[keep], row["threshold"])
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(found[0]), batch.schema.field("image_id").type), *map(pa.array, found)], names=["image_id", "label", "whole", "denominator", "positive", "finite", "total"])

    return agg.added(agg.with_threshold(meet(masks, values, halo), thresholds).mapInArrow(run, f"image_id {kind}, {agg.PARTS}"))


_SHAPE = {
    "label": pa.int64(), "y0": pa.int64(), "x0": pa.int64(), "n": pa.int64(), "sy": pa.int64(), "sx": pa.int64(), "syy": pa.int64(), "sxx": pa.int64(), "sxy": pa.int64(),
    "y_min": pa.int64(), "x_min": pa.int64(), "y_max": pa.int64(), "x_max": pa.int64(), "perimeter": pa.float64(),
}
_LONG_LIST = pa.list_(pa.int64())
_STATS = pa.list_(pa.struct([("channel", pa.string()), ("n", pa.int64()), ("total", pa.float64()), ("m2", pa.float64()), ("least", pa.float64()), ("most", pa.float64())]))
_STATES = (
    ", ".join(f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in _SHAPE.items())
    + ", rows array<bigint>, left array<bigint>, right array<bigint>, stats array<struct<channel: string, n: bigint, total: double, m2: double, least: double, most: double>>"
)


def _lists(starts: np.ndarray, total: int, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), pa.array(v)) for v in values]


def place_states(place: Place, channels: list[str], shape: bool) -> list[pa.Array]:
    """The columns of ``_STATES`` for one tile.

    Moments are of coordinates in the tile; ``rows``, ``left`` and ``right`` are the label's rows with their first and last column.  Of each channel: number,
    sum and squared deviations of finite values, the least and the most.
    """
    y, x = np.nonzero(place.core > 0)
    label = place.core[y, x]
    order = np.argsort(label, kind="stable")  # by label, then row by row
    y, x, label = y[order].astype(np.int64), x[order].astype(np.int64), label[order]
    first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    n = np.diff(np.append(first, len(label)))
    add = lambda v: np.add.reduceat(v, first)
    weights = place.cut(agg.perimeter_weights(place.grid))[y, x] if shape else np.zeros(len(y))
    start = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (y[1:] != y[:-1]))))  # rows of labels
    last = np.append(start[1:], len(y)) - 1
    columns = [
        label[first], np.full(len(first), place.y0), np.full(len(first), place.x0), n, add(y), add(x), add(y * y), add(x * x), add(y * x),
        place.y0 + y[first], place.x0 + np.minimum.reduceat(x, first), place.y0 + np.maximum.reduceat(y, first), place.x0 + np.maximum.reduceat(x, first), add(weights),
    ]
    extremes = _lists(np.searchsorted(start, first) if shape else np.zeros(len(first), int), len(start) if shape else 0, *((place.y0 + y[start], place.x0 + x[start], place.x0 + x[last]) if shape else [np.empty(0, np.int64)] * 3))
    each = []
    for channel in channels:
        value = place.value(channel)[y, x]
        good = np.isfinite(value)
        value0 = np.where(good, value, 0.0)
        count, total = add(good.astype(np.int64)), add(value0)
        mean = total / np.maximum(count, 1)
        off = np.where(good, value0 - np.repeat(mean, n), 0.0)
        each.append((count, total, add(off * off), np.minimum.reduceat(np.where(good, value, np.inf), first), np.maximum.reduceat(np.where(good, value, -np.inf), first)))
    names = np.tile(np.array(channels, object), len(first))
    stats = pa.StructArray.from_arrays([pa.array(names, pa.string()), *(pa.array(np.stack(v, 1).ravel() if each else np.empty(0)) for v in (zip(*each) if each else [np.empty(0)] * 5))], fields=list(_STATS.value_type)) if each else pa.array([], _STATS.value_type)
    return [*(pa.array(c, t) for c, t in zip(columns, _SHAPE.values())), *extremes, pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(channels)), stats)]


def label_states(masks: DataFrame, values: DataFrame | None = None, channels: list[str] | None = None, shape: bool = True) -> DataFrame:
    """One state for each label of each tile, of all channels together: moments, extremes, perimeter, row ends and intensities; one pass over all blocks.

    ``channels`` gives the order of ``stats``; without it they are the channels that a place has.
    """
    halo = 2 if shape else 0
    kind = dict(masks.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = Place(row, halo)
                if (place.core > 0).any():
                    found = place_states(place, sorted(place.values) if channels is None else channels, shape)
                    yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(found[0]), batch.schema.field("image_id").type), *found], names=["image_id", *_SHAPE, "rows", "left", "right", "stats"])

    return meet(masks, values, halo).mapInArrow(run, f"image_id {kind}, {_STATES}")


def _sums(stat: Column, name: str) -> list[Column]:
    """Sums over the states of one label and channel: number and total, least and most of finite values."""
    some = stat["n"] > 0
    return [F.sum(stat["n"]).alias(f"{name}_n"), F.sum(stat["total"]).alias(f"{name}_total"), F.min(F.when(some, stat["least"])).alias(f"{name}_least"), F.max(F.when(some, stat["most"])).alias(f"{name}_most")]


def _with_moments(summed: DataFrame, name: str, state: Callable[[Column], Column]) -> DataFrame:
    """Adds mean and population deviation, null without finite values; ``state`` picks the channel's state from an item of ``states``.

    Deviations of parts are joined about the common mean, so nothing cancels.  A label has a state for each tile it touches.
    """
    n, total = F.col(f"{name}_n"), F.col(f"{name}_total")
    found = summed.withColumn(f"{name}_mean", total / F.nullif(n, F.lit(0)))
    off = lambda s: s["total"] / s["n"] - F.col(f"{name}_mean")
    squares = F.aggregate("states", F.lit(0.0), lambda done, s: done + F.when(state(s)["n"] > 0, state(s)["m2"] + state(s)["n"] * off(state(s)) * off(state(s))).otherwise(0.0))
    return found.withColumn(f"{name}_sd", F.when(n > 0, F.sqrt(squares / n)))


def intensity_statistics(values: DataFrame, masks: DataFrame) -> DataFrame:
    """Per image, label and channel the finite mean, population deviation, least and most; null without finite pixels."""
    states = label_states(masks, values, shape=False).select("image_id", "label", F.explode("stats").alias("s"))
    summed = states.groupBy("image_id", "label", F.col("s.channel").alias("channel")).agg(*_sums(F.col("s"), "s"), F.collect_list("s").alias("states"))
    found = _with_moments(summed, "s", lambda s: s)
    return found.select("image_id", "label", "channel", *[F.col(f"s_{c}").alias(c) for c in agg.CELL_STATISTICS])


def _shape_sums() -> list[Column]:
    whole_number = lambda c: c.cast("decimal(38,0)")  # noqa: E731  # sums of squares of whole-slide coordinates go beyond longs
    y0, x0, n = F.col("y0"), F.col("x0"), F.col("n")
    total = lambda a, b, sa, sb, sab: F.sum(whole_number(F.col(sab)) + whole_number(a) * F.col(sb) + whole_number(b) * F.col(sa) + whole_number(a * b) * n)
    return [
        F.sum(n).alias("area"), F.sum(F.col("sy") + n * y0).alias("sy"), F.sum(F.col("sx") + n * x0).alias("sx"),
        total(y0, y0, "sy", "sy", "syy").alias("syy"), total(x0, x0, "sx", "sx", "sxx").alias("sxx"), total(y0, x0, "sy", "sx", "sxy").alias("sxy"),
        F.min("y_min").alias("y_min"), F.min("x_min").alias("x_min"), (F.max("y_max") + 1).alias("y_max"), (F.max("x_max") + 1).alias("x_max"),
        F.sum("perimeter").alias("perimeter"), F.collect_list(F.struct("rows", "left", "right")).alias("ends"),
    ]


def _shapes(summed: DataFrame) -> DataFrame:
    """Centroid, extent, diameter, axes and eccentricity from exact sums; further columns stay."""
    n = F.col("area").cast("decimal(38,0)")
    spread = lambda ab, a, b: (n * F.col(ab) - F.col(a).cast("decimal(38,0)") * F.col(b)).cast("double") / (F.col("area").cast("double") * F.col("area"))
    found = summed.withColumns({"cy": F.col("sy") / F.col("area"), "cx": F.col("sx") / F.col("area"), "yy": spread("syy", "sy", "sy"), "xx": spread("sxx", "sx", "sx"), "xy": spread("sxy", "sy", "sx")})
    return agg.with_ellipse(agg.with_extent(found)).drop("sy", "sx", "syy", "sxx", "sxy", "yy", "xx", "xy")


def _with_solidity(shapes: DataFrame) -> DataFrame:
    """Area over the pixels of the convex hull, from the row ends of all tiles of a label."""
    names = [c for c in shapes.columns if c != "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            states = batch.column(batch.schema.names.index("ends"))  # of a label one for each tile
            lists = states.flatten().flatten()
            ends = np.cumsum(lists[0].value_lengths().to_numpy())[np.cumsum(states.value_lengths().to_numpy()) - 1]
            hulls = agg.hulls_pixels(*(c.flatten().to_numpy() for c in lists), ends)
            solidity = batch.column(batch.schema.names.index("area")).to_numpy() / hulls
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(solidity)], names=[*names, "solidity"])

    return shapes.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in shapes.dtypes if n != "ends") + ", solidity double")


def centroids(masks: DataFrame) -> DataFrame:
    """``image_id, label, cy, cx``"""
    sums = label_states(masks, shape=False).groupBy("image_id", "label").agg(F.sum("n").alias("n"), F.sum(F.col("sy") + F.col("n") * F.col("y0")).alias("sy"), F.sum(F.col("sx") + F.col("n") * F.col("x0")).alias("sx"))
    return sums.select("image_id", "label", (F.col("sy") / F.col("n")).alias("cy"), (F.col("sx") / F.col("n")).alias("cx"))


def morphology(masks: DataFrame) -> DataFrame:
    """All shape measurements of each label from one pass over mask tiles."""
    return _with_solidity(_shapes(label_states(masks).groupBy("image_id", "label").agg(*_shape_sums())))


def measure_cells(values: DataFrame, masks: DataFrame, images: DataFrame, channels: list[str], default_um: float) -> DataFrame:
    """One row for each cell: identifier, morphology in pixels and microns, and four statistics for each channel, from one pass and one sum of states."""
    if len(set(channels)) < len(channels):
        raise ValueError("channel labels repeat")
    states = label_states(masks, values.filter(F.col("channel").isin(channels)), channels)
    sums = [c for i in range(len(channels)) for c in _sums(F.col("stats")[i], f"s{i}")]
    shapes = _shapes(states.groupBy("image_id", "label").agg(*_shape_sums(), *sums, F.collect_list("stats").alias("states")))
    for i in range(len(channels)):
        shapes = _with_moments(shapes, f"s{i}", lambda s, i=i: s[i])
    shapes = _with_solidity(shapes.drop("states"))
    sized = agg.physical_units(shapes, images, default_um)
    return agg.named_measurements(sized, [column(f"s{i}_{s}").alias(f"{c}: {title}") for i, c in enumerate(channels) for s, title in agg.CELL_STATISTICS.items()])


# Matching


def tile_labels(masks: DataFrame) -> DataFrame:
    """``image_id, known``: the labels of each image."""
    in_small_batches(masks.sparkSession)
    kind = dict(masks.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = np.unique(array_of(row))
                names = names[names > 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(names), batch.schema.field("image_id").type), pa.array(names)], names=["image_id", "known"])

    return masks.select("image_id", "height", "width", "dtype", "data").mapInArrow(run, f"image_id {kind}, known long").distinct()


def _at_tiles(points: DataFrame, masks: DataFrame, run: Callable[[dict, np.ndarray, list[dict]], tuple[np.ndarray, ...]], names: dict[str, str]) -> DataFrame:
    """``run(tile, labels, points)`` for each tile and up to about ``TOGETHER`` of the points ``(image_id, tile_y, tile_x, …)`` that look into it."""
    in_small_batches(masks.sparkSession)
    kind = dict(points.dtypes)["image_id"]
    counts = few(points.groupBy(*AT).agg(F.ceil(F.count("*") / TOGETHER).alias("groups")))  # one row for each tile
    rest = [c for c in points.columns if c not in AT]
    grouped = points.join(counts, AT).withColumn("group", F.pmod(F.xxhash64("row_index"), "groups")).groupBy(*AT, "group").agg(F.collect_list(F.struct(*rest)).alias("points"))
    met = grouped.join(masks.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("tile_y", "tile_x", "y0", "x0")], "height", "width", "dtype", "data"), AT)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = run(row, array_of(row), row["points"])
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(found[0]), batch.schema.field("image_id").type), *(pa.array(f, {"long": pa.int64(), "double": pa.float64()}[t]) for f, t in zip(found, names.values()))], names=["image_id", *names])

    return met.mapInArrow(each, f"image_id {kind}, " + ", ".join(f"{n} {t}" for n, t in names.items()))


def _located(cells: DataFrame) -> DataFrame:
    """Rows with a finite centroid: ``image_id, row_index, py, px``, and rounded ``ry, rx``."""
    return cells.filter(finite(F.col("x")) & finite(F.col("y"))).select("image_id", "row_index", F.col("y").cast("double").alias("py"), F.col("x").cast("double").alias("px"), whole(F.col("y")).alias("ry"), whole(F.col("x")).alias("rx"))


def match_by_centroid(cells: DataFrame, masks: DataFrame, side: int = TILE) -> DataFrame:
    """``image_id, row_index, by_centroid``: the label under the rounded centroid."""
    points = _located(cells).select("image_id", F.floor(F.col("ry") / side).alias("tile_y"), F.floor(F.col("rx") / side).alias("tile_x"), "row_index", "ry", "rx")

    def run(tile: dict, labels: np.ndarray, rows: list[dict]) -> tuple[np.ndarray, ...]:
        index, y, x = (np.array([r[c] for r in rows]) for c in ("row_index", "ry", "rx"))
        y, x = y - tile["y0"], x - tile["x0"]
        inside = (y < labels.shape[0]) & (x < labels.shape[1])
        under = labels[y[inside], x[inside]].astype(np.int64)
        return index[inside][under > 0], under[under > 0]

    return _at_tiles(points, masks, run, {"row_index": "long", "by_centroid": "long"})


def nearest_in_tile(labels: np.ndarray, y0: int, x0: int, rows: list[dict], radius: int) -> list[tuple]:
    """``(row_index, d2, y, x, label)`` of the labelled pixel of a tile nearest to each row, the first in row-major order of equals, in its square window.

    Squares of ``SUB`` pixels that hold labels are an index: they are searched from the nearest on, until the next cannot be nearer.
    """
    h, w = labels.shape
    padded = np.zeros((-(-h // SUB) * SUB, -(-w // SUB) * SUB), bool)
    padded[:h, :w] = labels > 0
    by, bx = np.nonzero(padded.reshape(padded.shape[0] // SUB, SUB, -1, SUB).any((1, 3)))
    top, low = y0 + by * SUB, x0 + bx * SUB
    bottom, high = np.minimum(top + SUB, y0 + h) - 1, np.minimum(low + SUB, x0 + w) - 1
    out = []
    for r in rows:
        py, px = r["py"], r["px"]
        ya, yb, xa, xb = r["ry"] - radius, r["ry"] + radius, r["rx"] - radius, r["rx"] + radius
        dy, dx = np.maximum(np.maximum(top - py, py - bottom), 0), np.maximum(np.maximum(low - px, px - high), 0)
        bound = np.where((bottom >= ya) & (top <= yb) & (high >= xa) & (low <= xb), dx * dx + dy * dy, np.inf)
        best: tuple | None = None
        for b in np.argsort(bound, kind="stable").tolist():
            if bound[b] == np.inf or (best and bound[b] > best[0]):
                break
            a, c = max(int(top[b]), ya), max(int(low[b]), xa)
            part = labels[a - y0 : min(int(bottom[b]), yb) + 1 - y0, c - x0 : min(int(high[b]), xb) + 1 - x0]
            y, x = np.nonzero(part)
            if len(y):
                d2 = (x + c - px) * (x + c - px) + (y + a - py) * (y + a - py)
                i = int(np.argmin(d2))  # row-major, so the first of equals
                got = (float(d2[i]), int(y[i]) + a, int(x[i]) + c, int(part[y[i], x[i]]))
                best = min(best, got) if best else got
        if best:
            out.append((r["row_index"], *best))
    return out


def match_nearest_label(cells: DataFrame, masks: DataFrame, radius: int = RADIUS, side: int = TILE) -> DataFrame:
    """``image_id, row_index, by_nearest``: the nearest labelled pixel in the square window about the rounded centroid.

    Distances are from the unrounded centroid; the first pixel in row-major order wins ties.  A row looks into the tiles that its window meets.
    """
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    points = _located(cells).withColumn("tile_y", around("ry")).withColumn("tile_x", around("rx")).select(*AT, "row_index", "py", "px", "ry", "rx")

    def run(tile: dict, labels: np.ndarray, rows: list[dict]) -> tuple[np.ndarray, ...]:
        found = nearest_in_tile(labels, tile["y0"], tile["x0"], rows, radius)
        return tuple(zip(*found)) if found else ([],) * 5

    found = _at_tiles(points, masks, run, {"row_index": "long", "d2": "double", "y": "long", "x": "long", "label": "long"})
    return found.groupBy("image_id", "row_index").agg(F.min(F.struct("d2", "y", "x", "label"))["label"].alias("by_nearest"))


def map_cells_to_labels(cells: DataFrame, masks: DataFrame, radius: int = RADIUS, strict: bool = True, side: int = TILE) -> DataFrame:
    """``image_id, row_index, mask_label, matched_by``: by identifier, then centroid, then sequence, then nearest label; see ``match.map_cells_to_labels``."""
    by = ["image_id", "row_index"]
    under = match_by_centroid(cells, masks, side).withColumnRenamed("by_centroid", "under")
    located = cells.join(under, by, "left")
    return decide(located, offers_of(cells.columns), tile_labels(masks), lambda rows: match_nearest_label(rows, masks, radius, side), strict)


def phenotype_by_threshold(cells: DataFrame, masks: DataFrame, values: DataFrame, thresholds: DataFrame, cutoff: float, compartment: str = "all", buffer: float = DEFAULT_BUFFER_PX, channels: DataFrame | None = None, channel: str | None = None, side: int = TILE) -> DataFrame:
    """Calls for the cells of all images; see ``aggregate.phenotype_by_threshold``."""
    if channels is not None:
        own = channels.filter(F.col("name") == channel).select("image_id").distinct()
        require(cells.select("image_id").distinct().join(own, "image_id", "left_anti"), f"an image has no channel {channel}")
    statistics = pixel_statistics(values, masks, thresholds, compartment, buffer)
    return agg.threshold_calls(agg.cell_statistics(statistics, map_cells_to_labels(cells, masks, side=side)), cutoff)
