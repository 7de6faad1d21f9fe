"""Windows, overviews, contrast and fields of view on pixel rows ``(image_id, channel, y, x, value)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicell.functions.rank import checkpointed, few
from lumicell.functions.values import finite, when_finite, whole
from lumicell.operators.gather import by_tile, packed

#: Side of the square bins that turn window joins into equi joins.
BIN = 256
#: Parts into which a range of values is cut to find a percentile.
PARTS = 4096
FOV_SIZE, FOV_ATTEMPTS, FOV_LEAST_FRACTION, OVERVIEW_SIZE = 512, 200, 0.01, 768
#: Scale of red, green and blue for each display colour.
COLOURS = {
    "Gray": (1.0, 1.0, 1.0), "Red": (1.0, 0.0, 0.0), "Green": (0.0, 1.0, 0.0), "Blue": (0.0, 0.0, 1.0),
    "Cyan": (0.0, 1.0, 1.0), "Magenta": (1.0, 0.0, 1.0), "Yellow": (1.0, 1.0, 0.0),
}


def require(violations: DataFrame, message: str) -> None:
    """Raise with the first violating row if there is one."""
    if found := violations.limit(1).collect():
        raise ValueError(f"{message}: {found[0].asDict()}")


def bins(low: Column, size: Column, side: int = BIN) -> Column:
    """Numbers of the bins that ``[low, low + size)`` meets."""
    return F.sequence(F.floor(low / side), F.floor((low + size - 1) / side))


def check_windows(windows: DataFrame, images: DataFrame) -> None:
    """Windows must be inside their image and not empty."""
    joined = windows.join(images.select("image_id", F.col("height").alias("image_height"), F.col("width").alias("image_width")), "image_id", "left")
    bad = (
        F.col("image_height").isNull() | (F.col("y0") < 0) | (F.col("x0") < 0) | (F.col("height") <= 0) | (F.col("width") <= 0)
        | (F.col("y0") + F.col("height") > F.col("image_height")) | (F.col("x0") + F.col("width") > F.col("image_width"))
    )
    require(joined.filter(bad), "a window is empty or outside its image")


def read_region(pixels: DataFrame, windows: DataFrame, side: int = BIN) -> DataFrame:
    """Pixels of each window ``(image_id, region_id, y0, x0, height, width)``, half open, with local coordinates.

    Windows are spread over the bins they meet, so that the join is by equality of image and bin.
    """
    spread = (
        windows.withColumn("bin_y", F.explode(bins(F.col("y0"), F.col("height"), side)))
        .withColumn("bin_x", F.explode(bins(F.col("x0"), F.col("width"), side)))
    )
    binned = pixels.withColumn("bin_y", F.floor(F.col("y") / side)).withColumn("bin_x", F.floor(F.col("x") / side))
    inside = "y >= y0 and y < y0 + height and x >= x0 and x < x0 + width"
    return binned.join(spread, ["image_id", "bin_y", "bin_x"]).filter(inside).drop("bin_y", "bin_x").withColumn("fy", F.expr("y - y0")).withColumn("fx", F.expr("x - x0"))


def overview_level(levels: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """For each image the smallest level whose longer side is ``max_size`` or more, else the largest; the first wins ties."""
    longer = F.greatest("height", "width")
    enough = longer >= max_size
    best = F.when(enough, longer).otherwise(-longer)
    chosen = F.min(F.struct((~enough).alias("short"), best.alias("size"), "level", "height", "width")).alias("c")
    return levels.groupBy("image_id").agg(chosen).select("image_id", "c.level", "c.height", "c.width")


def _picked(extent: str, scale: Column) -> Column:
    """Indices of an overview along one side, with their place: ``trunc(linspace(0, extent - 1, out))``."""
    out = F.greatest(whole(F.col(extent) / scale), F.lit(1).cast("long"))
    step = F.when(out > 1, (F.col(extent) - 1) / (out - 1)).otherwise(F.lit(0.0))
    last = F.when(out > 1, F.col(extent) - 1).otherwise(F.lit(0)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), out - 1), lambda i: F.struct(i.alias("to"), F.when(i == out - 1, last).otherwise(F.floor(i * step)).alias("at")))


def overview_resample(pixels: DataFrame, images: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """``image_id, channel, oy, ox, value`` of an overview whose longer side is at most ``max_size``, by picking rows and columns."""
    scale = F.greatest(F.col("height") / max_size, F.col("width") / max_size, F.lit(1.0))
    rows = images.select("image_id", F.explode(_picked("height", scale)).alias("p")).select("image_id", F.col("p.at").alias("y"), F.col("p.to").alias("oy"))
    columns = images.select("image_id", F.explode(_picked("width", scale)).alias("p")).select("image_id", F.col("p.at").alias("x"), F.col("p.to").alias("ox"))
    return pixels.join(rows, ["image_id", "y"]).join(columns, ["image_id", "x"]).select("image_id", "channel", "oy", "ox", "value")


def is_dapi(name: Column) -> Column:
    return F.contains(F.lower(F.trim(name)), F.lit("dapi"))


def dapi_channel(channels: DataFrame) -> DataFrame:
    """``image_id, dapi_index``: the first channel named as DAPI, null if none is."""
    return channels.groupBy("image_id").agg(F.min(F.when(is_dapi(F.col("name")), F.col("channel_index"))).alias("dapi_index"))


def membrane_markers(channels: DataFrame) -> DataFrame:
    return channels.filter(~is_dapi(F.col("name")))


def _part(value: Column, low: Column, high: Column, curved: bool) -> Column:
    """The place of a value among ``PARTS`` parts of its range, never falling as the value rises; the ends of a range are always in different parts.

    Parts are equal, or equal in a signed logarithm, which tells values of very different size apart.
    """
    log = lambda v: F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 800))  # noqa: E731  # the smallest double's logarithm is above -745
    half = lambda v: v / 2  # noqa: E731  # the width of a range of doubles may be no double
    equal = F.when(half(high) - half(low) > 0, (half(value) - half(low)) / (half(high) - half(low))).otherwise(F.when(value > low, 1.0).otherwise(0.0))
    share = F.when(log(high) > log(low), (log(value) - log(low)) / (log(high) - log(low))).otherwise(equal) if curved else equal
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def placed_values(values: DataFrame, places: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """``by, place, found``: the values at wanted places (from 0) of each group's order, exactly, for all groups at once.

    ``places(by, place, low, high)`` has each group's least and largest value.  Ranges of values that hold a wanted place are cut into ``PARTS`` parts, whose
    values are counted in all tasks, and the part with the place is the next range, from its least to its largest value, until that is one value.  So a task
    never holds more than a group's parts, whatever its values; a round passes over the values once, and ranges shrink at least twelve-bit-wise.
    """
    range_of = [*by, "low", "high"]
    wanted, rounds = checkpointed(places.withColumn("rank", F.col("place"))), 0
    while not (left := wanted.filter("low < high")).isEmpty():
        ranges = few(left.select(*range_of).distinct().groupBy(*by).agg(F.collect_list(F.struct("low", "high")).alias("ranges")))  # a range for each place at most
        inside = values.join(ranges, by).select(*by, value, F.explode(F.filter("ranges", lambda r: (F.col(value) >= r["low"]) & (F.col(value) <= r["high"]))).alias("r")).select(*by, value, "r.low", "r.high")
        part = _part(F.col(value), F.col("low"), F.col("high"), rounds % 2 == 1)
        parts = inside.groupBy(*range_of, part.alias("part")).agg(F.count("*").alias("n"), F.min(value).alias("part_low"), F.max(value).alias("part_high"))
        through = F.sum("n").over(Window.partitionBy(*range_of).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # PARTS rows at most
        within = left.join(parts.withColumn("before", through - F.col("n")), range_of).filter("rank >= before and rank < before + n")
        found = within.select(*by, "place", F.col("part_low").alias("low"), F.col("part_high").alias("high"), (F.col("rank") - F.col("before")).alias("rank"))
        wanted, rounds = checkpointed(wanted.filter("low = high").unionByName(found)), rounds + 1
    return wanted.select(*by, "place", F.col("low").alias("found"))


def percentiles(pixels: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``p`` (exact percentiles of finite values, null without any), ``least`` and ``most`` per group; between two values they are interpolated."""
    value = when_finite(F.col("value").cast("double"))
    totals = checkpointed(pixels.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")))
    at = [share * (F.col("n") - 1) for share in shares]
    ends = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    places = totals.filter("n > 0").select(*by, F.explode(ends).alias("place"), F.col("least").alias("low"), F.col("most").alias("high"))
    found = placed_values(pixels.select(*by, value.alias("v")).filter("v is not null"), places, by)
    known = totals.join(found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "found"))).alias("known")), by, "left")
    lower, upper = (lambda a: F.col("known")[F.floor(a).cast("long")]), (lambda a: F.col("known")[F.ceil(a).cast("long")])
    between = [F.when(lower(a) == upper(a), lower(a)).otherwise((F.ceil(a) - a) * lower(a) + (a - F.floor(a)) * upper(a)) for a in at]
    return known.select(*by, F.array(*[F.when(F.col("n") > 0, b) for b in between]).alias("p"), "least", "most")


def contrast_limits(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``low, high`` per group: 1st and 99th percentile of finite values, else their range, else one apart; (0, 1) without any."""
    found = percentiles(pixels, by, (0.01, 0.99))
    low, high = F.col("p")[0], F.col("p")[1]
    flat = high <= low
    low, high = F.when(flat, F.col("least")).otherwise(low), F.when(flat, F.col("most")).otherwise(high)
    return found.select(*by, F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(F.when(high <= low, low + 1).otherwise(high), F.lit(1.0)).alias("high"))


def unit_scaled(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the limits; NaN and -inf count as low, +inf as high."""
    known = F.when(F.isnan(value) | (value == F.lit(float("-inf"))), low).when(value == F.lit(float("inf")), high).otherwise(value)
    return F.least(F.greatest((known - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def normalize_uint8(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels with ``grey``, 0 to 255, between the contrast limits of their group; what is within 1e-9 of a half counts as one."""
    limits = contrast_limits(pixels, by)
    grey = whole(F.round(unit_scaled(F.col("value"), F.col("low"), F.col("high")) * 255, 9))
    return pixels.join(limits, by).withColumn("grey", grey).drop("low", "high")


def normalize_channel(pixels: DataFrame, images: DataFrame, sample_pixels: int = 1_000_000) -> DataFrame:
    """Pixels with ``unit``, 0 to 1 between the 1st and 99th percentile of every n-th row and column; 0 where that is flat."""
    stride = few(images.select("image_id", F.ceil(F.sqrt(F.col("height") * F.col("width") / sample_pixels)).alias("stride")))  # one row for each image
    sampled = pixels.join(stride, "image_id").filter("y % stride = 0 and x % stride = 0")
    limits = percentiles(sampled, ["image_id", "channel"], (0.01, 0.99))
    limits = few(limits.select("image_id", "channel", F.col("p")[0].alias("low"), F.col("p")[1].alias("high")))  # one for each channel of an image
    unit = F.when(F.col("high") > F.col("low"), unit_scaled(F.col("value"), F.col("low"), F.col("high"))).otherwise(0.0)
    return pixels.join(limits, ["image_id", "channel"], "left").withColumn("unit", unit).drop("low", "high")


def segmentation_input(pixels: DataFrame, images: DataFrame, markers: list[str], dapi: str | None = None) -> DataFrame:
    """``image_id, y, x, ch0, ch1, ch2``: mean of the chosen normalised markers, the nuclear channel, and zero, each 0 to 255."""
    markers = list(dict.fromkeys(markers))
    if not markers:
        raise ValueError("no marker selected")
    if any("dapi" in m.strip().lower() for m in markers):
        raise ValueError("the nuclear channel cannot be a marker")
    wanted = [*markers, *([dapi] if dapi else [])]
    have = {r["channel"] for r in pixels.select("channel").distinct().filter(F.col("channel").isin(wanted)).collect()}
    if missing := [m for m in wanted if m not in have]:
        raise ValueError(f"channels missing: {missing}")
    unit = normalize_channel(pixels.filter(F.col("channel").isin(wanted)), images)
    role = F.col("channel").isin(markers).cast("tinyint") + (F.when(F.col("channel") == dapi, 2).otherwise(0) if dapi else F.lit(0))
    types, kinds = dict(unit.dtypes), {"unit": "<f8", "role": "i1"}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image_id, ty, tx = key
        value, role = rows["unit"].to_numpy(), rows["role"].to_numpy()
        place, at = np.unique((rows["y"].to_numpy() - ty * BIN) * BIN + rows["x"].to_numpy() - tx * BIN, return_inverse=True)
        chosen, nuclear = role & 1 > 0, np.zeros(len(place))
        mean = np.bincount(at[chosen], value[chosen], len(place)) / len(markers)
        none = np.bincount(at[chosen], minlength=len(place)) == 0
        np.maximum.at(nuclear, at[role & 2 > 0], value[role & 2 > 0])
        ch0 = pd.arrays.IntegerArray((mean * 255).astype(np.int32), none)
        return pd.DataFrame({"image_id": image_id, "y": ty * BIN + place // BIN, "x": tx * BIN + place % BIN, "ch0": ch0, "ch1": (nuclear * 255).astype(np.int32), "ch2": np.int32(0)})

    schema = f"image_id {types['image_id']}, y {types['y']}, x {types['x']}, ch0 int, ch1 int, ch2 int"
    narrow = unit.select("image_id", "y", "x", "unit", role.cast("tinyint").alias("role"))
    return by_tile(packed(narrow, ["image_id"], BIN, 0, kinds), ["image_id"], BIN, kinds, run, schema)


def rgb_overview(marker: DataFrame, dapi: DataFrame, images: DataFrame, colour: str = "Green", max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """``image_id, oy, ox, red, green, blue``: the marker in its colour, the nuclear channel over blue."""
    grey = normalize_uint8(overview_resample(marker.unionByName(dapi), images, max_size), ["image_id", "channel"])
    is_marker = F.col("channel") == F.lit(marker.select("channel").first()["channel"])
    both = grey.groupBy("image_id", "oy", "ox").agg(F.max(F.when(is_marker, F.col("grey"))).alias("m"), F.max(F.when(~is_marker, F.col("grey"))).alias("d"))
    red, green, blue = (F.floor(F.col("m") * s) for s in COLOURS[colour])
    return both.select("image_id", "oy", "ox", red.alias("red"), green.alias("green"), F.greatest(blue, F.coalesce("d", F.lit(0))).alias("blue"))


def intensity_threshold(pixels: DataFrame, by: list[str], slider: float, slider_max: float = 1000) -> DataFrame:
    """``threshold`` per group: the slider's place between the 1st and 99th percentile of finite values; a group without any is an error."""
    if slider_max <= 0:
        raise ValueError("the slider's maximum must be positive")
    place = min(max(float(slider) / slider_max, 0.0), 1.0)
    found = percentiles(pixels, by, (0.01, 0.99))
    none = F.raise_error(F.concat(F.lit("no finite pixel to take a threshold from: "), F.concat_ws(" ", *[F.col(b).cast("string") for b in by]))).cast("double")
    return found.select(*by, F.when(F.col("least").isNull(), none).otherwise(F.col("p")[0] + place * (F.col("p")[1] - F.col("p")[0])).alias("threshold"))


def threshold_highlight(pixels: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Pixels above the threshold of their group; NaN is not."""
    return pixels.join(thresholds, by).filter((F.col("value") > F.col("threshold")) & ~F.isnan("value"))


def dapi_threshold(dapi: DataFrame, images: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """``image_id, threshold``: a fifth of the way from the 20th to the 99.5th percentile of the overview."""
    return nuclear_threshold(percentiles(overview_resample(dapi, images, max_size), ["image_id"], (0.2, 0.995)))


def nuclear_threshold(found: DataFrame) -> DataFrame:
    """``image_id, threshold`` from the two percentiles and the range of an overview; a flat one is an error."""
    low = F.col("p")[0]
    high = F.when(F.col("p")[1] <= low, F.col("most")).otherwise(F.col("p")[1])
    flat = low.isNull() | (high <= low)
    return found.select("image_id", F.when(flat, F.raise_error(F.lit("the nuclear channel is flat"))).otherwise(low + 0.2 * (high - low)).alias("threshold"))


def dapi_positive_fraction(regions: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """``fraction`` of finite pixels above the image's threshold, 0 without any, for pixels grouped by ``by``."""
    joined = regions.join(thresholds, "image_id")
    good = finite(F.col("value"))
    fraction = F.count_if(good & (F.col("value") > F.col("threshold"))) / F.nullif(F.count_if(good), F.lit(0))
    return joined.groupBy(*by).agg(F.coalesce(fraction, F.lit(0.0)).alias("fraction"))


def fov_candidates(images: DataFrame, size: int, seed: int | None, attempts: int = FOV_ATTEMPTS) -> DataFrame:
    """``image_id, attempt, y0, x0, height, width``: the draws of one seeded generator for each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, height, width in zip(*(c.to_pylist() for c in batch.columns)):
                if size > height or size > width:
                    raise ValueError(f"a field of view of {size} does not fit image {image_id}")
                random = np.random.default_rng(seed)
                drawn = [(int(random.integers(0, height - size + 1)), int(random.integers(0, width - size + 1))) for _ in range(attempts)]
                y0, x0 = ([d[k] for d in drawn] for k in (0, 1))
                same = lambda v, kind: pa.array([v] * attempts, kind)
                yield pa.RecordBatch.from_arrays(
                    [same(image_id, pa.int64()), pa.array(range(attempts), pa.int32()), pa.array(y0, pa.int64()), pa.array(x0, pa.int64()), same(size, pa.int64()), same(size, pa.int64())],
                    names=["image_id", "attempt", "y0", "x0", "height", "width"],
                )

    sizes = images.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "height", "width")])
    return sizes.mapInArrow(run, "image_id long, attempt int, y0 long, x0 long, height long, width long")


def random_fov(dapi: DataFrame, images: DataFrame, size: int = FOV_SIZE, seed: int | None = 42, least: float = FOV_LEAST_FRACTION, attempts: int = FOV_ATTEMPTS, bin_side: int = BIN) -> DataFrame:
    """``image_id, attempt, y0, x0, fraction``: the first draw with enough nuclear pixels."""
    return first_good_fov(dapi, fov_candidates(images, size, seed, attempts), dapi_threshold(dapi, images), least, bin_side)


def first_good_fov(dapi: DataFrame, drawn: DataFrame, thresholds: DataFrame, least: float = FOV_LEAST_FRACTION, bin_side: int = BIN) -> DataFrame:
    """The first of the drawn windows ``(image_id, attempt, y0, x0, height, width)`` with enough nuclear pixels; an error if none has."""
    found = read_region(dapi, drawn, bin_side)
    return pick_good_fov(dapi_positive_fraction(found, thresholds, ["image_id", "attempt", "y0", "x0"]), least)


def pick_good_fov(fractions: DataFrame, least: float) -> DataFrame:
    """Each image's first attempt with a ``fraction`` of at least ``least``; an error where none has."""
    good = F.struct("attempt", "y0", "x0", "fraction")
    best = fractions.groupBy("image_id").agg(F.min(F.when(F.col("fraction") >= least, good)).alias("f"), F.max("fraction").alias("best"))
    none = F.raise_error(F.concat(F.lit("no field of view has enough nuclear pixels; the best has "), F.col("best").cast("string")))
    return best.select("image_id", F.when(F.col("f").isNull(), none).otherwise(F.col("f.attempt")).alias("attempt"), "f.y0", "f.x0", "f.fraction")


def cells_in_fov(cells: DataFrame, fovs: DataFrame, side: int = BIN) -> DataFrame:
    """Cells ``(image_id, …, x, y)`` whose finite centroid is in a field of view ``(image_id, fov_id, y0, x0, size)``, with local coordinates."""
    spread = fovs.withColumn("bin_y", F.explode(bins(F.col("y0"), F.col("size"), side))).withColumn("bin_x", F.explode(bins(F.col("x0"), F.col("size"), side)))
    good = cells.filter(finite(F.col("x")) & finite(F.col("y")))
    binned = good.withColumn("bin_y", F.floor(F.col("y") / side)).withColumn("bin_x", F.floor(F.col("x") / side))
    inside = "y >= y0 and y < y0 + size and x >= x0 and x < x0 + size"
    return binned.join(spread, ["image_id", "bin_y", "bin_x"]).filter(inside).drop("bin_y", "bin_x").withColumn("fy", F.expr("y - y0")).withColumn("fx", F.expr("x - x0"))
