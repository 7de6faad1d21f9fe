"""Rules on columns of cell tables, and unions of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicell.functions.values import DEFAULT_PIXEL_SIZE_UM, column, number

#: Endings of centroid columns in order of preference (micro sign, Greek mu, u, pixels, none).
CENTROID_UNITS = (" µm", " μm", " um", " px", "")
#: Parts of names that keep a column from being a feature.
NOT_FEATURES = ("centroid", "object id", "cell id", "label", "classification", "geometry", "polygon", "bounding", "bbox", "roi", "x min", "x max", "y min", "y max")


def _plain(name: str) -> str:
    return name.lower().replace("_", " ").replace("-", " ")


def centroid_columns(names: list[str]) -> tuple[str, str]:
    """The x and y centroid columns: an exact name first, else one that speaks of a centroid or centre on that axis."""
    found = []
    for axis in "xy":
        exact = [n for u in CENTROID_UNITS if (n := f"Centroid {axis.upper()}{u}") in names]
        fuzzy = [n for n in names if any(w in _plain(n) for w in ("centroid", "center")) and (axis in _plain(n).split() or _plain(n).endswith(axis))]
        if not exact + fuzzy:
            raise ValueError(f"no {axis} centroid column")
        found.append((exact + fuzzy)[0])
    return found[0], found[1]


def centroid_px(name: str, pixel_size_um: float = DEFAULT_PIXEL_SIZE_UM) -> Column:
    """A centroid in pixels; a column named in microns is divided by the pixel size."""
    microns = any(u in name.lower() for u in ("µm", "μm", " um", "micron"))
    return number(column(name)) / pixel_size_um if microns else number(column(name))


def centroids_px(cells: DataFrame, pixel_size_um: float = DEFAULT_PIXEL_SIZE_UM) -> DataFrame:
    """Cells with centroids ``x`` and ``y`` in pixels."""
    x, y = centroid_columns(cells.columns)
    return cells.withColumns({"x": centroid_px(x, pixel_size_um), "y": centroid_px(y, pixel_size_um)})


def is_feature(name: str) -> bool:
    return not any(part in _plain(name) for part in NOT_FEATURES)


def excluded_feature(name: Column) -> Column:
    """The same for a column of names: whether a name keeps its column from being a feature."""
    plain = F.translate(F.lower(name), "_-", "  ")
    return F.exists(F.array(*[F.lit(p) for p in NOT_FEATURES]), lambda p: F.contains(plain, p))


def shared_numeric_features(cells: DataFrame, skip: tuple[str, ...] = ("image_id", "row_index")) -> list[str]:
    """Feature columns with a number in every image; one pass over the cells.

    They come in the order of the table, which for shared columns is that of the first image, as a union has columns in first-seen order.
    """
    names = [n for n in cells.columns if n not in skip and is_feature(n)]
    if not names:
        return []
    counts = cells.groupBy("image_id").agg(*[F.count(number(column(n))).alias(f"c{i}") for i, n in enumerate(names)])
    least = counts.agg(*[F.min(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    return [n for i, n in enumerate(names) if least[f"c{i}"]]


def usable_features(training: DataFrame, features: list[str]) -> list[str]:
    """Features with more than one distinct number among the training rows."""
    if not features:
        raise ValueError("no features")
    kinds = training.agg(*[F.count_distinct(number(column(n))).alias(f"d{i}") for i, n in enumerate(features)]).first()
    found = [n for i, n in enumerate(features) if kinds[f"d{i}"] > 1]
    if not found:
        raise ValueError("no feature varies among the training cells")
    return found


def shared_markers(markers: DataFrame, images: DataFrame) -> DataFrame:
    """``name, channel_index`` of markers that every image has, by their first place in the first image."""
    n = images.select("image_id").distinct().count()
    first = markers.agg(F.min("image_id").alias("first"))
    counted = markers.groupBy("name").agg(F.count_distinct("image_id").alias("n"))
    own = markers.join(F.broadcast(first), markers.image_id == F.col("first")).groupBy("name").agg(F.min("channel_index").alias("channel_index"))
    return counted.filter(F.col("n") == n).join(own, "name").select("name", "channel_index")


def safe_channel_labels(channels: DataFrame) -> DataFrame:
    """Adds ``label``: the trimmed name, ``Channel i`` where it is empty, and a number from the second use on; a label used twice is an error."""
    base = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Channel "), (F.col("channel_index") + 1).cast("string")))
    n = F.row_number().over(Window.partitionBy("image_id", "base").orderBy("channel_index"))
    labelled = channels.withColumn("base", base).withColumn("n", n)
    labelled = labelled.withColumn("label", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))
    twice = F.count("*").over(Window.partitionBy("image_id", "label")) > 1
    error = F.raise_error(F.concat(F.lit("channel label used twice: "), F.col("label")))
    return labelled.withColumn("twice", twice).withColumn("label", F.when(F.col("twice"), error).otherwise(F.col("label"))).drop("base", "n", "twice")


def dedupe_markers(markers: DataFrame) -> DataFrame:
    """Distinct names of each image in the order of their first use."""
    return markers.groupBy("image_id", "name").agg(F.min("channel_index").alias("channel_index"))


def unique_column(name: str, taken: set[str], prefix: str) -> str:
    """``name``, or with ``prefix`` before it, or with a number after that."""
    if name not in taken:
        return name
    candidate, n = f"{prefix} {name}", 2
    while candidate in taken:
        candidate, n = f"{prefix} {name} {n}", n + 1
    return candidate


def phenotype_table(tables: list[DataFrame], calls: DataFrame, phenotype: str, source: str, overrides: DataFrame | None = None, prefix: str = "Export") -> DataFrame:
    """One table over all images: image name, 1-based row, every column in first-seen order, call and its source.

    Each of ``tables`` holds the images of one header, ``(image_name, row_index, …)``; ``calls(image_name, row_index, positive)`` must
    have each of their rows; ``overrides(image_name, row_index, label, order)`` replaces calls, the last one wins.
    """
    own = ("image_name", "row_index")
    original = list(dict.fromkeys(c for t in tables for c in t.columns if c not in own))
    taken, names = set(original), []
    for wanted in ("Image Name", "Cell Row", f"{phenotype} Label", "Label Source"):
        names.append(unique_column(wanted, taken, prefix))
        taken.add(names[-1])
    image, row, label, origin = names
    typed = [t.select(F.col("image_name").alias("image_key"), "row_index", *[column(c).cast("string").alias(c) for c in t.columns if c not in own]) for t in tables]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)
    keyed = calls.select(F.col("image_name").alias("image_key"), "row_index", F.col("positive").alias("call_positive"), F.lit(True).alias("called"))
    joined = union.join(keyed, ["image_key", "row_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for a row of "), F.col("image_key")))
    call = F.when(F.col("called").isNull(), missing).when(F.col("call_positive"), "Positive").otherwise("Negative")
    origin_of = F.lit(source)
    if overrides is not None:
        last = overrides.groupBy(F.col("image_name").alias("image_key"), "row_index").agg(F.max_by("label", "order").alias("trained"))
        joined = joined.join(last, ["image_key", "row_index"], "left")
        call = F.when(F.col("trained").isNull(), call).when(F.col("trained") == "positive", "Positive").otherwise("Negative")
        origin_of = F.when(F.col("trained").isNull(), F.lit(source)).otherwise("Manual Training")
    return joined.select(F.col("image_key").alias(image), (F.col("row_index") + 1).alias(row), *[column(c) for c in original], call.alias(label), origin_of.alias(origin))
