"""Cell tables and exports as delimited text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumicell.functions.rank import checkpointed, few


def separator(path: str) -> str:
    return "," if path.lower().endswith(".csv") else "\t"


def read_cell_table(spark: SparkSession, path: str, image_id=None, sep: str | None = None, schema: str | None = None) -> DataFrame:
    """A delimited cell table with ``row_index``, its 0-based row in file order, and ``image_id`` if given.

    A row's place is its place in its block of the file plus the rows of the blocks before, so large files are read in
    parts.  The schema is inferred unless given; a table without rows is an error.
    """
    rows = _reader(spark, sep or separator(path), schema).csv(path)
    placed = _placed(rows, lambda df: df.withColumn("image_id", F.lit(image_id)))
    if placed.isEmpty():
        raise ValueError(f"{path} has no cells")
    return placed.select(*(["image_id"] if image_id is not None else []), "row_index", *rows.columns)


def _reader(spark: SparkSession, sep: str, schema: str | None):
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema) if schema else reader.option("inferSchema", True)


def _placed(rows: DataFrame, with_image: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with ``image_id``, which ``with_image`` adds, and their row in file order within it: one job for all files."""
    own = ["file_of_row", "block_of_row"]
    read = rows.select("*", F.col("_metadata.file_path").alias("file_of_row"), F.col("_metadata.file_block_start").alias("block_of_row"), F.monotonically_increasing_id().alias("id_of_row"))
    placed = checkpointed(read).drop("image_id")
    blocks = with_image(placed.groupBy(*own).agg(F.count("*").alias("n"), F.min("id_of_row").alias("low")))  # paths are taken apart for blocks, not for rows
    before = Window.partitionBy("image_id").orderBy("file_of_row", "block_of_row").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = few(blocks.select("image_id", *own, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    joined = placed.alias("a").join(starts.alias("b"), same[0] & same[1])
    return joined.select("a.*", "b.image_id", (F.col("a.id_of_row") + F.col("b.shift")).alias("row_index")).drop("file_of_row", "block_of_row", "id_of_row")


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of each file or folder of parts (that of its first part), by path without scheme; one job for all.  Files without a line are left out."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_of_row"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    firsts = lines.filter("block = 0").groupBy("file_of_row").agg(F.min_by("value", "id").alias("line")).select(F.expr(_INSIDE).alias("path"), "line")
    found: dict[str, str] = {}
    for r in firsts.orderBy("path").collect():  # one line for each file
        for name in (r["path"], r["path"].rpartition("/")[0]):
            found.setdefault(name, r["line"])
    return found


def read_cell_tables(spark: SparkSession, paths: dict[int, str], sep: str | None = None) -> DataFrame:
    """Tables of several images ``{image_id: path}`` on the union of their columns, in first-seen order.

    One scan finds all headers; files with the same header are then read in one scan, so the number of jobs follows that of headers, not of images.  An
    image's table may be a folder of parts in the order of their names.  A table without rows is an error.
    """
    lines, kinds = headers(spark, list(paths.values())), {}
    for i, p in paths.items():
        if _inside(p) not in lines:
            raise ValueError(f"{p} has no cells")
        kinds.setdefault((sep or separator(p), lines[_inside(p)]), {})[i] = p
    tables = []
    for (kind, _), own in kinds.items():
        rows = _reader(spark, kind, None).csv(list(own.values()))
        columns = rows.columns
        named = few(spark.createDataFrame([(_inside(p), i) for i, p in own.items()], "path_of_image string, image_id long"))

        def with_image(df: DataFrame, named=named) -> DataFrame:
            file = F.expr(_INSIDE)
            own_path = F.array(file, F.regexp_replace(file, "/[^/]*$", ""))  # the file, or the folder that it is a part of
            return df.withColumn("path_of_image", F.explode(own_path)).join(named, "path_of_image").drop("path_of_image")

        tables.append((columns, _placed(rows, with_image)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t for _, t in tables])
    counts = {r["image_id"] for r in union.select("image_id").distinct().collect()}
    if missing := [p for i, p in paths.items() if i not in counts]:
        raise ValueError(f"{missing[0]} has no cells")
    return union.select("image_id", "row_index", *dict.fromkeys(c for columns, _ in tables for c in columns))


#: A path without scheme and host, percent signs resolved.
_INSIDE = "url_decode(replace(regexp_replace(file_of_row, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*', '/'), '+', '%2B'))"


def _inside(path: str) -> str:
    return "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).strip("/")


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header, one file for each partition."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_tables(df: DataFrame, path: str, by: str, sep: str = "\t") -> None:
    """The same as a folder ``by=value`` for each value of a column, from one pass over the rows."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).partitionBy(by).csv(path)


def export_name(phenotype: str, extension: str = "tsv") -> str:
    """A file name from a phenotype's letters and digits."""
    kept = "".join(c if c.isalnum() else "_" for c in phenotype).strip("_")
    return f"{kept or 'phenotype'}_cells.{extension}"


def unique_stems(names: list[str]) -> list[str]:
    """File stems of image names; a stem already used, whatever its case, gets ``_2``, ``_3`` and so on."""
    taken: set[str] = set()
    out = []
    for name in names:
        stem = name.replace("\\", "/").rsplit("/", 1)[-1]
        stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
        candidate, n = stem, 2
        while candidate.lower() in taken:
            candidate, n = f"{stem}_{n}", n + 1
        taken.add(candidate.lower())
        out.append(candidate)
    return out
