"""Rasters, cell tables and action logs derived from the test tables, by Spark and by SQL.

One 16 x 16 block stands for each row of ``part``; discs touch their left neighbour and the image edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicell.functions.rank import distributed_rank, in_small_batches

FOV = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, label, marker, dapi``; label 0 is background."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        key, "p_size", (3 + F.col("p_size") % 6).alias("rad"), (key % 4).alias("image_id"),
        F.floor(key / 4).alias("k"), F.floor(key / 128).alias("gy"), (F.floor(key / 4) % 32).alias("gx"),
    )
    part = part.repartition(spark.sparkContext.defaultParallelism)  # a row becomes 256, and the file is one small split
    block = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255))))
    block = block.withColumn("dy", F.floor(F.col("i") / 16)).withColumn("dx", F.col("i") % 16)
    r2 = (F.col("dy") - 8) * (F.col("dy") - 8) + (F.col("dx") - 8) * (F.col("dx") - 8)
    inside = r2 <= F.col("rad") * F.col("rad")
    wave = lambda a, b, m: (F.col("dy") * a + F.col("dx") * b + key) % m
    return block.select(
        "image_id",
        (F.col("gy") * 16 + F.col("dy")).alias("y"),
        (F.col("gx") * 16 + F.col("dx")).alias("x"),
        F.when(inside, F.col("k") + 1).otherwise(0).alias("label"),
        F.when(inside, F.col("p_size") * 100 + 400 * wave(7, 13, 11)).otherwise(200 + 10 * wave(3, 5, 7)).alias("marker"),
        (F.when(r2 <= 9, 3000).otherwise(50) + 7 * wave(5, 3, 13)).alias("dapi"),
    )


def raster_tiles(spark: SparkSession, sf_dir: str, side: int = 256) -> DataFrame:
    """The same raster as stored tiles of ``side`` (a multiple of 16) pixels: channels mask, marker (with NaN and infinite pixels) and dapi.

    Places that no row of ``part`` stands for have no label and no number.
    """
    in_small_batches(spark)
    key = F.col("p_partkey")
    blocks = table(spark, sf_dir, "part").select((key % 4).alias("image_id"), key.alias("key"), F.col("p_size").alias("size"), (F.floor(key / 128) * 16).alias("y"), (F.floor(key / 4) % 32 * 16).alias("x"))
    tiles = blocks.groupBy("image_id", F.floor(F.col("y") / side).alias("tile_y"), F.floor(F.col("x") / side).alias("tile_x")).agg(F.collect_list(F.struct("key", "size", "y", "x")).alias("blocks"))  # (side / 16)^2 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, columns = lists.offsets.to_numpy() - lists.offsets[0].as_py(), [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            for i, row in enumerate(batch.select([0, 1, 2]).to_pylist()):
                key, size, y, x = (c[ends[i] : ends[i + 1], None, None] for c in columns)
                dy, dx = np.arange(16)[None, :, None], np.arange(16)[None, None, :]
                r2 = (dy - 8) ** 2 + (dx - 8) ** 2
                inside = r2 <= (3 + size % 6) ** 2
                at = (y + dy) * 31 + x + dx
                marker = np.where(inside, size * 100 + 400 * ((dy * 7 + dx * 13 + key) % 11), 200 + 10 * ((dy * 3 + dx * 5 + key) % 7)).astype(float)
                marker = np.where(at % 97 == 0, np.nan, np.where(at % 101 == 0, np.inf, marker))
                dapi = np.where(r2 <= 9, 3000, 50) + 7 * ((dy * 5 + dx * 3 + key) % 13)
                y0, x0 = row["tile_y"] * side, row["tile_x"] * side
                height, width = int(y.max()) + 16 - y0, int(x.max()) + 16 - x0
                for channel, values, kind in (("mask", np.where(inside, key // 4 + 1, 0), "<u4"), ("marker", marker, "<f8"), ("dapi", dapi, "<f8")):
                    grid = np.full((height, width), 0 if channel == "mask" else np.nan, kind)
                    grid[y + dy - y0, x + dx - x0] = values
                    told = (row["image_id"], channel, 0, row["tile_y"], row["tile_x"], y0, x0, height, width, kind, grid.tobytes())
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(told, kinds)], names=["image_id", "channel", "level", "tile_y", "tile_x", "y0", "x0", "height", "width", "dtype", "data"])

    return tiles.select(F.col("image_id").cast("long").alias("image_id"), "tile_y", "tile_x", "blocks").mapInArrow(run, "image_id long, channel string, level int, tile_y long, tile_x long, y0 long, x0 long, height int, width int, dtype string, data binary")


def _dirty(marker) -> F.Column:
    at = F.col("y") * 31 + F.col("x")
    return F.when(at % 97 == 0, F.lit(float("nan"))).when(at % 101 == 0, F.lit(float("inf"))).otherwise(marker.cast("double"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, channel, y, x, value``; the marker has NaN and infinite pixels."""
    both = F.array(
        F.struct(F.lit("marker").alias("channel"), _dirty(F.col("marker")).alias("value")),
        F.struct(F.lit("dapi").alias("channel"), F.col("dapi").cast("double").alias("value")),
    )
    return raster(spark, sf_dir).select("image_id", "y", "x", F.explode(both).alias("p")).select("image_id", "p.channel", "y", "x", "p.value")


def marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marker_of(raster(spark, sf_dir))


def marker_of(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", F.lit("marker").alias("channel"), "y", "x", _dirty(F.col("marker")).alias("value"))


def dapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dapi_of(raster(spark, sf_dir))


def dapi_of(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", F.lit("dapi").alias("channel"), "y", "x", F.col("dapi").cast("double").alias("value"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_of(raster(spark, sf_dir))


def mask_of(rows: DataFrame) -> DataFrame:
    return rows.filter("label > 0").select("image_id", "y", "x", "label")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, name, height, width``, counted from ``part`` alone."""
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part").groupBy((key % 4).alias("image_id"))
        .agg((16 * F.max(F.floor(key / 128)) + 16).alias("height"))
        .select("image_id", F.concat(F.lit("slide "), F.col("image_id").cast("string")).alias("name"), "height", F.lit(512).cast("long").alias("width"))
    )


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with missing identifiers, unusable centroids, and rows past the last label at background corners."""
    return cell_rows_of(mask(spark, sf_dir))


def cell_rows_of(labelled: DataFrame) -> DataFrame:
    return cell_rows_at(labelled.groupBy("image_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))


def cell_rows_at(cells: DataFrame) -> DataFrame:
    """The same from the centroids ``image_id, label, cx, cy`` of the labels."""
    label = F.col("label")
    own = cells.select(
        "image_id", (label - 1).alias("row_index"), F.when(label % 5 != 0, label).alias("cell_id"),
        (F.col("cx") + F.when(label % 10 == 0, 1000000.0).otherwise(0.0)).alias("cx"), "cy",
    )
    last = cells.groupBy("image_id").agg(F.max("label").alias("n"))  # one row for each image
    counted = cells.filter(label % 20 == 0).join(last, "image_id")
    more = counted.select(
        "image_id", (F.col("n") - 1 + F.floor(label / 20)).alias("row_index"), F.lit(None).cast("long").alias("cell_id"),
        (1.0 * ((label - 1) % 32) * 16).alias("cx"), (1.0 * F.floor((label - 1) / 32) * 16).alias("cy"),
    )
    return own.unionByName(more)


def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_index, row_index, positive_fraction, mean_intensity, called_positive, positive_probability`` from ``lineitem``.

    Rows are numbered within their image by one range sort of all rows and the image's first place in it.
    """
    image = F.col("l_suppkey") % 4
    order = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    returned = F.col("l_returnflag") == "R"
    rows = table(spark, sf_dir, "lineitem").select(*order, image.alias("image_index"), "l_discount", "l_tax", returned.alias("called_positive"))
    ranked = distributed_rank(rows, ["image_index", *order], "place")
    first = ranked.groupBy("image_index").agg(F.min("place").alias("first"))  # four images
    return ranked.join(F.broadcast(first), "image_index").select(
        "image_index", (F.col("place") - F.col("first")).alias("row_index"),
        (F.col("l_discount") * 10).alias("positive_fraction"), F.col("l_extendedprice").alias("mean_intensity"), "called_positive",
        F.when(F.col("called_positive"), 0.5 + 2 * F.col("l_tax")).otherwise(0.5 - 2 * F.col("l_tax")).alias("positive_probability"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, cell_id, row_index, action, mode, ts, event_id`` from ``events``."""
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "purchase"), "positive").when(kind == "view", "negative").when(kind == "error", "exclude").otherwise("cancel")
    cell = F.floor(F.col("user_id") / 4)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("image_id"), cell.cast("string").alias("cell_id"), F.when(cell % 7 != 0, cell).alias("row_index"),
        action.alias("action"), F.when(F.col("event_id") % 3 == 0, "automated").otherwise("supervised").alias("mode"), "ts", "event_id",
    )


def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: ``image_id, row_index``, eight measurements as text or number, ``target``."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("image_id"), F.floor(F.col("vec_id") / 4).alias("row_index"), "embedding", F.col("label").alias("kind"))
    value = lambda i: F.round(F.element_at("embedding", i + 1).cast("double") * 1000)
    return rows.select(
        "image_id", "row_index",
        *[value(i).alias(f"marker{i}: Cell Mean") for i in range(6)],
        F.when(F.col("row_index") % 5 == 0, "n/a").otherwise(value(6).cast("int").cast("string")).alias("Texture"),
        F.lit(7.0).alias("Constant"), value(7).alias("Centroid X px"), F.when(F.col("image_id") != 2, value(7)).alias("Partial"),
        (F.col("kind") == 3).cast("int").alias("target"),
    )


#: The same views for DuckDB; a query names those it needs.
VIEWS = {
    "raster": """SELECT image_id, gy*16+dy AS y, gx*16+dx AS x,
      CASE WHEN r2 <= rad*rad THEN k+1 ELSE 0 END AS label,
      CASE WHEN r2 <= rad*rad THEN p_size*100 + 400*((dy*7+dx*13+p_partkey) % 11) ELSE 200 + 10*((dy*3+dx*5+p_partkey) % 7) END AS marker,
      CASE WHEN r2 <= 9 THEN 3000 ELSE 50 END + 7*((dy*5+dx*3+p_partkey) % 13) AS dapi
      FROM (SELECT p_partkey, p_size, 3+p_size%6 AS rad, p_partkey % 4 AS image_id, p_partkey // 4 AS k, p_partkey // 128 AS gy, (p_partkey // 4) % 32 AS gx FROM part) g
      CROSS JOIN (SELECT i // 16 AS dy, i % 16 AS dx, (i//16-8)*(i//16-8)+(i%16-8)*(i%16-8) AS r2 FROM range(256) AS t(i)) o""",
    "dirty": """SELECT image_id, y, x, label, CASE WHEN (y*31+x)%97=0 THEN CAST('NaN' AS DOUBLE) WHEN (y*31+x)%101=0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(marker AS DOUBLE) END AS value FROM raster""",
    "mask": "SELECT image_id, y, x, label FROM raster WHERE label > 0",
    "images": "SELECT p_partkey % 4 AS image_id, 'slide ' || (p_partkey % 4) AS name, 16*max(p_partkey // 128)+16 AS height, 512 AS width FROM part GROUP BY 1, 2",
    "pixels": "SELECT image_id, 'marker' AS channel, y, x, value FROM dirty UNION ALL SELECT image_id, 'dapi', y, x, CAST(dapi AS DOUBLE) FROM raster",
    "cell_rows": """SELECT image_id, label-1 AS row_index, CASE WHEN label%5=0 THEN NULL ELSE label END AS cell_id, cx + CASE WHEN label%10=0 THEN 1000000.0 ELSE 0.0 END AS cx, cy
      FROM (SELECT image_id, label, avg(x) cx, avg(y) cy FROM raster WHERE label>0 GROUP BY 1,2) a
      UNION ALL SELECT image_id, n-1+l//20, NULL, 1.0*((l-1)%32)*16, 1.0*((l-1)//32)*16
      FROM (SELECT DISTINCT image_id, label AS l, max(label) OVER (PARTITION BY image_id) n FROM raster WHERE label>0) b WHERE l%20=0""",
    "scored_cells": """SELECT l_suppkey % 4 AS image_index, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey,l_partkey,l_linenumber,l_extendedprice,l_shipdate)-1 AS row_index,
      l_discount*10 AS positive_fraction, l_extendedprice AS mean_intensity, l_returnflag='R' AS called_positive,
      CASE WHEN l_returnflag='R' THEN 0.5+2*l_tax ELSE 0.5-2*l_tax END AS positive_probability FROM lineitem""",
    "actions": """SELECT user_id % 4 AS image_id, CAST(user_id // 4 AS VARCHAR) AS cell_id, CASE WHEN (user_id // 4) % 7 <> 0 THEN user_id // 4 END AS row_index,
      CASE WHEN event_type IN ('click','purchase') THEN 'positive' WHEN event_type='view' THEN 'negative' WHEN event_type='error' THEN 'exclude' ELSE 'cancel' END AS action,
      CASE WHEN event_id % 3 = 0 THEN 'automated' ELSE 'supervised' END AS mode, ts, event_id FROM events""",
    "feature_cells": "SELECT vec_id % 4 AS image_id, vec_id // 4 AS row_index, "
    + ", ".join(f'round(CAST(embedding[{i + 1}] AS DOUBLE)*1000) AS "marker{i}: Cell Mean"' for i in range(6))
    + ", CASE WHEN (vec_id // 4) % 5 = 0 THEN 'n/a' ELSE CAST(CAST(round(CAST(embedding[7] AS DOUBLE)*1000) AS INTEGER) AS VARCHAR) END AS \"Texture\", 7.0 AS \"Constant\", "
    + 'round(CAST(embedding[8] AS DOUBLE)*1000) AS "Centroid X px", CASE WHEN vec_id % 4 <> 2 THEN round(CAST(embedding[8] AS DOUBLE)*1000) END AS "Partial", CAST(label = 3 AS INTEGER) AS target FROM embeddings',
}
_NEEDS = {"dirty": ["raster"], "mask": ["raster"], "pixels": ["raster", "dirty"], "cell_rows": ["raster"]}


def with_views(names: str, sql: str) -> str:
    """``sql`` after a WITH clause of the named views and what they need; ``sql`` may go on with views of its own."""
    order: list[str] = []
    for name in names.split():
        for v in [*_NEEDS.get(name, []), name]:
            if v not in order:
                order.append(v)
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
    rest = sql.lstrip().removeprefix(",").lstrip()
    return f"WITH {head}{'' if rest[:6].upper() == 'SELECT' else ','}\n{rest}"
