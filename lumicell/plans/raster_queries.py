"""Queries on windows, overviews, contrast and fields of view."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicell import fixtures as fx
from lumicell.functions import values as v
from lumicell.functions.rank import checkpointed, shared_folder
from lumicell.operators import pyramid as py
from lumicell.operators import raster as op
from lumicell.plans.registry import query

FINITE = "abs(value) < CAST('Infinity' AS DOUBLE)"
OVERVIEW = op.OVERVIEW_SIZE
#: Overview rows and columns for DuckDB: ``trunc(linspace(0, n - 1, out))``.
PICKED = f"""scaled AS (SELECT image_id, height, width, greatest(height/{OVERVIEW}.0, width/{OVERVIEW}.0, 1.0) AS s FROM images),
outs AS (SELECT *, greatest(CAST(round_even(height/s, 0) AS BIGINT), 1) AS oh, greatest(CAST(round_even(width/s, 0) AS BIGINT), 1) AS ow FROM scaled),
py AS (SELECT image_id, i AS oy, CASE WHEN oh = 1 THEN 0 WHEN i = oh-1 THEN height-1 ELSE CAST(floor(i*(CAST(height-1 AS DOUBLE)/(oh-1))) AS BIGINT) END AS y FROM outs, range(4096) t(i) WHERE i < oh),
px AS (SELECT image_id, i AS ox, CASE WHEN ow = 1 THEN 0 WHEN i = ow-1 THEN width-1 ELSE CAST(floor(i*(CAST(width-1 AS DOUBLE)/(ow-1))) AS BIGINT) END AS x FROM outs, range(4096) t(i) WHERE i < ow),
overview AS (SELECT p.image_id, channel, oy, ox, value FROM pixels p JOIN py ON p.image_id = py.image_id AND p.y = py.y JOIN px ON p.image_id = px.image_id AND p.x = px.x)"""
#: A window for every fourth block of each image, 16 x 40, across block borders; and the 16 x 16 bins that it meets.
WINDOWS = """windows AS (SELECT p_partkey % 4 AS image_id, p_partkey // 4 AS region_id, least((p_partkey // 128)*16 + 5, i.height-16) AS y0, least((p_partkey // 4) % 32 * 16 + 3, 512-40) AS x0, 16 AS height, 40 AS width
 FROM part JOIN images i ON i.image_id = p_partkey % 4 WHERE p_partkey % 16 < 4)"""
SPREAD = "spread AS (SELECT *, unnest(range(x0 // 16, (x0+width-1) // 16 + 1)) AS bx FROM (SELECT *, unnest(range(y0 // 16, (y0+height-1) // 16 + 1)) AS by FROM windows))"
#: Joins windows ``w`` with pixels ``p``.
IN_WINDOW = "spread w ON p.image_id = w.image_id AND p.y // 16 = w.by AND p.x // 16 = w.bx AND p.y >= y0 AND p.y < y0+height AND p.x >= x0 AND p.x < x0+width"
WINDOWS += ", " + SPREAD
LIMITS = """(SELECT {by}, CASE WHEN hi <= lo THEN least ELSE lo END AS low, CASE WHEN hi <= lo THEN most ELSE hi END AS high0
 FROM (SELECT {by}, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, min(v) AS least, max(v) AS most FROM
  (SELECT *, CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END AS v FROM {rows}) GROUP BY {by}))"""


def windows(spark, sf):
    key = F.col("p_partkey")
    rows = fx.table(spark, sf, "part").filter(key % 16 < 4).select(key, (key % 4).alias("image_id")).join(fx.images(spark, sf).select("image_id", F.col("height").alias("extent")), "image_id")
    return rows.select(
        "image_id", F.floor(key / 4).alias("region_id"), F.least(F.floor(key / 128) * 16 + 5, F.col("extent") - 16).alias("y0"), F.least(F.floor(key / 4) % 32 * 16 + 3, F.lit(512 - 40)).alias("x0"),
        F.lit(16).alias("height"), F.lit(40).alias("width"),
    )


def fovs(spark, sf):
    return windows(spark, sf).select("image_id", F.col("region_id").alias("fov_id"), "y0", "x0", F.lit(16).alias("size"))


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("read_region", "pixels images", WINDOWS + """ SELECT p.image_id, region_id, channel, p.y-y0 AS fy, p.x-x0 AS fx, CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END AS value
FROM pixels p JOIN """ + IN_WINDOW)
def read_region(spark, sf):
    regions = windows(spark, sf)
    op.check_windows(regions, fx.images(spark, sf))
    return op.read_region(fx.pixels(spark, sf), regions).select("image_id", "region_id", "channel", "fy", "fx", v.when_finite(F.col("value")).alias("value"))


@query("overview_level", "images", """levels AS (SELECT image_id, l AS level, greatest(height >> l, 1) AS height, greatest(width >> l, 1) AS width FROM images, range(4) t(l)),
ranked AS (SELECT *, greatest(height, width) AS s, row_number() OVER (PARTITION BY image_id ORDER BY greatest(height, width) < 100, CASE WHEN greatest(height, width) >= 100 THEN greatest(height, width) ELSE -greatest(height, width) END, level) AS n FROM levels)
SELECT image_id, level, height, width FROM ranked WHERE n = 1""")
def overview_level(spark, sf):
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    rows = fx.images(spark, sf).select("image_id", level.alias("level"), "height", "width")
    half = lambda c: F.greatest(F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))), F.lit(1)).alias(c)
    return op.overview_level(rows.select("image_id", "level", half("height"), half("width")), 100)


@query("overview_resample", "pixels images", PICKED + f" SELECT image_id, channel, oy, ox, CASE WHEN {FINITE} THEN value END AS value FROM overview")
def overview_resample(spark, sf):
    found = op.overview_resample(fx.pixels(spark, sf), fx.images(spark, sf), OVERVIEW)
    return found.withColumn("value", v.when_finite(F.col("value")))


@query("overview_of_tiles", "pixels images", PICKED + f" SELECT image_id, channel, oy, ox, value FROM overview WHERE {FINITE}")
def overview_of_tiles(spark, sf):
    """From stored tiles; without pixels that are not finite."""
    tiles = fx.raster_tiles(spark, sf).filter("channel <> 'mask'")
    return py.overview(tiles, py.level_sizes(fx.images(spark, sf), 0)).filter(v.finite(F.col("value")))


@query("overview_of_pyramid", "pixels images", f"""small AS MATERIALIZED (SELECT image_id, channel, y // 4 AS oy, x // 4 AS ox, y // 2 % 2 AS a, x // 2 % 2 AS b, avg(value) AS value FROM pixels WHERE {FINITE} GROUP BY ALL)
SELECT image_id, channel, oy, ox, round(avg(value), 6) AS value FROM small GROUP BY 1, 2, 3, 4""")
def overview_of_pyramid(spark, sf):
    """The second level of a stored pyramid, read back whole."""
    path = f"{shared_folder(spark)}/pyramid-{uuid.uuid4()}"
    py.write_pyramid(fx.raster_tiles(spark, sf, 64).filter("channel <> 'mask'"), path, 2, 64)
    level = spark.read.parquet(path).filter("level = 2")
    sizes = py.level_sizes(fx.images(spark, sf), 2).filter("level = 2")
    return py.overview(level, sizes, 1 << 30).filter(v.finite(F.col("value"))).select("image_id", "channel", "oy", "ox", *six("value"))


#: Twenty channels for each image, named from part rows.
CHANNELS = """channels AS (SELECT p_partkey // 20 AS image_id, p_partkey % 20 AS channel_index,
 CASE WHEN p_size % 11 = 0 THEN '  dapi ' || p_size WHEN p_size % 17 = 3 THEN 'DAPI' WHEN p_partkey % 20 < 3 THEN 'CD' || (p_partkey % 20) ELSE 'CD' || p_size END AS name FROM part)"""


def channels(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    named = lambda c: F.concat(F.lit("CD"), c.cast("string"))
    name = F.when(size % 11 == 0, F.concat(F.lit("  dapi "), size.cast("string"))).when(size % 17 == 3, "DAPI").when(key % 20 < 3, named(key % 20)).otherwise(named(size))
    return fx.table(spark, sf, "part").select(F.floor(key / 20).alias("image_id"), (key % 20).alias("channel_index"), name.alias("name"))


@query("is_dapi", "", "WITH " + CHANNELS + " SELECT image_id, channel_index, lower(trim(name)) LIKE '%dapi%' AS is_dapi FROM channels")
def is_dapi(spark, sf):
    return channels(spark, sf).select("image_id", "channel_index", op.is_dapi(F.col("name")).alias("is_dapi"))


@query("dapi_channel", "", "WITH " + CHANNELS + " SELECT image_id, min(CASE WHEN lower(trim(name)) LIKE '%dapi%' THEN channel_index END) AS dapi_index FROM channels GROUP BY image_id")
def dapi_channel(spark, sf):
    return op.dapi_channel(channels(spark, sf))


@query("membrane_markers", "", "WITH " + CHANNELS + " SELECT image_id, channel_index, name FROM channels WHERE lower(trim(name)) NOT LIKE '%dapi%'")
def membrane_markers(spark, sf):
    return op.membrane_markers(channels(spark, sf))


DAPI_THRESHOLD = PICKED + """, ps AS (SELECT image_id, quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.995) AS hi0, max(value) AS most FROM overview WHERE channel = 'dapi' GROUP BY image_id),
thresholds AS (SELECT image_id, lo + 0.2*((CASE WHEN hi0 <= lo THEN most ELSE hi0 END) - lo) AS threshold FROM ps)"""


@query("dapi_threshold", "pixels images", DAPI_THRESHOLD + " SELECT image_id, round(threshold, 6) AS threshold FROM thresholds")
def dapi_threshold(spark, sf):
    return op.dapi_threshold(fx.dapi(spark, sf), fx.images(spark, sf), OVERVIEW).select("image_id", *six("threshold"))


@query("dapi_positive_fraction", "pixels images", DAPI_THRESHOLD + ", " + WINDOWS + """ SELECT p.image_id, region_id, round(count(*) FILTER (value > threshold) / CAST(count(*) AS DOUBLE), 6) AS fraction
FROM pixels p JOIN """ + IN_WINDOW + """ JOIN thresholds t ON t.image_id = p.image_id WHERE channel = 'dapi' GROUP BY 1, 2""")
def dapi_positive_fraction(spark, sf):
    dapi = fx.dapi(spark, sf)
    limits = op.dapi_threshold(dapi, fx.images(spark, sf), OVERVIEW)
    found = op.dapi_positive_fraction(op.read_region(dapi, windows(spark, sf)), limits, ["image_id", "region_id"])
    return found.select("image_id", "region_id", *six("fraction"))


def dapi_tiles(spark, sf):
    """The nuclear channel as stored tiles, and the only level that is stored."""
    return checkpointed(fx.raster_tiles(spark, sf).filter("channel = 'dapi'")), py.level_sizes(fx.images(spark, sf), 0)


@query("random_fov")
def random_fov(spark, sf):
    found = py.random_fov(*dapi_tiles(spark, sf), size=fx.FOV, seed=42)
    return found.select("image_id", "attempt", "y0", "x0", *six("fraction"))


@query("first_good_fov", "pixels images", DAPI_THRESHOLD + """, drawn AS (SELECT image_id, a AS attempt, (a*11 + image_id) % (height-7) AS y0, (a*67 + 5) % (width-7) AS x0, 8 AS height, 8 AS width FROM images, range(200) t(a)),
spread AS (SELECT *, unnest(range(x0 // 16, (x0+7) // 16 + 1)) AS bx FROM (SELECT *, unnest(range(y0 // 16, (y0+7) // 16 + 1)) AS by FROM drawn)),
f AS (SELECT p.image_id, attempt, y0, x0, count(*) FILTER (value > threshold) / CAST(count(*) AS DOUBLE) AS fraction FROM pixels p JOIN spread w ON p.image_id = w.image_id AND p.y // 16 = w.by AND p.x // 16 = w.bx AND p.y >= y0 AND p.y < y0+height AND p.x >= x0 AND p.x < x0+width
 JOIN thresholds t ON t.image_id = p.image_id WHERE channel = 'dapi' GROUP BY 1, 2, 3, 4)
SELECT image_id, attempt, y0, x0, round(fraction, 6) AS fraction FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY attempt) AS n FROM f WHERE fraction >= 0.25) WHERE n = 1""")
def first_good_fov(spark, sf):
    images, (tiles, sizes) = fx.images(spark, sf), dapi_tiles(spark, sf)
    a = F.col("attempt")
    drawn = images.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    drawn = drawn.select("image_id", "attempt", ((a * 11 + F.col("image_id")) % (F.col("height") - 7)).alias("y0"), ((a * 67 + 5) % (F.col("width") - 7)).alias("x0"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    found = py.first_good_fov(tiles, drawn, py.dapi_threshold(tiles, sizes), 0.25)
    return found.select("image_id", "attempt", "y0", "x0", *six("fraction"))


@query("fov_around_cells", "cell_rows images", """SELECT c.image_id, row_index, least(greatest(CAST(round_even(cy - 16, 0) AS BIGINT), 0), greatest(height - 32, 0)) AS y0,
least(greatest(CAST(round_even(cx - 16, 0) AS BIGINT), 0), greatest(width - 32, 0)) AS x0 FROM cell_rows c JOIN images i ON c.image_id = i.image_id""")
def fov_around_cells(spark, sf):
    joined = fx.cell_rows(spark, sf).join(fx.images(spark, sf), "image_id")
    start = lambda c, extent: v.window_start(F.col(c), F.lit(32), F.col(extent))
    return joined.select("image_id", "row_index", start("cy", "height").alias("y0"), start("cx", "width").alias("x0"))


@query("fov_at_fraction", "images", """SELECT image_id, k, least(greatest(CAST(round_even(k/8.0*height - 16, 0) AS BIGINT), 0), greatest(height-32, 0)) AS y0,
least(greatest(CAST(round_even((8-k)/8.0*width - 16, 0) AS BIGINT), 0), greatest(width-32, 0)) AS x0 FROM images, range(9) t(k)""")
def fov_at_fraction(spark, sf):
    rows = fx.images(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    at = lambda share, extent: v.window_start(share * F.col(extent), F.lit(32), F.col(extent))
    return rows.select("image_id", "k", at(F.col("k") / 8, "height").alias("y0"), at((8 - F.col("k")) / 8, "width").alias("x0"))


@query("contrast_limits", "pixels", "SELECT image_id, channel, round(low, 6) AS low, round(CASE WHEN high0 <= low THEN low + 1 ELSE high0 END, 6) AS high FROM " + LIMITS.format(by="image_id, channel", rows="pixels"))
def contrast_limits(spark, sf):
    return op.contrast_limits(fx.pixels(spark, sf), ["image_id", "channel"]).select("image_id", "channel", *six("low", "high"))


GREY = """CAST(round_even(round(least(greatest(((CASE WHEN isnan(value) OR value = CAST('-Infinity' AS DOUBLE) THEN low WHEN value = CAST('Infinity' AS DOUBLE) THEN high ELSE value END) - low)/(high - low), 0.0), 1.0)*255, 9), 0) AS BIGINT)"""


@query("normalize_uint8", "pixels images", PICKED + ", lim AS (SELECT image_id, channel, low, CASE WHEN high0 <= low THEN low+1 ELSE high0 END AS high FROM " + LIMITS.format(by="image_id, channel", rows="overview") + f""")
SELECT o.image_id, o.channel, oy, ox, {GREY} AS grey FROM overview o JOIN lim ON o.image_id = lim.image_id AND o.channel = lim.channel""")
def normalize_uint8(spark, sf):
    overview = op.overview_resample(fx.pixels(spark, sf), fx.images(spark, sf), OVERVIEW)
    return op.normalize_uint8(overview, ["image_id", "channel"]).drop("value")


NORMAL = f"""strides AS (SELECT image_id, CAST(ceil(sqrt(CAST(height*width AS DOUBLE)/1000000)) AS BIGINT) AS stride FROM images),
lims AS MATERIALIZED (SELECT p.image_id, channel, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM pixels p JOIN strides s ON p.image_id = s.image_id WHERE y % stride = 0 AND x % stride = 0 AND {FINITE} GROUP BY 1, 2),
units AS (SELECT p.image_id, p.channel, y, x, CASE WHEN high > low THEN least(greatest(((CASE WHEN isnan(value) THEN low WHEN value = CAST('Infinity' AS DOUBLE) THEN high ELSE value END) - low)/(high - low), 0.0), 1.0) ELSE 0.0 END AS unit
FROM pixels p LEFT JOIN lims l ON p.image_id = l.image_id AND p.channel = l.channel)"""


@query("normalize_channel", "pixels images", NORMAL + " SELECT image_id, channel, y, x, round(unit, 6) AS unit FROM units")
def normalize_channel(spark, sf):
    return op.normalize_channel(fx.pixels(spark, sf), fx.images(spark, sf)).select("image_id", "channel", "y", "x", *six("unit"))


@query("segmentation_input", "pixels images", NORMAL + """ SELECT image_id, y, x, CAST(floor(max(CASE WHEN channel = 'marker' THEN unit END)*255) AS INTEGER) AS ch0,
CAST(floor(max(CASE WHEN channel = 'dapi' THEN unit END)*255) AS INTEGER) AS ch1, 0 AS ch2 FROM units GROUP BY 1, 2, 3""")
def segmentation_input(spark, sf):
    return op.segmentation_input(fx.pixels(spark, sf), fx.images(spark, sf), ["marker", "marker"], "dapi")


@query("rgb_overview", "pixels images", PICKED + ", lim AS (SELECT image_id, channel, low, CASE WHEN high0 <= low THEN low+1 ELSE high0 END AS high FROM " + LIMITS.format(by="image_id, channel", rows="overview") + f"""),
g AS (SELECT o.image_id, o.channel, oy, ox, {GREY} AS grey FROM overview o JOIN lim ON o.image_id = lim.image_id AND o.channel = lim.channel)
SELECT m.image_id, m.oy, m.ox, m.grey AS red, CAST(0 AS BIGINT) AS green, greatest(m.grey, d.grey) AS blue FROM g m JOIN g d ON m.image_id = d.image_id AND m.oy = d.oy AND m.ox = d.ox WHERE m.channel = 'marker' AND d.channel = 'dapi'""")
def rgb_overview(spark, sf):
    return op.rgb_overview(fx.marker(spark, sf), fx.dapi(spark, sf), fx.images(spark, sf), "Magenta", OVERVIEW)


THRESHOLDS = """inside AS MATERIALIZED (SELECT p.image_id, region_id, p.y-y0 AS fy, p.x-x0 AS fx, value FROM pixels p JOIN """ + IN_WINDOW + f""" WHERE channel = 'marker'),
ends AS MATERIALIZED (SELECT image_id, region_id, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM inside WHERE {FINITE} GROUP BY 1, 2),
thresholds AS MATERIALIZED (SELECT image_id, region_id, low + 0.5*(high - low) AS threshold FROM ends)"""


@query("intensity_threshold", "pixels images", WINDOWS + ", " + THRESHOLDS + " SELECT image_id, region_id, round(threshold, 6) AS threshold FROM thresholds")
def intensity_threshold(spark, sf):
    regions = op.read_region(fx.marker(spark, sf), windows(spark, sf))
    return op.intensity_threshold(regions, ["image_id", "region_id"], 500).select("image_id", "region_id", *six("threshold"))


@query("threshold_highlight", "pixels images", WINDOWS + ", " + THRESHOLDS + """ SELECT i.image_id, i.region_id, fy, fx FROM inside i JOIN thresholds t ON t.image_id = i.image_id AND t.region_id = i.region_id WHERE NOT isnan(value) AND value > threshold""")
def threshold_highlight(spark, sf):
    regions = op.read_region(fx.marker(spark, sf), windows(spark, sf))
    by = ["image_id", "region_id"]
    return op.threshold_highlight(regions, op.intensity_threshold(regions, by, 500), by).select(*by, "fy", "fx")


@query("cells_in_fov", "cell_rows images", WINDOWS.split(", " + SPREAD)[0].replace("AS height, 40 AS width", "AS size") + """ SELECT c.image_id, region_id AS fov_id, row_index, round(cy-y0, 6) AS fy, round(cx-x0, 6) AS fx
FROM cell_rows c JOIN windows w ON c.image_id = w.image_id AND cy >= y0 AND cy < y0+size AND cx >= x0 AND cx < x0+size""")
def cells_in_fov(spark, sf):
    cells = fx.cell_rows(spark, sf).select("image_id", "row_index", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return op.cells_in_fov(cells, fovs(spark, sf)).select("image_id", "fov_id", "row_index", *six("fy", "fx"))


@query("buffer_conversions", sql="""SELECT p_partkey, round((p_partkey % 60)/10.0, 6) AS microns, greatest(CAST(round_even(((p_partkey % 60)/10.0)/0.5064, 0) AS BIGINT), 0) AS pixels,
CAST(round_even(least(greatest((p_partkey % 14)*CAST(0.5064 AS DOUBLE), 0.0), 5.0)*10, 0) AS BIGINT) AS slider, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'all' WHEN p_size % 2 = 0 THEN 'nucleus' WHEN p_size % 3 = 0 THEN 'cytoplasm_membrane' END AS compartment FROM part""")
def buffer_conversions(spark, sf):
    slider, size = F.col("p_partkey") % 60, F.col("p_size")
    microns = v.buffer_um_from_slider(slider)
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.round(microns, 6).alias("microns"), v.buffer_px_from_um(microns).alias("pixels"),
        v.buffer_slider_from_px(F.col("p_partkey") % 14).alias("slider"), v.compartment_from_flags(size % 2 == 0, size % 3 == 0).alias("compartment"),
    )
