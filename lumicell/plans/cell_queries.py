"""Queries on masks, pixel statistics, morphology and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumicell import fixtures as fx
from lumicell.functions import values as v
from lumicell.functions.rank import checkpointed
from lumicell.operators import aggregate as agg
from lumicell.operators import blocks as bk
from lumicell.operators import mask as mk
from lumicell.operators import match as mt
from lumicell.operators import raster as rs
from lumicell.operators import training as tr
from lumicell.plans.raster_queries import IN_WINDOW, WINDOWS, six, windows
from lumicell.plans.registry import query
from lumicell.sources import tiles as tl

STEPS = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)"
#: Pixels that fewer than four of their 4-neighbours share a label with: neighbours announce themselves, equal ones are counted.
EDGE = f"""seen AS (SELECT image_id, y + dy AS y, x + dx AS x, label, count(*) AS same FROM mask, {STEPS} GROUP BY ALL),
edges AS (SELECT m.image_id, m.y, m.x, m.label FROM mask m LEFT JOIN seen s ON s.image_id = m.image_id AND s.label = m.label AND s.y = m.y AND s.x = m.x WHERE coalesce(same, 0) < 4)"""
NEAR = EDGE + """, near AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM edges, (SELECT i-4 AS dy, j-4 AS dx FROM range(9) a(i), range(9) b(j) WHERE (i-4)*(i-4)+(j-4)*(j-4) <= 16) o),
flags AS (SELECT m.*, n.y IS NOT NULL AS near FROM mask m LEFT JOIN near n ON m.image_id = n.image_id AND m.y = n.y AND m.x = n.x)"""
#: The intensity threshold of a field of view in image 0 (512 rows and columns), for all images.
CUT = """cut AS (SELECT quantile_cont(value, 0.01) + 0.5*(quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) AS threshold FROM dirty
 WHERE image_id = 0 AND y < 512 AND x < 512 AND abs(value) < CAST('Infinity' AS DOUBLE))"""
STATS = CUT + """, stats AS (SELECT image_id, label, count(*) AS whole_pixels, count(*) FILTER ({inside}) AS denominator_pixels, count(*) FILTER ({inside} AND NOT isnan(value) AND value > threshold) AS positive_pixels,
 count(*) FILTER ({inside} AND abs(value) < CAST('Infinity' AS DOUBLE)) AS finite_pixels, sum(value) FILTER ({inside} AND abs(value) < CAST('Infinity' AS DOUBLE)) AS intensity_sum FROM {rows}, cut WHERE label > 0 GROUP BY 1, 2)"""
ALL_STATS = STATS.format(inside="true", rows="dirty")
NUCLEUS_STATS = NEAR + ", marked AS (SELECT f.*, d.value FROM flags f JOIN dirty d ON f.image_id = d.image_id AND f.y = d.y AND f.x = d.x), " + STATS.format(inside="NOT near", rows="marked")
MATCH = """labels AS (SELECT DISTINCT image_id, label FROM mask),
m1 AS (SELECT c.image_id, row_index, cx, cy, i.label AS by_id, k.label AS by_centroid, s.label AS by_sequence FROM cell_rows c
 LEFT JOIN labels i ON i.image_id = c.image_id AND i.label = c.cell_id LEFT JOIN mask k ON k.image_id = c.image_id AND k.y = round_even(cy, 0) AND k.x = round_even(cx, 0)
 LEFT JOIN labels s ON s.image_id = c.image_id AND s.label = row_index + 1),
open_rows AS (SELECT image_id, row_index, cx, cy, CAST(round_even(cx, 0) AS BIGINT) AS rx, CAST(round_even(cy, 0) AS BIGINT) AS ry FROM m1 WHERE coalesce(by_id, by_centroid, by_sequence) IS NULL),
nearest AS (SELECT image_id, row_index, label AS by_nearest FROM (SELECT o.image_id, row_index, label, row_number() OVER (PARTITION BY o.image_id, row_index ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy), y, x) AS n
 FROM open_rows o JOIN mask m ON m.image_id = o.image_id AND abs(m.y-ry) <= 75 AND abs(m.x-rx) <= 75) WHERE n = 1),
matched AS (SELECT m1.image_id, m1.row_index, coalesce(by_id, by_centroid, by_sequence, by_nearest) AS mask_label,
 CASE WHEN by_id IS NOT NULL THEN 'identifier' WHEN by_centroid IS NOT NULL THEN 'centroid' WHEN by_sequence IS NOT NULL THEN 'sequence' WHEN by_nearest IS NOT NULL THEN 'nearest' END AS matched_by
 FROM m1 LEFT JOIN nearest n ON n.image_id = m1.image_id AND n.row_index = m1.row_index)"""
CELLS = """cell_stats AS (SELECT r.image_id, row_index, mask_label, coalesce(denominator_pixels, 0) AS denominator_pixels, intensity_sum / nullif(finite_pixels, 0) AS mean_intensity,
 coalesce(positive_pixels / CAST(nullif(denominator_pixels, 0) AS DOUBLE), 0.0) AS positive_fraction FROM matched r LEFT JOIN stats s ON r.image_id = s.image_id AND r.mask_label = s.label)"""


def cells(spark, sf):
    return named_cells(fx.cell_rows(spark, sf))


def named_cells(rows):
    return rows.select("image_id", "row_index", F.col("cell_id").alias("Cell ID"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def tiles(spark, sf):
    """The derived raster as stored tiles, kept so that it is read, not derived, for each use."""
    return checkpointed(fx.raster_tiles(spark, sf))


def of(stored, *channels):
    return stored.filter(F.col("channel").isin(*channels))


def thresholds(spark, sf, stored=None, slider=500):
    """One threshold, from a field of view in image 0, for every image."""
    stored = fx.raster_tiles(spark, sf) if stored is None else stored
    corner = tl.tiles_to_pixels(tl.tiles_in_window(of(stored, "marker").filter("image_id = 0"), 0, 0, rs.FOV_SIZE, rs.FOV_SIZE)).filter(f"y < {rs.FOV_SIZE} and x < {rs.FOV_SIZE}")
    found = rs.intensity_threshold(corner, ["image_id"], slider).select("threshold")
    return fx.images(spark, sf).select("image_id").join(F.broadcast(found))  # one row


def statistics(spark, sf, compartment="all", stored=None):
    stored = tiles(spark, sf) if stored is None else stored
    return bk.pixel_statistics(of(stored, "marker"), of(stored, "mask"), thresholds(spark, sf, stored), compartment)


def table_of(masks):
    return checkpointed(named_cells(fx.cell_rows_at(bk.centroids(masks))))


def matched(spark, sf, stored=None):
    masks = of(tiles(spark, sf) if stored is None else stored, "mask")
    return bk.map_cells_to_labels(table_of(masks), masks)


def threshold_calls(spark, sf, stored, cutoff, compartment, slider):
    masks = of(stored, "mask")
    channels = fx.images(spark, sf).select("image_id", F.lit("marker").alias("name"))
    return bk.phenotype_by_threshold(table_of(masks), masks, of(stored, "marker"), thresholds(spark, sf, stored, slider), cutoff, compartment, channels=channels, channel="marker")


def calls(spark, sf, cutoff=0.25, compartment="all"):
    return threshold_calls(spark, sf, tiles(spark, sf), cutoff, compartment, 500)


@query("inner_boundaries", "mask", EDGE + " SELECT image_id, y, x, label FROM edges")
def inner_boundaries(spark, sf):
    return tl.read_mask_tiles(bk.boundary_tiles(of(fx.raster_tiles(spark, sf), "mask")))


@query("display_boundaries", "mask images", WINDOWS + """, inside AS (SELECT p.image_id, region_id, p.y-y0 AS fy, p.x-x0 AS fx, label FROM mask p JOIN """ + IN_WINDOW + f"""),
near AS (SELECT image_id, region_id, fy + dy AS fy, fx + dx AS fx, label, count(*) AS same FROM inside, {STEPS} GROUP BY ALL)
SELECT i.* FROM inside i LEFT JOIN near s ON s.image_id = i.image_id AND s.region_id = i.region_id AND s.fy = i.fy AND s.fx = i.fx AND s.label = i.label
WHERE coalesce(same, 0) < 4 - CAST(i.fy = 0 AS INTEGER) - CAST(i.fy = 15 AS INTEGER) - CAST(i.fx = 0 AS INTEGER) - CAST(i.fx = 39 AS INTEGER)""")
def display_boundaries(spark, sf):
    return mk.display_boundaries(fx.mask(spark, sf), windows(spark, sf), fx.images(spark, sf))


@query("compartment_mask", "mask", NEAR + " SELECT image_id, y, x, label FROM flags WHERE NOT near")
def compartment_mask(spark, sf):
    return tl.read_mask_tiles(bk.compartment_tiles(of(fx.raster_tiles(spark, sf), "mask"), "nucleus"))


@query("compartment_mask_rows", "mask", NEAR + " SELECT image_id, y, x, label FROM flags WHERE near")
def compartment_mask_rows(spark, sf):
    """The other compartment, from pixel rows."""
    return mk.compartment_mask(fx.mask(spark, sf), "cytoplasm_membrane")


@query("validate_mask", "mask images", """found AS (SELECT i.image_id, CASE WHEN m.image_id IS NULL THEN 'no mask' WHEN y0 < 0 OR x0 < 0 OR y1 >= i.height - 5 OR x1 >= i.width THEN 'outside the image' END AS problem
FROM (SELECT image_id, height, width FROM images UNION ALL SELECT 99, 10, 10) i LEFT JOIN (SELECT image_id, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM mask GROUP BY 1) m ON i.image_id = m.image_id) SELECT image_id, problem FROM found WHERE problem IS NOT NULL""")
def validate_mask(spark, sf):
    images = fx.images(spark, sf).select("image_id", (F.col("height") - 5).alias("height"), "width")  # five rows too few
    return mk.mask_violations(fx.mask(spark, sf), images.union(spark.createDataFrame([(99, 10, 10)], "image_id long, height long, width long")))


@query("pixel_statistics_by_label", "dirty mask", NUCLEUS_STATS + " SELECT * FROM stats")
def pixel_statistics_by_label(spark, sf):
    return statistics(spark, sf, "nucleus")


@query("pixel_counts_by_label", "dirty", ALL_STATS + " SELECT image_id, label, whole_pixels, denominator_pixels, positive_pixels FROM stats")
def pixel_counts_by_label(spark, sf):
    return statistics(spark, sf).select("image_id", "label", "whole_pixels", "denominator_pixels", "positive_pixels")


@query("tile_statistics_by_label", "dirty mask", NUCLEUS_STATS + " SELECT * FROM stats")
def tile_statistics_by_label(spark, sf):
    """From tiles that are stored from pixel rows, of another side."""
    labels = fx.mask(spark, sf).select("image_id", F.lit("mask").alias("channel"), "y", "x", F.col("label").alias("value"))
    return bk.pixel_statistics(tl.pixels_to_tiles(fx.marker(spark, sf), 128), tl.pixels_to_tiles(labels, 128, "<u4"), thresholds(spark, sf), "nucleus")


@query("pixel_row_statistics", "dirty mask", NUCLEUS_STATS + " SELECT * FROM stats")
def pixel_row_statistics(spark, sf):
    """The same from pixel rows."""
    return agg.pixel_statistics_by_label(fx.marker(spark, sf), fx.mask(spark, sf), thresholds(spark, sf), "nucleus")


@query("cell_statistics", "dirty mask cell_rows", NUCLEUS_STATS + ", " + MATCH + ", " + CELLS + " SELECT image_id, row_index, mask_label, denominator_pixels, round(mean_intensity, 6) AS mean_intensity, round(positive_fraction, 6) AS positive_fraction FROM cell_stats")
def cell_statistics(spark, sf):
    stored = tiles(spark, sf)
    found = agg.cell_statistics(statistics(spark, sf, "nucleus", stored), matched(spark, sf, stored))
    return found.select("image_id", "row_index", "mask_label", "denominator_pixels", *six("mean_intensity", "positive_fraction"))


CALLS = ALL_STATS + ", " + MATCH + ", " + CELLS + ", calls AS (SELECT *, denominator_pixels > 0 AND positive_fraction > 0.25 AS positive FROM cell_stats)"


@query("phenotype_by_threshold", "dirty mask cell_rows", CALLS + " SELECT image_id, row_index, mask_label, denominator_pixels, round(mean_intensity, 6) AS mean_intensity, round(positive_fraction, 6) AS positive_fraction, positive FROM calls")
def phenotype_by_threshold(spark, sf):
    return calls(spark, sf).select("image_id", "row_index", "mask_label", "denominator_pixels", *six("mean_intensity", "positive_fraction"), "positive")


@query("intensity_statistics", "pixels mask", """SELECT m.image_id, m.label, channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, min(v) AS least, max(v) AS most
FROM mask m JOIN (SELECT *, CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END AS v FROM pixels) p ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x GROUP BY 1, 2, 3""")
def intensity_statistics(spark, sf):
    stored = fx.raster_tiles(spark, sf)
    return bk.intensity_statistics(of(stored, "marker", "dapi"), of(stored, "mask")).select("image_id", "label", "channel", *six("mean", "sd"), "least", "most")


@query("morphology_basic", "mask", """SELECT image_id, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, y_min, x_min, y_max, x_max, round(area / CAST((y_max-y_min)*(x_max-x_min) AS DOUBLE), 6) AS extent, round(sqrt(4*area/pi()), 6) AS diameter
FROM (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y_min, min(x) AS x_min, max(y)+1 AS y_max, max(x)+1 AS x_max FROM mask GROUP BY 1, 2)""")
def morphology_basic(spark, sf):
    return agg.morphology_basic(fx.mask(spark, sf)).select("image_id", "label", "area", *six("cy", "cx"), "y_min", "x_min", "y_max", "x_max", *six("extent", "diameter"))


@query("morphology_ellipse", "mask", """SELECT image_id, label, round(4*sqrt(mid+spread), 6) AS major_axis, round(4*sqrt(greatest(mid-spread, 0)), 6) AS minor_axis, round(CASE WHEN mid+spread > 0 THEN sqrt(1-greatest(mid-spread, 0)/(mid+spread)) ELSE 0 END, 4) AS eccentricity
FROM (SELECT image_id, label, (xx+yy)/2 AS mid, sqrt(pow((xx-yy)/2, 2)+pow(xy, 2)) AS spread FROM (SELECT image_id, label, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM mask GROUP BY 1, 2))""")
def morphology_ellipse(spark, sf):
    return agg.morphology_ellipse(fx.mask(spark, sf)).select("image_id", "label", *six("major_axis", "minor_axis"), F.round("eccentricity", 4).alias("eccentricity"))


CODES = """codes AS (SELECT e.image_id, e.label, e.y, e.x, 1 + coalesce(sum(CASE WHEN n.y IS NULL THEN 0 WHEN dy <> 0 AND dx <> 0 THEN 10 ELSE 2 END), 0) AS code
 FROM (SELECT *, y + dy AS ny, x + dx AS nx FROM edges, (SELECT i-1 AS dy, j-1 AS dx FROM range(3) a(i), range(3) b(j) WHERE i <> 1 OR j <> 1) o) e
 LEFT JOIN edges n ON n.image_id = e.image_id AND n.label = e.label AND n.y = e.ny AND n.x = e.nx GROUP BY 1, 2, 3, 4),
perimeters AS (SELECT image_id, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1.0 WHEN code IN (21,33) THEN sqrt(2) WHEN code IN (13,23) THEN (1+sqrt(2))/2 ELSE 0.0 END) AS perimeter FROM codes GROUP BY 1, 2)"""


@query("morphology_perimeter", "mask", EDGE + ", " + CODES + " SELECT image_id, label, round(perimeter, 6) AS perimeter FROM perimeters")
def morphology_perimeter(spark, sf):
    return agg.morphology_perimeter(fx.mask(spark, sf)).select("image_id", "label", *six("perimeter"))


@query("morphology_solidity")
def morphology_solidity(spark, sf):
    return agg.morphology_solidity(fx.mask(spark, sf)).select("image_id", "label", *six("solidity"))


def sized_images(spark, sf):
    return fx.images(spark, sf).withColumn("pixel_size_um", F.when(F.col("image_id") != 3, 0.25 * (1 + F.col("image_id"))))


@query("physical_units", "mask", """SELECT image_id, label, round(cx*um, 6) AS "Centroid X µm", round(cy*um, 6) AS "Centroid Y µm", round(area*um*um, 6) AS "Area µm²", round(sqrt(4*area/pi())*um, 6) AS "Equivalent diameter µm"
FROM (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, CAST(CASE WHEN image_id <> 3 THEN 0.25*(1+image_id) ELSE 0.5064 END AS DOUBLE) AS um FROM mask GROUP BY 1, 2)""")
def physical_units(spark, sf):
    found = agg.physical_units(agg.morphology_basic(fx.mask(spark, sf)), sized_images(spark, sf), v.DEFAULT_PIXEL_SIZE_UM)
    return found.select("image_id", "label", *[F.round(v.column(n), 6).alias(n) for _, n, _ in agg.PHYSICAL if n in found.columns])


MEASURED = [
    "Centroid Y px", "Centroid X px", "Area px", "Perimeter px", "Eccentricity", "Extent", "Equivalent diameter px", "Major axis length px", "Minor axis length px", "Bounding box Y min px", "Bounding box X min px",
    "Bounding box Y max px", "Bounding box X max px", "Centroid X µm", "Centroid Y µm", "Area µm²", "Perimeter µm", "Equivalent diameter µm", "Major axis length µm", "Minor axis length µm",
    *[f"{c}: Cell {n}" for c in ("marker", "dapi") for n in ("Mean", "Std Dev", "Min", "Max")],
]


@query("measure_cells", "pixels mask", EDGE + ", " + CODES + """, moments AS (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y)+1 AS y1, max(x)+1 AS x1,
 (var_pop(x)+var_pop(y))/2 AS mid, sqrt(pow((var_pop(x)-var_pop(y))/2, 2)+pow(covar_pop(x, y), 2)) AS spread, CAST(CASE WHEN image_id <> 3 THEN 0.25*(1+image_id) ELSE 0.5064 END AS DOUBLE) AS um FROM mask GROUP BY 1, 2),
shape AS (SELECT *, 4*sqrt(mid+spread) AS major, 4*sqrt(greatest(mid-spread, 0)) AS minor, CASE WHEN mid+spread > 0 THEN sqrt(1-greatest(mid-spread, 0)/(mid+spread)) ELSE 0 END AS ecc, sqrt(4*area/pi()) AS diameter FROM moments),
v AS (SELECT m.image_id, m.label, channel, CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END AS v FROM mask m JOIN pixels p ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x),
st AS (SELECT image_id, label, """ + ", ".join(f"{f}(v) FILTER (channel = '{c}') AS {c}_{n}" for c in ("marker", "dapi") for f, n in (("avg", "mean"), ("stddev_pop", "sd"), ("min", "least"), ("max", "most"))) + """ FROM v GROUP BY 1, 2)
SELECT s.image_id, s.label AS "Cell ID", """ + ", ".join(f'round({e}, {4 if n == "Eccentricity" else 6}) AS "{n}"' for n, e in zip(MEASURED, [
    "cy", "cx", "CAST(area AS DOUBLE)", "perimeter", "ecc", "area / CAST((y1-y0)*(x1-x0) AS DOUBLE)", "diameter", "major", "minor", "CAST(y0 AS DOUBLE)", "CAST(x0 AS DOUBLE)", "CAST(y1 AS DOUBLE)", "CAST(x1 AS DOUBLE)",
    "cx*um", "cy*um", "area*um*um", "perimeter*um", "diameter*um", "major*um", "minor*um", *[f"{c}_{n}" for c in ("marker", "dapi") for n in ("mean", "sd", "least", "most")],
])) + " FROM shape s JOIN perimeters p ON p.image_id = s.image_id AND p.label = s.label JOIN st ON st.image_id = s.image_id AND st.label = s.label")
def measure_cells(spark, sf):
    """All measurements but solidity, which SQL cannot express."""
    stored = fx.raster_tiles(spark, sf)
    found = bk.measure_cells(of(stored, "marker", "dapi"), of(stored, "mask"), sized_images(spark, sf), ["marker", "dapi"], v.DEFAULT_PIXEL_SIZE_UM)
    return found.select("image_id", "Cell ID", *[F.round(v.column(n), 4 if n == "Eccentricity" else 6).alias(n) for n in MEASURED])


@query("phenotype_counts", "dirty mask cell_rows scored_cells actions", CALLS + """ SELECT 'threshold' AS source, CASE WHEN positive THEN 'positive' ELSE 'negative' END AS label, count(*) AS n FROM calls GROUP BY 1, 2
UNION ALL SELECT 'model', CASE WHEN called_positive THEN 'positive' ELSE 'negative' END, count(*) FROM scored_cells GROUP BY 1, 2
UNION ALL SELECT 'annotation', action, count(*) FROM (SELECT action, row_number() OVER (PARTITION BY image_id, cell_id ORDER BY ts DESC, event_id DESC) AS k FROM actions WHERE action <> 'cancel') WHERE k = 1 AND action <> 'exclude' GROUP BY 1, 2""")
def phenotype_counts(spark, sf):
    """Totals over all images of each of the three kinds: threshold calls, model calls and annotations."""
    label = lambda c: F.when(F.col(c), "positive").otherwise("negative").alias("label")
    by_threshold = calls(spark, sf).select(F.lit("threshold").alias("source"), label("positive"))
    by_model = fx.scored_cells(spark, sf).select(F.lit("model").alias("source"), label("called_positive"))
    annotated = tr.fold_annotations(fx.actions(spark, sf), ["ts", "event_id"]).select(F.lit("annotation").alias("source"), "label")
    return agg.phenotype_counts(by_threshold.union(by_model).union(annotated))


@query("cell_histograms", "scored_cells", """r AS (SELECT image_index AS image_id, min(mean_intensity) AS lo, max(mean_intensity) AS hi FROM scored_cells GROUP BY 1),
h AS (SELECT image_index AS image_id, CAST(least(floor((mean_intensity-lo)/(hi-lo)*30), 29) AS INTEGER) AS bin, count(*) AS n FROM scored_cells JOIN r ON r.image_id = image_index GROUP BY 1, 2),
p AS (SELECT image_index AS image_id, CAST(least(floor(positive_fraction*100/CAST(100 AS DOUBLE)*30), 29) AS INTEGER) AS bin, count(*) AS n FROM scored_cells WHERE positive_fraction*100 BETWEEN 0 AND 100 GROUP BY 1, 2)
SELECT 'intensity' AS measure, e.image_id, e.bin, coalesce(n, 0) AS n FROM (SELECT image_id, CAST(b AS INTEGER) AS bin FROM r, range(30) t(b)) e LEFT JOIN h ON h.image_id = e.image_id AND h.bin = e.bin
UNION ALL SELECT 'percent', e.image_id, e.bin, coalesce(n, 0) FROM (SELECT image_id, CAST(b AS INTEGER) AS bin FROM r, range(30) t(b)) e LEFT JOIN p ON p.image_id = e.image_id AND p.bin = e.bin""")
def cell_histograms(spark, sf):
    rows = fx.scored_cells(spark, sf).select(F.col("image_index").alias("image_id"), F.col("mean_intensity").cast("double").alias("mean"), (F.col("positive_fraction") * 100).cast("double").alias("percent"))
    one = agg.histogram(rows, "mean").select(F.lit("intensity").alias("measure"), "image_id", "bin", "n")
    two = agg.histogram(rows, "percent", F.lit(0.0), F.lit(100.0)).select(F.lit("percent").alias("measure"), "image_id", "bin", "n")
    return one.union(two)


@query("identifier_candidates", "cell_rows", """SELECT image_id, row_index, [CASE WHEN cell_id > 0 THEN cell_id ELSE 0 END, CASE WHEN row_index % 3 = 0 THEN 0 WHEN row_index % 3 = 1 AND row_index > 0 THEN row_index ELSE 0 END] AS candidates FROM cell_rows""")
def identifier_candidates(spark, sf):
    row = F.col("row_index")
    second = F.when(row % 3 == 0, "none").when(row % 3 == 1, row.cast("string")).otherwise((row + 0.5).cast("string"))
    named = fx.cell_rows(spark, sf).select("image_id", "row_index", F.col("cell_id").alias("Object-ID"), F.lit(1).alias("Area"), second.alias("mask_id"))
    return mt.identifier_candidates(named)


@query("match_by_identifier", "mask cell_rows", MATCH + " SELECT image_id, row_index, by_id FROM m1 WHERE by_id IS NOT NULL")
def match_by_identifier(spark, sf):
    return mt.match_by_identifier(mt.identifier_candidates(cells(spark, sf)), mt.existing_labels(fx.mask(spark, sf)))


@query("match_by_centroid", "mask cell_rows", MATCH + " SELECT image_id, row_index, by_centroid FROM m1 WHERE by_centroid IS NOT NULL")
def match_by_centroid(spark, sf):
    return mt.match_by_centroid(cells(spark, sf), fx.mask(spark, sf))


@query("match_by_sequence", "mask cell_rows", MATCH + " SELECT image_id, row_index, by_sequence FROM m1 WHERE by_sequence IS NOT NULL")
def match_by_sequence(spark, sf):
    return mt.match_by_sequence(cells(spark, sf), mt.existing_labels(fx.mask(spark, sf)))


@query("match_nearest_label", "mask cell_rows", MATCH + " SELECT image_id, row_index, by_nearest FROM nearest")
def match_nearest_label(spark, sf):
    masks = of(tiles(spark, sf), "mask")
    mask = tl.read_mask_tiles(masks)
    rows = table_of(masks)
    ids = mt.match_by_identifier(mt.identifier_candidates(rows), mt.existing_labels(mask))
    settled = ids.select("image_id", "row_index").union(mt.match_by_centroid(rows, mask).select("image_id", "row_index")).union(mt.match_by_sequence(rows, mt.existing_labels(mask)).select("image_id", "row_index"))
    return bk.match_nearest_label(rows.join(settled, ["image_id", "row_index"], "left_anti"), masks)


@query("map_cells_to_labels", "mask cell_rows", MATCH + " SELECT * FROM matched")
def map_cells_to_labels(spark, sf):
    return matched(spark, sf)


@query("map_cells_to_pixel_rows", "mask cell_rows", MATCH + " SELECT * FROM matched")
def map_cells_to_pixel_rows(spark, sf):
    """The same from pixel rows."""
    return mt.map_cells_to_labels(checkpointed(cells(spark, sf)), checkpointed(fx.mask(spark, sf)))


#: A point in each block of every image.
POINTS = """points AS (SELECT p_partkey % 4 AS image_id, p_partkey AS point_id, (p_partkey // 128)*16 + p_partkey*7 % 16 AS y, (p_partkey // 4) % 32 * 16 + p_partkey*11 % 16 AS x,
 CASE WHEN p_partkey % 3 = 0 THEN 'positive' ELSE 'negative' END AS call FROM part)"""
FIND = """rows_in AS (SELECT image_id, count(*) AS n FROM cell_rows GROUP BY 1),
near_rows AS (SELECT point_id, row_index AS nearest FROM (SELECT a.point_id, c.row_index, row_number() OVER (PARTITION BY a.point_id ORDER BY (cx-centroid_x)*(cx-centroid_x)+(cy-centroid_y)*(cy-centroid_y), c.row_index) AS k
 FROM asked a JOIN cell_rows c ON c.image_id = a.image_id AND (cx-centroid_x)*(cx-centroid_x)+(cy-centroid_y)*(cy-centroid_y) <= 5625) WHERE k = 1),
found AS (SELECT a.*, CASE WHEN a.row_index >= 0 AND a.row_index < n THEN a.row_index WHEN nearest IS NOT NULL THEN nearest WHEN TRY_CAST(cell_id AS BIGINT)-1 BETWEEN 0 AND n-1 THEN TRY_CAST(cell_id AS BIGINT)-1 END AS found_row
 FROM asked a JOIN rows_in r ON r.image_id = a.image_id LEFT JOIN near_rows q ON q.point_id = a.point_id)"""


def points(spark, sf):
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        (key % 4).alias("image_id"), key.alias("point_id"), (F.floor(key / 128) * 16 + key * 7 % 16).alias("y"), (F.floor(key / 4) % 32 * 16 + key * 11 % 16).alias("x"), F.when(key % 3 == 0, "positive").otherwise("negative").alias("call")
    )


@query("find_cell_row", "cell_rows", "asked AS (SELECT image_id, image_id*1000000+row_index AS point_id, CAST(row_index + 1 AS VARCHAR) AS cell_id, cx+3 AS centroid_x, cy-2 AS centroid_y, CASE WHEN row_index % 3 = 0 THEN row_index WHEN row_index % 3 = 1 THEN -5 END AS row_index FROM cell_rows), " + FIND + " SELECT image_id, point_id, cell_id, found_row FROM found")
def find_cell_row(spark, sf):
    row = F.col("row_index")
    asked = fx.cell_rows(spark, sf).select(
        "image_id", (F.col("image_id") * 1000000 + row).alias("point_id"), (row + 1).cast("string").alias("cell_id"), (F.col("cx") + 3).alias("centroid_x"), (F.col("cy") - 2).alias("centroid_y"),
        F.when(row % 3 == 0, row).when(row % 3 == 1, F.lit(-5)).alias("row_index"),
    )
    return mt.find_cell_row(asked, cells(spark, sf)).select("image_id", "point_id", "cell_id", "found_row")


LABEL_ROWS = "label_rows AS (SELECT c.image_id, label, min(row_index) AS row_index FROM cell_rows c JOIN mask m ON m.image_id = c.image_id AND m.y = round_even(cy, 0) AND m.x = round_even(cx, 0) GROUP BY 1, 2)"


@query("label_row_map", "mask cell_rows", LABEL_ROWS + " SELECT * FROM label_rows")
def label_row_map(spark, sf):
    return mt.label_row_map(cells(spark, sf), fx.mask(spark, sf))


@query("prediction_at_points", "mask cell_rows images", POINTS + ", " + LABEL_ROWS + """, asked AS (SELECT p.image_id, p.point_id, CAST(m.label AS VARCHAR) AS cell_id, CAST(p.x AS DOUBLE) AS centroid_x, CAST(p.y AS DOUBLE) AS centroid_y, l.row_index
 FROM points p JOIN mask m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x LEFT JOIN label_rows l ON l.image_id = p.image_id AND l.label = m.label), """ + FIND + """
SELECT image_id, point_id, cell_id, found_row AS row_index, found_row % 3 = 0 AS positive, round((found_row % 10)/10.0, 6) AS positive_probability, round(CASE WHEN found_row % 3 = 0 THEN (found_row % 10)/10.0 ELSE 1-(found_row % 10)/10.0 END, 6) AS confidence FROM found WHERE found_row % 11 <> 0""")
def prediction_at_points(spark, sf):
    row = F.col("row_index")
    predictions = fx.cell_rows(spark, sf).select("image_id", "row_index", (row % 3 == 0).alias("positive"), F.when(row % 11 != 0, (row % 10) / 10).alias("positive_probability"))
    found = mt.prediction_at_points(points(spark, sf).drop("call"), cells(spark, sf), fx.mask(spark, sf), predictions)
    return found.select("image_id", "point_id", "cell_id", "row_index", "positive", *six("positive_probability", "confidence"))


CENTRED = "on_label AS (SELECT p.*, m.label FROM points p JOIN mask m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x), centred AS (SELECT point_id, avg(m.x) AS centroid_x, avg(m.y) AS centroid_y FROM on_label o JOIN mask m ON m.image_id = o.image_id AND m.label = o.label AND abs(m.y-o.y) <= 64 AND abs(m.x-o.x) <= 64 GROUP BY 1)"


@query("local_centroid", "mask images", POINTS + ", " + CENTRED + " SELECT point_id, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y FROM centred")
def local_centroid(spark, sf):
    mask = fx.mask(spark, sf)
    return mt.local_centroid(mt.labels_at(points(spark, sf), mask), mask).select("point_id", *six("centroid_x", "centroid_y"))


@query("annotate_points", "mask cell_rows images", POINTS + ", " + CENTRED + ", asked AS (SELECT o.image_id, o.point_id, CAST(label AS VARCHAR) AS cell_id, call, centroid_x, centroid_y, CAST(NULL AS BIGINT) AS row_index FROM on_label o JOIN centred c ON c.point_id = o.point_id), " + FIND + """
SELECT image_id, point_id, cell_id, call AS label, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, found_row AS row_index, 'manual' AS source FROM found""")
def annotate_points(spark, sf):
    found = mt.annotate_points(points(spark, sf), cells(spark, sf), fx.mask(spark, sf))
    return found.select("image_id", "point_id", "cell_id", "label", *six("centroid_x", "centroid_y"), "row_index", "source")
