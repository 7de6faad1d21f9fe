"""Queries on readers and writers; what they read is written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicell import fixtures as fx
from lumicell.functions.rank import checkpointed, shared_folder
from lumicell.operators import aggregate as agg
from lumicell.operators import schema as sc
from lumicell.operators import training as tr
from lumicell.plans.raster_queries import six
from lumicell.plans.registry import query
from lumicell.plans.training_queries import EXPORT, FOLDED, ORDER, export_parts
from lumicell.sources import cells as cs
from lumicell.sources import metadata as md
from lumicell.sources import projects as pj
from lumicell.sources import tiles as tl


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("read_cell_table", "scored_cells", "SELECT image_index AS image_id, row_index, round(CAST(mean_intensity AS DOUBLE), 6) AS mean_intensity FROM scored_cells")
def read_cell_table(spark, sf):
    rows = checkpointed(fx.scored_cells(spark, sf).select("image_index", "row_index", F.col("mean_intensity").cast("double").alias("mean_intensity")))
    path = scratch(spark, "cells")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "image_index", "row_index").sortWithinPartitions("image_index", "row_index")
    cs.write_tables(ordered.select("image_index", "mean_intensity"), path, "image_index")  # a folder for each image, of parts that follow one another
    paths = {i: f"{path}/image_index={i}" for i in range(4)}
    return cs.read_cell_tables(spark, paths, "\t").select("image_id", "row_index", *six("mean_intensity"))


@query("export_cell_phenotypes", "cell_rows actions", EXPORT)
def export_cell_phenotypes(spark, sf):
    tables, calls, trained = export_parts(spark, sf)
    path = scratch(spark, "export.tsv")
    cs.write_table(sc.phenotype_table(tables, calls, "CD3+", "Model", trained).drop("Y"), path)
    schema = '`Image Name` string, `Cell Row` long, `Cell ID` string, `Extra` string, `CD3+ Label` string, `Label Source` string'
    return spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)


def project_parts(spark, sf):
    """Projects from the action log: sixteen cells of four images each, and a fifth image that nothing was done on."""
    actions = fx.actions(spark, sf)
    cell = F.col("cell_id").cast("long")
    place = F.col("image_id").cast("int").alias("image_index")
    annotations = tr.fold_annotations(actions, ORDER).select(
        F.floor(cell / 16).alias("project_id"), place, "cell_id", "label", cell.cast("double").alias("centroid_x"), (cell.cast("double") * 2).alias("centroid_y"), cell.alias("row_index"), F.lit("manual").alias("source"),
    )
    exclusions = tr.fold_exclusions(actions, ORDER).select(F.floor(F.col("row_index") / 16).alias("project_id"), place, "row_index")
    projects = actions.select(F.floor(cell / 16).alias("project_id")).distinct()
    key = F.col("project_id")
    images = projects.select("project_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("image_index"))
    path = lambda kind: F.concat(F.lit(f"{kind}-"), F.col("image_index").cast("string")).alias(kind)
    images = images.select(
        "project_id", "image_index", path("image"), path("cell_data"), path("segmentation_mask"), (key * 10).alias("current_x0"), F.col("image_index").alias("channel_index"),
        F.when(key % 2 == 0, F.array(F.lit("CD3"), F.lit("CD8"))).alias("marker_names"), F.when(key % 2 == 0, "DAPI").alias("nuclear_channel_name"), F.when(key % 2 == 0, "model").alias("model_name"),
    )
    settings = projects.select(
        "project_id", F.concat(F.lit("CD"), key.cast("string")).alias("name"), (key % 5).cast("int").alias("current_image_index"), F.when(key % 3 != 0, (key % 1000).cast("int")).alias("intensity_slider"),
        (key % 2 == 0).alias("use_nucleus"), (key % 51).cast("int").alias("buffer_slider"), F.lit("Cyan").alias("color"), F.lit(256).alias("fov_size"),
    )
    return images, annotations, exclusions, settings


PROJECTS = FOLDED + """, excluded AS (SELECT image_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id, row_index ORDER BY ts DESC, event_id DESC) AS n FROM actions
 WHERE row_index IS NOT NULL AND (action IN ('positive', 'negative') OR (action = 'exclude' AND mode = 'automated'))) WHERE n = 1 AND action = 'exclude'),
projects AS (SELECT DISTINCT CAST(cell_id AS BIGINT) // 16 AS project_id FROM actions), images_of AS (SELECT project_id, CAST(i AS INTEGER) AS image_index FROM projects, range(5) t(i)),
ann AS (SELECT CAST(cell_id AS BIGINT) // 16 AS project_id, image_id, string_agg(cell_id || ':' || label || ':' || cell_id, ' ' ORDER BY cell_id) AS annotations FROM folded GROUP BY 1, 2),
exc AS (SELECT row_index // 16 AS project_id, image_id, string_agg(CAST(row_index AS VARCHAR), ' ' ORDER BY row_index) AS exclusions FROM excluded GROUP BY 1, 2)"""


@query("write_projects", "actions", PROJECTS + """ SELECT i.project_id, 'phenotype training session' AS format, 4 AS version, i.image_index, 'CD' || i.project_id AS name, CAST(i.project_id % 5 AS INTEGER) AS current_image_index, 'segmentation_mask-' || i.image_index AS mask,
CASE WHEN i.project_id % 2 = 0 THEN 'CD3 CD8 DAPI model' END AS segmented, i.project_id * 10 AS current_x0, i.image_index AS channel_index, CAST(CASE WHEN i.project_id % 3 <> 0 THEN i.project_id % 1000 ELSE 500 END AS INTEGER) AS intensity_slider,
round((i.project_id % 51)/10.0, 6) AS microns, coalesce(annotations, '') AS annotations, coalesce(exclusions, '') AS exclusions
FROM images_of i LEFT JOIN ann a ON a.project_id = i.project_id AND a.image_id = i.image_index LEFT JOIN exc e ON e.project_id = i.project_id AND e.image_id = i.image_index""")
def write_projects(spark, sf):
    documents = pj.write_projects(*project_parts(spark, sf))
    parsed = documents.select("project_id", F.from_json("value", pj.SCHEMA).alias("p")).select("project_id", "p.*").select("*", F.posexplode("images").alias("image_index", "i"))
    segmented = F.col("i.cellpose_metadata")
    marked = F.transform("i.annotations", lambda a: F.concat_ws(":", a["cell_id"], a["label"], a["row_index"].cast("string")))
    return parsed.select(
        "project_id", "format", "version", "image_index", "phenotype.name", "current_image_index", F.col("i.paths.segmentation_mask").alias("mask"),
        F.when(segmented.isNotNull(), F.concat_ws(" ", segmented["marker_names"], segmented["nuclear_channel_name"], segmented["model_name"])).alias("segmented"), "i.viewer.current_x0", "i.viewer.channel_index",
        "viewer.threshold.intensity_slider", F.round("viewer.threshold.inward_buffer_microns", 6).alias("microns"), F.array_join(marked, " ").alias("annotations"), F.array_join(F.col("i.automated_exclusions").cast("array<string>"), " ").alias("exclusions"),
    )


@query("read_projects", "actions", PROJECTS + """ SELECT CAST(cell_id AS BIGINT) // 16 AS project_id, CAST(image_id AS INTEGER) AS image_index, cell_id, label, CAST(cell_id AS DOUBLE) AS centroid_x FROM folded
UNION ALL SELECT row_index // 16, CAST(image_id AS INTEGER), 'row ' || row_index, 'excluded', NULL FROM excluded WHERE row_index % 16 < 12
UNION ALL SELECT project_id, image_index, 'segmentation_mask-' || image_index, 'image', NULL FROM images_of
UNION ALL SELECT project_id, CAST(project_id % 5 AS INTEGER), 'CD' || project_id || ' Cyan 256 25 ' || (CASE WHEN project_id % 2 = 0 THEN 'true' ELSE 'false' END) || ' ' || (project_id % 51), 'settings', CAST(CASE WHEN project_id % 3 <> 0 THEN project_id % 1000 ELSE 500 END AS DOUBLE) FROM projects""")
def read_projects(spark, sf):
    path = scratch(spark, "projects")
    pj.write_projects(*project_parts(spark, sf)).write.json(path)
    projects = pj.parse_projects(spark.read.schema("project_id long, value string").json(path))
    nothing = F.lit(None).cast("double").alias("centroid_x")
    images = pj.project_images(projects)
    cells = images.select("project_id", "image_index", (F.col("project_id") * 16 + 12).alias("cells"))  # the last cells of each project are out of range
    excluded = pj.project_exclusions(projects, cells).select("project_id", "image_index", F.concat(F.lit("row "), F.col("row_index").cast("string")).alias("cell_id"), F.lit("excluded").alias("label"), nothing)
    named = images.select("project_id", "image_index", F.col("image.paths.segmentation_mask"), F.lit("image"), nothing)
    text = F.concat_ws(" ", "name", "color", *[F.col(c).cast("string") for c in ("fov_size", "positive_pixel_percent", "use_nucleus", "buffer_slider")])
    settings = pj.project_settings(projects).select("project_id", "current_image_index", text, F.lit("settings"), F.col("intensity_slider").cast("double"))
    return pj.project_annotations(projects).select("project_id", "image_index", "cell_id", "label", "centroid_x").union(excluded).union(named).union(settings)


def metadata_files(spark, sf):
    """Metadata of one image file for each part, of every kind and fault."""
    key, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(F.lit("DAPI"), F.lit(""), F.concat(F.lit("CD"), size.cast("string")))
    none = F.lit(None).cast("array<string>")
    kind = key % 6
    quoted = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    return fx.table(spark, sf, "part").select(
        key.alias("file_id"), F.when(kind < 2, "zarr").otherwise("tiff").alias("kind"), F.lit(3).alias("channels"),
        F.when(kind == 0, names).when(kind == 1, F.slice(names, 1, 2)).otherwise(none).alias("reader_names"),
        F.when(kind == 1, quoted('{"channels":[{"label":"DAPI"},{"name":"CD', size, '"},{"label":""}]}')).alias("omero"),
        F.when(kind == 2, names).when(kind == 3, F.slice(names, 1, 2)).otherwise(none).alias("biomarkers"),
        F.when(kind == 3, F.when(key % 4 == 1, quoted('<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels><Channel ID="0" Name="X', size, '"/><Channel ID="1"/></Pixels></Image></OME>')).otherwise(
            quoted('<o:OME xmlns:o="http://www.openmicroscopy.org/Schemas/OME/2016-06"><o:Image><o:Pixels><o:Channel Name="A', size, '"/></o:Pixels></o:Image><o:Image><o:Pixels><o:Channel Name="B', size, '"/><o:Channel Name="C"/></o:Pixels></o:Image></o:OME>')
        )).alias("ome_xml"),
        F.when(kind == 4, F.array(F.lit("one"), quoted("two ", size))).otherwise(none).alias("imagej"),
        F.when(kind == 5, F.array(quoted("ExposureTime=3\nName= CD", size, " \nZ=1"), F.lit("nothing"), F.lit("ChannelName=CD8\n"))).otherwise(F.expr("cast(array() as array<string>)")).alias("pages"),
        quoted('{"axes":[{"name":"c"},{"name":"y","unit":"', F.element_at(F.array(*[F.lit(u) for u in ("micrometer", "NM", "mm", "inch")]), (key % 4 + 1).cast("int")), '"},{"name":"x"}],"coordinateTransformations":[[{"type":"scale","scale":[1,', size, F.when(key % 5 == 0, "").otherwise(",2"), "]}]]}").alias("metadata"),
        F.lit("cyx").alias("axes"),
    )


@query("resolve_channel_names", sql="""SELECT p_partkey AS file_id, CAST(i AS INTEGER) AS channel_index, names[i+1] AS name FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['DAPI', 'Channel 1', 'CD' || p_size] WHEN 1 THEN ['DAPI', 'CD' || p_size, 'Channel 2']
 WHEN 2 THEN ['DAPI', '', 'CD' || p_size] WHEN 3 THEN CASE WHEN p_partkey % 4 = 1 THEN ['X' || p_size, 'Channel 1'] ELSE ['A' || p_size, 'B' || p_size, 'C'] END WHEN 4 THEN ['one', 'two ' || p_size] ELSE ['CD' || p_size, 'Channel 1', 'CD8'] END AS names FROM part), range(3) t(i) WHERE i < len(names)""")
def resolve_channel_names(spark, sf):
    return md.resolve_channel_names(metadata_files(spark, sf))


@query("resolve_pixel_size", sql="SELECT p_partkey AS file_id, round(CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 WHEN 2 THEN 1000.0 ELSE 1.0 END END, 6) AS pixel_size_um FROM part")
def resolve_pixel_size(spark, sf):
    return md.resolve_pixel_size(metadata_files(spark, sf)).select("file_id", *six("pixel_size_um"))


@query("select_cyx_planes", "raster", "SELECT image_id, CAST(0 AS BIGINT) AS c, y, x, marker AS value FROM raster")
def select_cyx_planes(spark, sf):
    both = F.array(F.struct(F.lit(0).alias("z"), F.col("marker").alias("value")), F.struct(F.lit(1).alias("z"), F.col("dapi").alias("value")))
    rows = fx.raster(spark, sf).select("image_id", F.explode(both).alias("p"), "y", "x").select("image_id", F.col("p.z").alias("i0"), F.lit(0).alias("i1"), F.col("y").alias("i2"), F.col("x").alias("i3"), "p.value")
    return md.select_cyx_planes(rows, md.axes_of(None, 4))


@query("tiles_to_pixels", "raster", "SELECT image_id, y, x, CAST(dapi AS DOUBLE) AS value FROM raster WHERE y >= 5 AND x >= 60 AND x < 200")
def tiles_to_pixels(spark, sf):
    path = scratch(spark, "tiles")
    tl.write_tiles(tl.pixels_to_tiles(fx.dapi(spark, sf), 64), path)
    height = fx.images(spark, sf).agg(F.max("height")).first()[0]
    tiles = tl.tiles_in_window(spark.read.parquet(path).filter("channel = 'dapi'"), 5, 60, height - 5, 140, 64)
    found = tl.tiles_to_pixels(tiles).filter("y >= 5 and x >= 60 and x < 200")
    return found.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "value")


@query("write_segmentation", "mask", """found AS (SELECT image_id, label, count(*) AS area, min(y) AS y_min FROM mask GROUP BY 1, 2)
SELECT image_id, label, area AS pixels, area, y_min, CASE image_id WHEN 0 THEN 'slide' WHEN 1 THEN 'SLIDE_2' WHEN 2 THEN 'slide.b' ELSE 'slide_3' END || '_cells.tsv' AS file, 'model' AS model_name, 'marker' AS markers, 'dapi' AS nuclear FROM found""")
def write_segmentation(spark, sf):
    """Mask, cell table, file names and description, all read back."""
    path = scratch(spark, "segmentation")
    mask = checkpointed(fx.mask(spark, sf))
    names = {0: "a/slide.tif", 1: "b/SLIDE.tif", 2: "slide.b.tif", 3: "slide.qptiff"}
    tl.write_segmentation(agg.morphology_basic(mask).select("image_id", "label", "area", "y_min"), mask, path, "model", ["marker"], "dapi", names)
    back = tl.read_mask_tiles(tl.read_segmentation_mask(spark, path)).groupBy(F.col("image_id").cast("long").alias("image_id"), "label").agg(F.count("*").alias("pixels"))
    cells, about = tl.read_segmentation(spark, path)
    return back.join(cells.select("image_id", F.col("label").cast("long").alias("label"), "area", "y_min", "file"), ["image_id", "label"]).join(F.broadcast(about), how="cross").select(
        "image_id", "label", "pixels", "area", "y_min", "file", "model_name", F.array_join("marker_names", " ").alias("markers"), F.col("nuclear_channel_name").alias("nuclear")
    )
