"""Training projects as JSON documents, one to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.functions.values import DEFAULT_BUFFER_UM, DEFAULT_PIXEL_SIZE_UM, buffer_px_from_um, buffer_um_from_slider

FORMAT, VERSION, VERSIONS = "phenotype training session", 4, (1, 2, 3, 4)
DEFAULT_SLIDER, DEFAULT_PERCENT, DEFAULT_FOV = 500, 25, 512
_ANNOTATION = "struct<cell_id:string,label:string,centroid_x:double,centroid_y:double,row_index:bigint,source:string>"
_THRESHOLD = "struct<intensity_slider:int,positive_pixel_percent:int,use_nucleus:boolean,use_cytoplasm_membrane:boolean,show_mask:boolean,inward_buffer_microns:double,inward_buffer_pixels:double>"
_SEGMENTING = "struct<tool:string,markers:array<string>,model:string>"
_VIEW = f"struct<current_x0:bigint,current_y0:bigint,channel_index:int,fov_size:int,color:string,show_dapi:boolean,show_segmentation:boolean,show_overview:boolean,tool:string,segmenting:{_SEGMENTING},threshold:{_THRESHOLD}>"
_PATHS = "struct<image:string,cell_data:string,segmentation_mask:string>"
_SEGMENTED = "struct<marker_names:array<string>,nuclear_channel_name:string,model_name:string>"
_IMAGE = f"struct<paths:{_PATHS},annotations:array<{_ANNOTATION}>,automated_exclusions:array<bigint>,cellpose_metadata:{_SEGMENTED},viewer:{_VIEW}>"
SCHEMA = f"format string, version int, paths {_PATHS}, images array<{_IMAGE}>, current_image_index int, phenotype struct<name:string,show_positive:boolean,show_negative:boolean,annotations:array<{_ANNOTATION}>>, viewer {_VIEW}"
#: What a project's settings have besides ``project_id`` and ``name``, with defaults.
SETTINGS = {
    "current_image_index": 0, "show_positive": True, "show_negative": True, "fov_size": DEFAULT_FOV, "color": "Green", "show_dapi": True, "show_segmentation": True, "show_overview": True, "tool": "pan",
    "intensity_slider": DEFAULT_SLIDER, "positive_pixel_percent": DEFAULT_PERCENT, "use_nucleus": True, "use_cytoplasm_membrane": True, "show_mask": False, "buffer_slider": int(DEFAULT_BUFFER_UM * 10),
}


def write_projects(images: DataFrame, annotations: DataFrame, exclusions: DataFrame, settings: DataFrame) -> DataFrame:
    """``project_id, value``: documents of the current version, with every image in order, annotated or not, and sorted exclusions.

    ``images(project_id, image_index, image, cell_data, segmentation_mask)`` and, if it has them, ``current_x0, current_y0,
    channel_index, marker_names, nuclear_channel_name, model_name``;
    ``annotations(project_id, image_index, cell_id, label, centroid_x, centroid_y, row_index, source)``,
    ``exclusions(project_id, image_index, row_index)``; ``settings(project_id, name)`` and any of ``SETTINGS``.
    An image's annotations, made by hand, are one value of a row.
    """
    by = ["project_id", "image_index"]
    fields = ["cell_id", "label", "centroid_x", "centroid_y", "row_index", "source"]
    marked = annotations.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("annotations"))
    left_out = exclusions.groupBy(*by).agg(F.array_sort(F.collect_set("row_index")).alias("automated_exclusions"))
    have = lambda df, c, kind, default=None: (F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c)
    segmented = F.struct(have(images, "marker_names", "array<string>"), have(images, "nuclear_channel_name", "string"), have(images, "model_name", "string"))
    image = F.struct(
        "image_index", F.struct("image", "cell_data", "segmentation_mask").alias("paths"),
        F.coalesce(F.col("annotations").cast(f"array<{_ANNOTATION}>"), F.expr(f"cast(array() as array<{_ANNOTATION}>)")).alias("annotations"),
        F.coalesce(F.col("automated_exclusions").cast("array<bigint>"), F.expr("cast(array() as array<bigint>)")).alias("automated_exclusions"),
        F.when(segmented["model_name"].isNotNull(), segmented).alias("cellpose_metadata"),
        F.struct(have(images, "current_x0", "bigint"), have(images, "current_y0", "bigint"), have(images, "channel_index", "int", 0)).alias("viewer"),
    )
    documents = images.join(marked, by, "left").join(left_out, by, "left").groupBy("project_id").agg(F.array_sort(F.collect_list(image)).alias("images")).join(settings, "project_id")
    kinds = {bool: "boolean", int: "int", str: "string"}
    of = {n: F.coalesce(have(settings, n, kinds[type(d)]), F.lit(d)).alias(n) for n, d in SETTINGS.items()}
    microns = buffer_um_from_slider(of["buffer_slider"])
    threshold = F.struct(*[of[n] for n in ("intensity_slider", "positive_pixel_percent", "use_nucleus", "use_cytoplasm_membrane", "show_mask")], microns.alias("inward_buffer_microns"), buffer_px_from_um(microns).alias("inward_buffer_pixels"))
    first = F.try_element_at(F.filter(F.transform("images", lambda i: i["cellpose_metadata"]), lambda m: m.isNotNull()), F.lit(1))
    segmenting = F.struct(F.lit("cell segmentation").alias("tool"), first["marker_names"].alias("markers"), first["model_name"].alias("model"))
    body = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.transform("images", lambda i: i.dropFields("image_index")).alias("images"), of["current_image_index"],
        F.struct("name", of["show_positive"], of["show_negative"]).alias("phenotype"),
        F.struct(*[of[n] for n in ("fov_size", "color", "show_dapi", "show_segmentation", "show_overview", "tool")], segmenting.alias("segmenting"), threshold.alias("threshold")).alias("viewer"),
    )
    return documents.select("project_id", F.to_json(body).alias("value"))


def parse_projects(documents: DataFrame) -> DataFrame:
    """Documents ``(project_id, value)`` of any version, with one list of images; another format or version is an error."""
    parsed = documents.select("project_id", F.from_json("value", SCHEMA).alias("p")).select("project_id", "p.*")
    bad = (F.col("format") != FORMAT) | F.col("format").isNull() | ~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False))
    nothing = lambda kind, name: F.expr(f"cast(null as {kind})").alias(name)
    single = F.array(F.struct(F.col("paths"), F.col("phenotype.annotations").alias("annotations"), nothing("array<bigint>", "automated_exclusions"), nothing(_SEGMENTED, "cellpose_metadata"), F.col("viewer").alias("viewer")))
    images = F.when(bad, F.raise_error(F.lit("not a project of a known version"))).when(F.col("version") == 1, single).otherwise(F.col("images"))
    return parsed.select("project_id", "version", images.cast(f"array<{_IMAGE}>").alias("images"), F.coalesce("current_image_index", F.lit(0)).alias("current_image_index"), F.col("phenotype").dropFields("annotations").alias("phenotype"), "viewer")


def project_images(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", F.posexplode("images").alias("image_index", "image"))


def project_annotations(projects: DataFrame) -> DataFrame:
    """Annotations with a positive or negative label; the last one of a cell counts."""
    each = project_images(projects).select("project_id", "image_index", F.posexplode("image.annotations").alias("pos", "a")).select("project_id", "image_index", "pos", "a.*")
    good = each.filter("label in ('positive', 'negative')")
    rest = F.struct("label", "centroid_x", "centroid_y", "row_index", "source")
    return good.groupBy("project_id", "image_index", "cell_id").agg(F.max_by(rest, "pos").alias("a")).select("project_id", "image_index", "cell_id", "a.*")


def project_exclusions(projects: DataFrame, cell_counts: DataFrame) -> DataFrame:
    """Distinct excluded rows inside their image's cell table; ``cell_counts(project_id, image_index, cells)``."""
    each = project_images(projects).select("project_id", "image_index", F.explode("image.automated_exclusions").alias("row_index")).distinct()
    return each.join(cell_counts, ["project_id", "image_index"]).filter("row_index >= 0 and row_index < cells").drop("cells")


def project_settings(projects: DataFrame) -> DataFrame:
    """Settings with defaults for what a document lacks; the buffer in slider steps from microns, else pixels, else the default."""
    t = F.col("viewer.threshold")
    from_um = F.rint(t["inward_buffer_microns"] * 10)
    from_px = F.rint(F.least(F.greatest(t["inward_buffer_pixels"] * DEFAULT_PIXEL_SIZE_UM, F.lit(0.0)), F.lit(5.0)) * 10)
    shown = ("fov_size", "color", "show_dapi", "show_segmentation", "show_overview", "tool")
    called = ("intensity_slider", "positive_pixel_percent", "use_nucleus", "use_cytoplasm_membrane", "show_mask")
    return projects.select(
        "project_id", "version", F.coalesce("phenotype.name", F.lit("")).alias("name"), "current_image_index",
        *[F.coalesce(F.col(f"phenotype.{n}"), F.lit(SETTINGS[n])).alias(n) for n in ("show_positive", "show_negative")],
        *[F.coalesce(F.col(f"viewer.{n}"), F.lit(SETTINGS[n])).alias(n) for n in shown], *[F.coalesce(t[n], F.lit(SETTINGS[n])).alias(n) for n in called],
        F.coalesce(from_um, from_px, F.lit(DEFAULT_BUFFER_UM * 10)).cast("int").alias("buffer_slider"),
    )
