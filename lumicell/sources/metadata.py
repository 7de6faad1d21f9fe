"""Channel names, pixel sizes and axes from image metadata kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microns in one unit.
UNIT_UM = {
    "micrometer": 1.0, "micrometre": 1.0, "µm": 1.0, "um": 1.0,
    "nanometer": 0.001, "nanometre": 0.001, "nm": 0.001,
    "millimeter": 1000.0, "millimetre": 1000.0, "mm": 1000.0,
}
#: Axis names by the number of axes.
AXES_BY_RANK = {2: "yx", 3: "cyx", 4: "zcyx", 5: "tczyx"}
_OMERO = "channels array<struct<label:string,name:string>>"
_CHANNEL_XML = "Image array<struct<Pixels:array<struct<Channel:array<struct<_Name:string>>>>>>"
#: Fixed value: the namespace that channel elements must be in, whatever prefix they have.
_OME_NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"


def _filled(names: Column) -> Column:
    """Empty and missing names become ``Channel i``."""
    return F.transform(names, lambda n, i: F.coalesce(F.nullif(n, F.lit("")), F.concat(F.lit("Channel "), i.cast("string"))))


def _numbered(count: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.concat(F.lit("Channel "), i.cast("string")))


def _page_name(text: Column, i: Column) -> Column:
    """The name in a page's text: after ``Name=`` up to the end of the line, else its number."""
    found = F.regexp_extract(text, r"Name=([^\n]*)", 1)
    return F.when(F.contains(text, F.lit("Name=")), F.trim(found)).otherwise(F.concat(F.lit("Channel "), i.cast("string")))


def resolve_channel_names(files: DataFrame) -> DataFrame:
    """``file_id, channel_index, name`` from ``files(file_id, kind, channels, reader_names, omero, biomarkers, ome_xml, imagej, pages)``.

    For kind ``zarr``: the reader's list, then OMERO's; each needs a name for every channel.  Else: biomarkers (if enough), names of
    all channels of all images in the XML, with or without a prefix, ImageJ labels (either may be fewer than the channels), names in page texts.  At last ``Channel i``.
    ``reader_names``, ``biomarkers``, ``imagej`` and ``pages`` are arrays of text, ``omero`` JSON, ``ome_xml`` XML.
    """
    n = F.col("channels").cast("int")
    enough = lambda names: F.when(F.size(names) >= n, F.slice(names, 1, n))
    some = lambda names: F.when(F.size(names) > 0, F.slice(names, 1, n))
    omero = F.transform(F.from_json("omero", _OMERO)["channels"], lambda c: F.coalesce(F.nullif(c["label"], F.lit("")), c["name"]))
    read = F.from_xml("ome_xml", _CHANNEL_XML, {"ignoreNamespace": "true"})
    each = F.flatten(F.flatten(F.transform(read["Image"], lambda i: F.transform(i["Pixels"], lambda p: F.coalesce(p["Channel"], F.expr("cast(array() as array<struct<_Name:string>>)"))))))
    xml = F.when(F.contains("ome_xml", F.lit(_OME_NAMESPACE)), F.transform(each, lambda c: c["_Name"]))
    xml = F.transform(xml, lambda x, i: F.coalesce(x, F.concat(F.lit("Channel "), i.cast("string"))))
    pages = F.transform(F.slice("pages", 1, n), _page_name)
    zarr = F.coalesce(enough(_filled(F.col("reader_names"))), enough(_filled(omero)))
    other = F.coalesce(enough(F.col("biomarkers")), some(xml), some(F.col("imagej")), F.when(F.size(pages) > 0, pages))
    names = F.coalesce(F.when(F.col("kind") == "zarr", zarr).otherwise(other), _numbered(n))
    return files.select("file_id", F.posexplode(names).alias("channel_index", "name"))


def resolve_pixel_size(files: DataFrame) -> DataFrame:
    """``file_id, pixel_size_um`` from ``metadata`` (JSON) and ``axes`` (text such as ``cyx``); null where it is malformed."""
    scales = F.from_json("metadata", "coordinateTransformations array<array<struct<type:string,scale:array<double>>>>, axes array<struct<name:string,unit:string>>")
    first = F.try_element_at(scales["coordinateTransformations"], F.lit(1))
    scale = F.try_element_at(F.filter(first, lambda t: t["type"] == "scale"), F.lit(1))["scale"]
    y = F.locate("y", F.col("axes"))
    unit = F.lower(F.try_element_at(scales["axes"], y)["unit"])
    factor = F.try_element_at(F.create_map(*[F.lit(x) for item in UNIT_UM.items() for x in item]), unit)
    good = (F.size(scale) == F.length("axes")) & (y > 0)
    return files.select("file_id", F.when(good, F.try_element_at(scale, y) * F.coalesce(factor, F.lit(1.0))).alias("pixel_size_um"))


def axes_of(names: list[str] | None, rank: int) -> list[str]:
    """Axis letters, trimmed and lower-cased, or by rank where there are none; y and x are required."""
    if not names and rank not in AXES_BY_RANK:
        raise ValueError(f"no axes known for rank {rank}")
    axes = [n.strip().lower() for n in names] if names else list(AXES_BY_RANK[rank])
    if "y" not in axes or "x" not in axes:
        raise ValueError("an image needs y and x axes")
    return axes


def select_cyx_planes(values: DataFrame, axes: list[str]) -> DataFrame:
    """``image_id, c, y, x, value`` from values indexed by columns ``i0, i1, …`` along ``axes``; other axes are fixed at 0."""
    at = {a: F.col(f"i{k}") for k, a in enumerate(axes)}
    planes = values
    for a, c in at.items():
        if a not in "cyx":
            planes = planes.filter(c == 0)
    return planes.select("image_id", at.get("c", F.lit(0)).cast("long").alias("c"), at["y"].alias("y"), at["x"].alias("x"), "value")
