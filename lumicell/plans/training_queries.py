"""Queries on table schemas, annotations, pools and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicell import fixtures as fx
from lumicell.functions.rank import shared_folder
from lumicell.operators import forest as rf
from lumicell.operators import schema as sc
from lumicell.operators import training as tr
from lumicell.plans.cell_queries import cells
from lumicell.plans.raster_queries import CHANNELS, channels, six
from lumicell.plans.registry import query

ORDER = ["ts", "event_id"]
FEATURES = [*[f"marker{i}: Cell Mean" for i in range(6)], "Texture", "Constant"]


NOT_FEATURE = "regexp_matches(translate(lower({name}), '_-', '  '), '" + "|".join(sc.NOT_FEATURES) + "')"
#: Every column of the cells but their keys, as text, one row for each value.
UNPIVOTED = """values_of AS (UNPIVOT (SELECT image_id, row_index, CAST(COLUMNS(* EXCLUDE (image_id, row_index, target)) AS VARCHAR) FROM feature_cells) ON COLUMNS(* EXCLUDE (image_id, row_index)) INTO NAME feature VALUE value)"""


@query("centroid_columns", sql="""WITH heads AS (SELECT p_partkey, ['Area', CASE WHEN p_partkey % 3 = 0 THEN 'center_x' WHEN p_partkey % 3 = 1 THEN 'Nucleus Centroid X' ELSE 'X' END, CASE WHEN p_partkey % 4 < 2 THEN 'Centroid Y px' ELSE 'cell-center-y' END,
 CASE WHEN p_partkey % 5 = 0 THEN 'Centroid X um' ELSE 'Centroid X' END, CASE WHEN p_partkey % 7 = 0 THEN 'Centroid Y µm' ELSE 'Label' END] AS names FROM part),
n AS (SELECT p_partkey, generate_subscripts(names, 1) AS place, unnest(names) AS name FROM heads),
c AS (SELECT p_partkey, axis, name, place, CASE WHEN name = 'Centroid ' || upper(axis) || ' µm' THEN 0 WHEN name = 'Centroid ' || upper(axis) || ' μm' THEN 1 WHEN name = 'Centroid ' || upper(axis) || ' um' THEN 2 WHEN name = 'Centroid ' || upper(axis) || ' px' THEN 3
 WHEN name = 'Centroid ' || upper(axis) THEN 4 WHEN regexp_matches(lower(name), 'centroid|center') AND (list_contains(string_split(translate(lower(name), '_-', '  '), ' '), axis) OR lower(name) LIKE '%' || axis) THEN 5 END AS kind FROM n, (VALUES ('x'), ('y')) a(axis))
SELECT p_partkey, max(name) FILTER (axis = 'x') AS x_column, max(name) FILTER (axis = 'y') AS y_column FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, axis ORDER BY kind, place) AS k FROM c WHERE kind IS NOT NULL) WHERE k = 1 GROUP BY 1""")
def centroid_columns(spark, sf):
    """Headers of many tables; the rule is applied once to each distinct header."""
    key = F.col("p_partkey")
    names = F.array(
        F.lit("Area"), F.when(key % 3 == 0, "center_x").when(key % 3 == 1, "Nucleus Centroid X").otherwise("X"), F.when(key % 4 < 2, "Centroid Y px").otherwise("cell-center-y"),
        F.when(key % 5 == 0, "Centroid X um").otherwise("Centroid X"), F.when(key % 7 == 0, "Centroid Y µm").otherwise("Label"),
    )
    heads = fx.table(spark, sf, "part").select(key, names.alias("names"))
    known = [(list(r["names"]), *sc.centroid_columns(list(r["names"]))) for r in heads.select("names").distinct().collect()]  # a few headers
    found = F.broadcast(spark.createDataFrame(known, "names array<string>, x_column string, y_column string"))
    return heads.join(found, "names").select("p_partkey", "x_column", "y_column")


@query("centroids_px", "feature_cells", """SELECT image_id, row_index, "Centroid X px" AS x, round("marker0: Cell Mean"/CAST(0.5064 AS DOUBLE), 6) AS y FROM feature_cells""")
def centroids_px(spark, sf):
    named = fx.feature_cells(spark, sf).withColumnRenamed("marker0: Cell Mean", "Centroid Y µm")
    return sc.centroids_px(named).select("image_id", "row_index", "x", *six("y"))


NAMED = """named AS (SELECT p_partkey, p_type || ' ' || ['Mean', 'Centroid_Z', 'object-ID', 'Cell ID', 'LABEL', 'Classification', 'geometry x', 'polygon', 'Bounding', 'bbox', 'roi', 'X_min', 'x max', 'Y-Min', 'y max', 'xmin', 'Intensity', 'Erosion'][1 + p_partkey % 18] AS name FROM part)"""
ENDS = "Mean,Centroid_Z,object-ID,Cell ID,LABEL,Classification,geometry x,polygon,Bounding,bbox,roi,X_min,x max,Y-Min,y max,xmin,Intensity,Erosion".split(",")


@query("excluded_feature", sql="WITH " + NAMED + " SELECT p_partkey, name, " + NOT_FEATURE.format(name="name") + " AS excluded FROM named")
def excluded_feature(spark, sf):
    name = F.concat_ws(" ", "p_type", F.element_at(F.array(*map(F.lit, ENDS)), (F.col("p_partkey") % 18 + 1).cast("int")))
    return fx.table(spark, sf, "part").select("p_partkey", name.alias("name"), sc.excluded_feature(name).alias("excluded"))


@query("shared_numeric_features", "feature_cells", ", " + UNPIVOTED + """ SELECT feature, (SELECT count(*) FROM feature_cells) AS cells FROM values_of WHERE NOT """ + NOT_FEATURE.format(name="feature") + """
GROUP BY feature HAVING count(DISTINCT image_id) FILTER (TRY_CAST(value AS DOUBLE) IS NOT NULL) = (SELECT count(DISTINCT image_id) FROM feature_cells)""")
def shared_numeric_features(spark, sf):
    rows = fx.feature_cells(spark, sf).drop("target")
    found = sc.shared_numeric_features(rows)
    return rows.select(F.explode(F.array(*[F.lit(n) for n in found])).alias("feature")).groupBy("feature").agg(F.count("*").alias("cells"))


ANNOTATED = "folded AS (SELECT image_id, cell_id, action AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cell_id ORDER BY ts DESC, event_id DESC) AS n FROM actions WHERE action <> 'cancel') WHERE n = 1 AND action <> 'exclude'), annotated AS (SELECT c.*, label FROM feature_cells c JOIN folded f ON f.image_id = c.image_id AND CAST(f.cell_id AS BIGINT) = c.row_index)"


def training_cells(spark, sf):
    """Cells that the action log annotates, with their label as target."""
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER).select("image_id", F.col("cell_id").cast("long").alias("row_index"), (F.col("label") == "positive").cast("int").alias("target"))
    return fx.feature_cells(spark, sf).drop("target").join(folded, ["image_id", "row_index"])


@query("usable_features", "feature_cells actions", ", " + ANNOTATED + ", " + UNPIVOTED.replace("target)) AS VARCHAR) FROM feature_cells)", "target, label)) AS VARCHAR) FROM annotated)") + """ SELECT feature, (SELECT count(*) FROM annotated) AS cells FROM values_of
WHERE feature IN ('""" + "', '".join(FEATURES) + """') GROUP BY feature HAVING count(DISTINCT TRY_CAST(value AS DOUBLE)) > 1""")
def usable_features(spark, sf):
    rows = training_cells(spark, sf)
    found = sc.usable_features(rows, FEATURES)
    return rows.select(F.explode(F.array(*[F.lit(n) for n in found])).alias("feature")).groupBy("feature").agg(F.count("*").alias("cells"))


#: Channels of four images, with names that several channels and images have.
FOUR = """four AS MATERIALIZED (SELECT p_partkey % 4 AS image_id, p_partkey // 4 AS channel_index, CASE WHEN p_size % 11 = 0 THEN '  dapi ' || p_size WHEN p_size % 17 = 3 THEN 'DAPI' ELSE 'CD' || p_size END AS name FROM part),
markers AS MATERIALIZED (SELECT * FROM four WHERE lower(trim(name)) NOT LIKE '%dapi%'), everywhere AS (SELECT name FROM markers GROUP BY 1 HAVING count(DISTINCT image_id) = (SELECT count(DISTINCT image_id) FROM four))"""


@query("shared_membrane_markers", "", "WITH " + FOUR + " SELECT m.name, min(channel_index) AS channel_index FROM markers m JOIN everywhere e ON e.name = m.name WHERE image_id = (SELECT min(image_id) FROM markers) GROUP BY 1")
def shared_membrane_markers(spark, sf):
    from lumicell.operators.raster import membrane_markers

    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("  dapi "), size)).when(F.col("p_size") % 17 == 3, "DAPI").otherwise(F.concat(F.lit("CD"), size))
    rows = fx.table(spark, sf, "part").select((key % 4).alias("image_id"), F.floor(key / 4).alias("channel_index"), name.alias("name"))
    return sc.shared_markers(membrane_markers(rows), rows)


@query("safe_channel_labels", sql="""SELECT image_id, channel_index, CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, base ORDER BY channel_index) AS n
FROM (SELECT p_partkey // 20 AS image_id, p_partkey % 20 AS channel_index, CASE WHEN p_size % 7 = 0 THEN 'Channel ' || (p_partkey % 20 + 1) ELSE 'CD' || (p_size % 7) END AS base FROM part))""")
def safe_channel_labels(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = fx.table(spark, sf, "part").select(F.floor(key / 20).alias("image_id"), (key % 20).alias("channel_index"), F.when(size % 7 == 0, "  ").otherwise(F.concat(F.lit(" CD"), (size % 7).cast("string"))).alias("name"))
    return sc.safe_channel_labels(rows).select("image_id", "channel_index", "label")


@query("dedupe_markers", sql="SELECT p_partkey // 20 AS image_id, 'CD' || (p_size % 7) AS name, min(p_partkey % 20) AS channel_index FROM part GROUP BY 1, 2")
def dedupe_markers(spark, sf):
    key = F.col("p_partkey")
    rows = fx.table(spark, sf, "part").select(F.floor(key / 20).alias("image_id"), (key % 20).alias("channel_index"), F.concat(F.lit("CD"), (F.col("p_size") % 7).cast("string")).alias("name"))
    return sc.dedupe_markers(rows)


@query("unique_export_column", sql="""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Label' WHEN c_custkey % 3 = 0 THEN 'Export ' || c_mktsegment ELSE 'Export ' || c_mktsegment || ' 2' END AS name FROM customer""")
def unique_export_column(spark, sf):
    rows = fx.table(spark, sf, "customer")
    segments = {r["c_mktsegment"] for r in rows.select("c_mktsegment").distinct().collect()}  # five segments
    taken = segments | {f"Export {s}" for s in segments}
    named = lambda names: F.create_map(*[F.lit(x) for s in sorted(segments) for x in (s, sc.unique_column(s, names, "Export"))])
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(key % 2 == 0, sc.unique_column("Label", segments, "Export")).when(key % 3 == 0, named(segments)[segment]).otherwise(named(taken)[segment])
    return rows.select("c_custkey", name.alias("name"))


def export_parts(spark, sf):
    """Cell tables of two headers, calls, and training labels."""
    rows = fx.cell_rows(spark, sf)
    own = rows.select(F.concat(F.lit("slide "), F.col("image_id").cast("string")).alias("image_name"), "row_index", F.col("cell_id").alias("Cell ID"), F.col("cy").alias("Y"), (F.col("row_index") * 2).alias("Extra"), (F.col("image_id") % 2).alias("odd"))
    tables = [own.filter("odd = 0").drop("Extra", "odd"), own.filter("odd = 1").drop("odd")]
    calls = rows.select(F.concat(F.lit("slide "), F.col("image_id").cast("string")).alias("image_name"), "row_index", (F.col("row_index") % 3 == 0).alias("positive"))
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    trained = folded.join(rows, (folded.image_id == rows.image_id) & (folded.cell_id.cast("long") == rows.row_index)).select(
        F.concat(F.lit("slide "), folded.image_id.cast("string")).alias("image_name"), "row_index", "label", F.lit(0).alias("order")
    )
    return tables, calls, trained


FOLDED = "folded AS (SELECT image_id, cell_id, action AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cell_id ORDER BY ts DESC, event_id DESC) AS n FROM actions WHERE action <> 'cancel') WHERE n = 1 AND action <> 'exclude')"
EXPORT = FOLDED + """ SELECT 'slide ' || c.image_id AS "Image Name", row_index + 1 AS "Cell Row", CAST(c.cell_id AS VARCHAR) AS "Cell ID", CASE WHEN c.image_id % 2 = 1 THEN CAST(row_index*2 AS VARCHAR) END AS "Extra",
CASE WHEN label IS NULL THEN CASE WHEN row_index % 3 = 0 THEN 'Positive' ELSE 'Negative' END WHEN label = 'positive' THEN 'Positive' ELSE 'Negative' END AS "CD3+ Label", CASE WHEN label IS NULL THEN 'Model' ELSE 'Manual Training' END AS "Label Source"
FROM cell_rows c LEFT JOIN folded f ON f.image_id = c.image_id AND TRY_CAST(f.cell_id AS BIGINT) = c.row_index"""


@query("phenotype_table", "cell_rows actions", EXPORT)
def phenotype_table(spark, sf):
    tables, calls, trained = export_parts(spark, sf)
    return sc.phenotype_table(tables, calls, "CD3+", "Model", trained).drop("Y")


@query("fold_annotation_actions", "actions", FOLDED + """, excluded AS (SELECT image_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id, row_index ORDER BY ts DESC, event_id DESC) AS n FROM actions
 WHERE row_index IS NOT NULL AND (action IN ('positive', 'negative') OR (action = 'exclude' AND mode = 'automated'))) WHERE n = 1 AND action = 'exclude')
SELECT image_id, cell_id, label FROM folded UNION ALL SELECT image_id, CAST(row_index AS VARCHAR), 'excluded row' FROM excluded""")
def fold_annotation_actions(spark, sf):
    actions = fx.actions(spark, sf)
    rows = tr.fold_exclusions(actions, ORDER).select("image_id", F.col("row_index").cast("string").alias("cell_id"), F.lit("excluded row").alias("label"))
    return tr.fold_annotations(actions, ORDER).unionByName(rows)


@query("training_annotations", "actions", FOLDED + " SELECT image_id, cell_id, row_number() OVER (ORDER BY image_id, CAST(cell_id AS BIGINT)) - 1 AS place FROM folded WHERE label = 'negative'")
def training_annotations(spark, sf):
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    return tr.training_annotations(folded, "negative", [F.col("image_id"), F.col("cell_id").cast("long")]).select("image_id", "cell_id", "place")


@query("training_rows", "cell_rows actions", FOLDED + """, counts AS (SELECT image_id, count(*) AS n FROM cell_rows GROUP BY 1)
SELECT f.image_id, CAST(cell_id AS BIGINT) - 1 AS row_index, CAST(label = 'positive' AS INTEGER) AS target FROM folded f JOIN counts c ON c.image_id = f.image_id WHERE CAST(cell_id AS BIGINT) BETWEEN 1 AND n""")
def training_rows(spark, sf):
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    nowhere = F.lit(-1e7)
    asked = folded.select("image_id", F.concat_ws("/", F.col("image_id").cast("string"), "cell_id").alias("point_id"), "cell_id", "label", nowhere.alias("centroid_x"), nowhere.alias("centroid_y"), F.lit(None).cast("long").alias("row_index"))
    return tr.training_rows(asked, cells(spark, sf))


@query("automated_quotas", "actions", FOLDED + """, c AS (SELECT count(*) FILTER (label = 'positive' AND CAST(cell_id AS BIGINT) % 9 = 4) AS p, count(*) FILTER (label = 'negative' AND CAST(cell_id AS BIGINT) % 9 = 4) AS n FROM folded)
SELECT greatest(25-p, 0) AS positive, least(CAST(round_even(greatest(25-n, 0)*15/25.0, 0) AS BIGINT), 15) AS negative_low, greatest(25-n, 0) - least(CAST(round_even(greatest(25-n, 0)*15/25.0, 0) AS BIGINT), 15) AS negative_mid FROM c""")
def automated_quotas(spark, sf):
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    return tr.automated_quotas(folded.withColumn("source", F.when(F.col("cell_id").cast("long") % 9 == 4, "manual").otherwise("automated")))


POOLS = """neg AS (SELECT *, row_number() OVER (ORDER BY mean_intensity, image_index, row_index) - 1 AS r, count(*) OVER () AS n FROM scored_cells WHERE positive_fraction <= 0.25),
pos AS (SELECT *, row_number() OVER (ORDER BY positive_fraction DESC, image_index DESC, row_index DESC) - 1 AS r, count(*) OVER () AS n FROM scored_cells WHERE positive_fraction > 0.25),
pools AS (SELECT CASE WHEN r < ceil(n*0.5) THEN 'low' ELSE 'mid' END AS pool, r, image_index, row_index FROM neg WHERE r < ceil(n*0.8) UNION ALL SELECT 'positive', r, image_index, row_index FROM pos WHERE r < ceil(n*0.3))"""


def excluded(cells_):
    return cells_.filter("row_index % 17 = 3").select("image_index", "row_index")


@query("automated_training_pools", "scored_cells", POOLS + " SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY r) - 1 AS place, image_index, row_index FROM pools WHERE row_index % 17 <> 3")
def automated_training_pools(spark, sf):
    scored = fx.scored_cells(spark, sf)
    return tr.automated_training_pools(scored, 0.25, excluded(scored))


@query("automated_training_selection")
def automated_training_selection(spark, sf):
    scored = fx.scored_cells(spark, sf)
    return tr.automated_training_selection(scored, 0.25, excluded=excluded(scored))


REFINE = """valid AS (SELECT *, CASE WHEN called_positive THEN positive_probability ELSE 1-positive_probability END AS confidence FROM scored_cells WHERE row_index % 17 <> 3),
b AS (SELECT *, row_number() OVER (PARTITION BY called_positive ORDER BY mean_intensity, image_index, row_index) - 1 AS r, count(*) OVER (PARTITION BY called_positive) AS n FROM valid WHERE confidence < 0.6),
pools AS (SELECT 'positive' AS pool, r, image_index, row_index FROM b WHERE NOT called_positive AND r >= n - ceil(n*0.1) UNION ALL SELECT 'negative', r, image_index, row_index FROM b WHERE called_positive AND r < ceil(n*0.1))"""


@query("refinement_pools", "scored_cells", REFINE + " SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY r) - 1 AS place, image_index, row_index FROM pools")
def refinement_pools(spark, sf):
    scored = fx.scored_cells(spark, sf)
    return tr.refinement_pools(scored, 0.6, excluded(scored))


@query("refinement_selection")
def refinement_selection(spark, sf):
    scored = fx.scored_cells(spark, sf)
    return tr.refinement_selection(scored, 0.6, excluded=excluded(scored), seed=tr.stage_seed(tr.SEED, 1))


@query("stage_seed", sql="SELECT s_suppkey, (4294967290 + s_suppkey) % 4294967296 AS seed FROM supplier")
def stage_seed(spark, sf):
    return fx.table(spark, sf, "supplier").select("s_suppkey", tr.stage_seed(F.lit(4294967290), F.col("s_suppkey")).alias("seed"))


def fitted(spark, sf):
    return rf.fit_forest(training_cells(spark, sf), FEATURES)


@query("fit_forest")
def fit_forest(spark, sf):
    """How a forest calls the cells that it was fitted on, and all others."""
    model, used = fitted(spark, sf)
    known = training_cells(spark, sf).select("image_id", "row_index", F.col("target").alias("trained_as"))
    scored = rf.apply_forest(model, fx.feature_cells(spark, sf).join(known, ["image_id", "row_index"], "left"), used, ["trained_as"])
    return scored.groupBy("trained_as").agg(F.count("*").alias("cells"), F.count_if("positive").alias("called_positive"))


@query("apply_forest")
def apply_forest(spark, sf):
    model, used = fitted(spark, sf)
    return rf.apply_forest(model, fx.feature_cells(spark, sf), used, ["image_id", "row_index"])


@query("save_model")
def save_model(spark, sf):
    model, used = fitted(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4()}"
    rf.save_model(model, path, "CD3+", used, training_cells(spark, sf).count(), spark)
    loaded, about = rf.load_model(path, spark)
    return rf.apply_forest(loaded, fx.feature_cells(spark, sf), about["feature_columns"], ["image_id", "row_index"])


@query("merge_automated_annotations", "actions", FOLDED + """, cur AS (SELECT image_id, cell_id, label, CASE WHEN CAST(cell_id AS BIGINT) % 3 = 0 THEN 'automated' ELSE 'manual' END AS source FROM folded),
fresh AS (SELECT image_id, cell_id, 'positive' AS label, 'automated' AS source FROM folded WHERE CAST(cell_id AS BIGINT) % 5 = 0)
SELECT * FROM cur WHERE source = 'manual' AND CAST(cell_id AS BIGINT) % 5 <> 0 UNION ALL SELECT * FROM fresh""")
def merge_automated_annotations(spark, sf):
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    cell = F.col("cell_id").cast("long")
    current = folded.withColumn("source", F.when(cell % 3 == 0, "automated").otherwise("manual"))
    new = folded.filter(cell % 5 == 0).select("image_id", "cell_id", F.lit("positive").alias("label"), F.lit("automated").alias("source"))
    return tr.merge_automated_annotations(current, new)
