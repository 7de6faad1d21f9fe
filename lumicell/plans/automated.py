"""Workflows that end in a model: training on annotated cells, and automated phenotyping.

Automated phenotyping calls all cells by threshold, takes manual annotations and fills up both classes from the calls, then fits,
scores and refines in three rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell import fixtures as fx
from lumicell.functions import values as v
from lumicell.functions.rank import checkpointed, shared_folder
from lumicell.operators import blocks as bk
from lumicell.operators import forest as rf
from lumicell.operators import training as tr
from lumicell.operators.schema import shared_numeric_features
from lumicell.plans.cell_queries import of, sized_images, threshold_calls, tiles
from lumicell.plans.registry import query

ORDER = ["ts", "event_id"]
#: Defaults of automated phenotyping: slider of the intensity threshold, least part of positive pixels.
SLIDER, CUTOFF = 660, 0.15


def train_model(cells: DataFrame, annotations: DataFrame, path: str, phenotype: str, trees: int = rf.TREES, depth: int = rf.DEPTH, seed: int = rf.SEED) -> tuple[rf.Forest, dict]:
    """Fit on annotated cells and save the model: ``(model, what is known of it)`` as read back from ``path``.

    ``cells(image_id, row_index, x, y, measurements…)``; annotations as ``training_rows`` takes them; those without a row are left out.
    """
    spark = cells.sparkSession
    features = shared_numeric_features(cells, ("image_id", "row_index", "x", "y"))
    if not features:
        raise ValueError("no shared numeric measurements")
    rows = checkpointed(cells.join(tr.training_rows(annotations, cells), ["image_id", "row_index"]))
    model, used = rf.fit_forest(rows, features, trees=trees, depth=depth, seed=seed)
    rf.save_model(model, path, phenotype, used, rows.count(), spark)
    return rf.load_model(path, spark)


def automated_phenotyping(
    cells: DataFrame, features: list[str], cutoff: float = CUTOFF, excluded: DataFrame | None = None, manual: DataFrame | None = None, limits: tuple[float, ...] = tr.ROUND_LIMITS,
    trees: int = rf.TREES, depth: int = rf.DEPTH, seed: int = tr.SEED, refine: int = tr.REFINE_CELLS, path: str | None = None, about: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(scores, training)`` for cells ``(image_index, row_index, positive_fraction, mean_intensity, features…)``.

    ``manual(image_index, row_index, label)`` are manual annotations: they train, are never drawn, and lower what is drawn of
    their class.  ``training`` has ``target`` and ``source``.  With ``path`` the last model is saved with its settings, ``about`` added.
    The cell table is kept in the shared folder; each round collects only pool sizes and fits on at most the drawn and manual rows.
    """
    cells = checkpointed(cells)
    model, used, training = automated_model(cells, features, cutoff, excluded, manual, limits, trees, depth, seed, refine, path, about)
    return checkpointed(scored(model, cells, used)), training


def scored(model: rf.Forest, cells: DataFrame, used: list[str]) -> DataFrame:
    return rf.apply_forest(model, cells, used, [*tr.CELL, "mean_intensity"]).withColumnRenamed("positive", "called_positive")


def automated_model(
    cells: DataFrame, features: list[str], cutoff: float = CUTOFF, excluded: DataFrame | None = None, manual: DataFrame | None = None, limits: tuple[float, ...] = tr.ROUND_LIMITS,
    trees: int = rf.TREES, depth: int = rf.DEPTH, seed: int = tr.SEED, refine: int = tr.REFINE_CELLS, path: str | None = None, about: dict | None = None,
) -> tuple[rf.Forest, list[str], DataFrame]:
    """The last model of ``automated_phenotyping``, its features and its training, before it scores the cells; ``cells`` should be kept, as each round reads them."""
    spark = cells.sparkSession
    if manual is None:
        manual = spark.createDataFrame([], "image_index long, row_index long, label string")
    manual = checkpointed(manual.select(*[F.col(c).cast("long").alias(c) for c in tr.CELL], "label"))
    quotas = tr.automated_quotas(manual.withColumn("source", F.lit("manual"))).first()
    own = manual.select(*tr.CELL)
    left_out = own if excluded is None else own.unionByName(excluded.select(*[F.col(c).cast("long").alias(c) for c in tr.CELL]))
    target = lambda df, positive, source: df.select(*[F.col(c).cast("long").alias(c) for c in tr.CELL], positive.cast("int").alias("target"), F.lit(source).alias("source"))
    chosen = tr.automated_training_selection(cells, cutoff, quotas["negative_low"], quotas["negative_mid"], quotas["positive"], left_out, seed)
    training = checkpointed(target(manual, F.col("label") == "positive", "manual").unionByName(target(chosen, F.col("pool") == "positive", "automated")))
    for stage in range(len(limits) + 1):
        model, used = rf.fit_forest(cells.join(training, tr.CELL), features, trees=trees, depth=depth, seed=seed)
        if stage == len(limits):
            break
        scores = checkpointed(scored(model, cells, used))
        known = left_out.unionByName(training.select(*tr.CELL))
        more = tr.refinement_selection(scores, limits[stage], refine, refine, known, tr.stage_seed(seed, stage + 1))
        training = checkpointed(training.unionByName(target(more, F.col("pool") == "positive", "automated")))
    if path is not None:
        settings = {
            "positive_pixel_fraction": cutoff, "negative_low_fluorescence_fraction": tr.LOW_SHARE, "negative_mid_fluorescence_range": [tr.LOW_SHARE + 0.01, tr.MID_SHARE], "top_positive_fraction": tr.TOP_SHARE,
            "refinement_max_call_probability": limits[0] if limits else None, "refinement_fluorescence_tail_fraction": tr.TAIL_SHARE, "refinement_positive_count": refine, "refinement_negative_count": refine,
            "second_refinement_max_call_probability": limits[1] if len(limits) > 1 else None, "second_refinement_positive_count": refine, "second_refinement_negative_count": refine, "random_seed": seed,
        }
        rf.save_model(model, path, (about or {}).get("phenotype", ""), used, training.count(), spark, settings | {k: x for k, x in (about or {}).items() if k != "phenotype"})
    return model, used, training


def measured_cells(spark, sf) -> tuple[DataFrame, list[str]]:
    """Cells with threshold calls at the default settings and the measurements of their label, but for the called channel."""
    stored = tiles(spark, sf)
    calls = checkpointed(threshold_calls(spark, sf, stored, CUTOFF, "all", SLIDER))
    measured = bk.measure_cells(of(stored, "dapi"), of(stored, "mask"), sized_images(spark, sf), ["dapi"], v.DEFAULT_PIXEL_SIZE_UM)
    own = measured.withColumnRenamed("Cell ID", "mask_label")
    return calls.join(own, ["image_id", "mask_label"]).withColumnRenamed("image_id", "image_index"), [c for c in own.columns if c not in ("image_id", "mask_label")]


@query("automated_phenotyping")
def automated(spark, sf):
    """Threshold calls, quotas after manual labels, pools, three fits; the last model is saved, read back, and gives the scores of the third round."""
    cells, measurements = measured_cells(spark, sf)
    cells = checkpointed(cells)
    features = [f for f in shared_numeric_features(cells.withColumnRenamed("image_index", "image_id"), ("image_id", "row_index")) if f in measurements]
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    manual = folded.filter(F.col("cell_id").cast("long") % 5 == 2).select(F.col("image_id").alias("image_index"), F.col("cell_id").cast("long").alias("row_index"), "label").join(cells.select(*tr.CELL), tr.CELL)
    excluded = tr.fold_exclusions(fx.actions(spark, sf), ORDER).withColumnRenamed("image_id", "image_index")
    path = f"{shared_folder(spark)}/model-{uuid.uuid4()}"
    about = {"phenotype": "marker+", "channel_name": "marker", "compartment": "all", "inward_buffer_pixels": v.DEFAULT_BUFFER_PX}
    automated_model(cells, features, CUTOFF, excluded, manual, path=path, about=about)
    model, known = rf.load_model(path, spark)
    scores = rf.apply_forest(model, cells, known["feature_columns"], tr.CELL)
    return scores.select(*tr.CELL, F.col("positive").alias("called_positive"), F.round("positive_probability", 6).alias("positive_probability"))


@query("train_model")
def trained(spark, sf):
    """Annotations from the action log, their rows, a forest, its saved bundle, and the calls of the model read back."""
    cells = checkpointed(fx.feature_cells(spark, sf).drop("target").withColumnsRenamed({"Centroid X px": "x"}).withColumn("y", F.col("row_index") * 20.0))
    folded = tr.fold_annotations(fx.actions(spark, sf), ORDER)
    nowhere = F.lit(-1e7)
    asked = folded.select("image_id", F.concat_ws("/", F.col("image_id").cast("string"), "cell_id").alias("point_id"), "cell_id", "label", nowhere.alias("centroid_x"), nowhere.alias("centroid_y"), F.col("cell_id").cast("long").alias("row_index"))
    model, about = train_model(cells, asked, f"{shared_folder(spark)}/model-{uuid.uuid4()}", "CD3+")
    return rf.apply_forest(model, cells, about["feature_columns"], ["image_id", "row_index"])
