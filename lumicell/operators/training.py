"""Annotation state, training rows, pools and selections for automated training."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import distributed_rank
from lumicell.functions.values import finite
from lumicell.operators.match import find_cell_row

CLASS_CELLS, LOW_CELLS, REFINE_CELLS, SEED = 25, 15, 5, 42
LOW_SHARE, MID_SHARE, TOP_SHARE, TAIL_SHARE = 0.5, 0.8, 0.3, 0.1
ROUND_LIMITS = (0.60, 0.55)
CELL = ["image_index", "row_index"]


def fold_annotations(actions: DataFrame, order: list[str]) -> DataFrame:
    """``image_id, cell_id, label``: the last action on each cell, unless that excludes it; cancelled ones do nothing."""
    done = actions.filter("action <> 'cancel'")
    last = done.groupBy("image_id", "cell_id").agg(F.max_by("action", F.struct(*order)).alias("label"))
    return last.filter("label <> 'exclude'")


def fold_exclusions(actions: DataFrame, order: list[str]) -> DataFrame:
    """``image_id, row_index`` of rows whose last action is an exclusion made in automated mode; supervised exclusions do not count."""
    done = actions.filter("action in ('positive', 'negative') or (action = 'exclude' and mode = 'automated')").filter("row_index is not null")
    return done.groupBy("image_id", "row_index").agg(F.max_by("action", F.struct(*order)).alias("last")).filter("last = 'exclude'").drop("last")


def training_annotations(annotations: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Annotations of one label with their 0-based place over all images."""
    return distributed_rank(annotations.filter(F.col("label") == label), order, "place")


def annotation_at(annotations: DataFrame, n: int, total: int) -> DataFrame:
    """The n-th annotation, counted cyclically."""
    return annotations.filter(F.col("place") == (n % total if total else -1))


def training_rows(annotations: DataFrame, cells: DataFrame) -> DataFrame:
    """``image_id, row_index, target`` of annotations that belong to a row; others are left out."""
    found = find_cell_row(annotations, cells).filter("found_row is not null")
    return found.select("image_id", F.col("found_row").alias("row_index"), (F.col("label") == "positive").cast("int").alias("target"))


def automated_quotas(manual: DataFrame) -> DataFrame:
    """``positive, negative_low, negative_mid`` still needed, from manual annotations ``(label, source)``."""
    own = F.col("source") == "manual"
    have = manual.agg(F.count_if(own & (F.col("label") == "positive")).alias("p"), F.count_if(own & (F.col("label") == "negative")).alias("n"))
    need = lambda c: F.greatest(CLASS_CELLS - F.col(c), F.lit(0))
    low = F.least(F.rint(need("n") * LOW_CELLS / CLASS_CELLS).cast("long"), F.lit(LOW_CELLS))
    return have.select(need("p").alias("positive"), low.alias("negative_low"), (need("n") - low).alias("negative_mid"))


def _keep(pool: DataFrame, excluded: DataFrame | None) -> DataFrame:
    return pool if excluded is None else pool.join(excluded.select(*CELL), CELL, "left_anti")


def _placed(ranked: DataFrame, pool: Column) -> DataFrame:
    """``pool, place, image_index, row_index``: places from 0 within each pool, in the order of ``rank``, from one more pass over the ranked rows."""
    named = ranked.withColumn("pool", pool).filter("pool is not null")
    again = distributed_rank(named.select("pool", "rank", *CELL), ["pool", "rank"], "place")
    first = again.groupBy("pool").agg(F.min("place").alias("first"))  # three pools at most
    return again.join(F.broadcast(first), "pool").select("pool", (F.col("place") - F.col("first")).alias("place"), *CELL)


def automated_training_pools(cells: DataFrame, cutoff: float, excluded: DataFrame | None = None) -> DataFrame:
    """Pools ``(pool, place, image_index, row_index)`` named low, mid and positive.

    Negatives by rising fluorescence: the first half is low, up to four fifths mid.  Positives by falling fraction: the
    top three tenths; equal fractions by falling cell order.  The bounds count excluded cells, which then leave the pools.
    Both classes are ranked in one range sort.
    """
    if not 0 <= cutoff <= 1:
        raise ValueError("the cut-off must be from 0 to 1")
    fraction, light = F.col("positive_fraction"), F.col("mean_intensity")
    top = fraction > cutoff
    known = cells.filter(finite(fraction) & (top | finite(light))).select(*CELL, top.alias("top"), F.when(top, -fraction).otherwise(light).cast("double").alias("by"), *[F.when(top, -F.col(c)).otherwise(F.col(c)).alias(f"by_{c}") for c in CELL])
    ranked = distributed_rank(known, ["top", "by", *[f"by_{c}" for c in CELL]])
    counts = {r["top"]: r["count"] for r in ranked.groupBy("top").count().collect()}
    negative, positive = counts.get(False, 0), counts.get(True, 0)
    low, mid, most = math.ceil(negative * LOW_SHARE), math.ceil(negative * MID_SHARE), negative + math.ceil(positive * TOP_SHARE)
    rank = F.col("rank")  # negatives come first
    pool = F.when(rank < low, "low").when(rank < mid, "mid").when((rank >= negative) & (rank < most), "positive")
    return _placed(_keep(ranked, excluded), pool)


def refinement_pools(cells: DataFrame, limit: float, excluded: DataFrame | None = None) -> DataFrame:
    """Pools of cells called with little confidence: bright negatives to become positive, dim positives to become negative."""
    if not 0.5 < limit <= 1:
        raise ValueError("the limit must be above 0.5 and at most 1")
    p, light, called = F.col("positive_probability"), F.col("mean_intensity"), F.col("called_positive")
    valid = _keep(cells.filter(finite(p) & finite(light) & (p >= 0) & (p <= 1)), excluded)
    unsure = valid.filter(F.when(called, p).otherwise(1 - p) < limit).select(*CELL, called.alias("called"), light.cast("double").alias("light"))
    ranked = distributed_rank(unsure, ["called", "light", *CELL])
    counts = {r["called"]: r["count"] for r in ranked.groupBy("called").count().collect()}
    negative, positive = counts.get(False, 0), counts.get(True, 0)
    rank = F.col("rank")  # cells called negative come first
    bright = (rank >= negative - math.ceil(negative * TAIL_SHARE)) & (rank < negative)
    return _placed(ranked, F.when(bright, "positive").when((rank >= negative) & (rank < negative + math.ceil(positive * TAIL_SHARE)), "negative"))


def draw(pools: DataFrame, wanted: dict[str, int], seed: int | None) -> DataFrame:
    """Rows of the pools at places drawn without replacement by one generator, pool by pool in the order of ``wanted``."""
    random = np.random.default_rng(seed)
    sizes = {r["pool"]: r["count"] for r in pools.groupBy("pool").count().collect()}
    chosen = F.lit(False)
    for name, k in wanted.items():
        size = sizes.get(name, 0)
        if size < k:
            raise ValueError(f"pool {name} needs {k} cells but has {size}")
        if k:
            chosen = chosen | ((F.col("pool") == name) & F.col("place").isin([int(i) for i in random.choice(size, size=k, replace=False)]))
    return pools.filter(chosen)


def automated_training_selection(cells: DataFrame, cutoff: float, low: int = LOW_CELLS, mid: int = CLASS_CELLS - LOW_CELLS, positive: int = CLASS_CELLS, excluded: DataFrame | None = None, seed: int | None = SEED) -> DataFrame:
    pools = automated_training_pools(cells, cutoff, excluded)
    return draw(pools, {"low": low, "mid": mid, "positive": positive}, seed)


def refinement_selection(cells: DataFrame, limit: float, positive: int = REFINE_CELLS, negative: int = REFINE_CELLS, excluded: DataFrame | None = None, seed: int | None = SEED) -> DataFrame:
    return draw(refinement_pools(cells, limit, excluded), {"positive": positive, "negative": negative}, seed)


def stage_seed(base, stage):
    """The seed of a stage, a number or a column: base plus stage, modulo 2^32."""
    if isinstance(base, Column) or isinstance(stage, Column):
        return F.pmod(base + stage, F.lit(1 << 32))
    if isinstance(stage, bool) or not isinstance(stage, int) or stage < 0:
        raise ValueError("a stage is a whole number, not negative")
    return None if base is None else (base + stage) % (1 << 32)


def merge_automated_annotations(current: DataFrame, new: DataFrame, reset: bool = False) -> DataFrame:
    """Annotations after an automated run: old automated ones go, manual ones stay, new ones win by cell."""
    if reset:
        return new
    kept = current.filter("source <> 'automated'").join(new.select("image_id", "cell_id"), ["image_id", "cell_id"], "left_anti")
    return kept.unionByName(new)

