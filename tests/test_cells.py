"""Matching, statistics, schemas, training sets, models and files on small hand-made tables."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumicell.functions.rank import distributed_rank
from lumicell.operators import aggregate as agg
from lumicell.operators import forest as rf
from lumicell.operators import match as mt
from lumicell.operators import schema as sc
from lumicell.operators import training as tr
from lumicell.plans.automated import automated_model, automated_phenotyping
from lumicell.sources import cells as cs
from lumicell.sources import metadata as md
from lumicell.sources import projects as pj
from lumicell.sources import tiles as tl
from tests.test_raster import INF, NAN, mask, pixels, touching


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "image_id long, row_index long, x double, y double" + extra)


def test_each_level_of_the_cascade(spark):
    rows = [
        (0, 0, 1e6, 1.0, 3.0, None), (0, 1, 3.2, 4.4, -1.0, "2.5"), (0, 2, 1e6, NAN, 1.5, "x"), (0, 3, 1e6, 1e6, 0.0, "2"), (0, 4, 18.0, 5.0, 77.0, None), (0, 5, NAN, 1.0, 4.00000001, None),
    ]
    cells = table(spark, rows, ", `cell_ID` double, `Object Id` string")
    found = {r["row_index"]: (r["mask_label"], r["matched_by"]) for r in mt.map_cells_to_labels(cells, mask(spark, touching())).collect()}
    assert found == {0: (3, "identifier"), 1: (1, "centroid"), 2: (3, "sequence"), 3: (2, "identifier"), 4: (2, "nearest"), 5: (4, "identifier")}
    with pytest.raises(PySparkException):
        mt.map_cells_to_labels(table(spark, [(0, 9, 1e6, 1e6)]), mask(spark, touching())).collect()
    assert mt.map_cells_to_labels(table(spark, [(0, 9, 1e6, 1e6)]), mask(spark, touching()), strict=False).first()["mask_label"] is None


def test_nearest_label_in_a_square(spark):
    grid = np.zeros((200, 200), int)
    grid[100, 100], grid[100, 110], grid[20, 20] = 5, 6, 7
    cells = table(spark, [(0, 0, 105.0, 100.0), (0, 1, 105.4, 100.0), (0, 2, 175.0, 175.0), (0, 3, 176.0, 100.0), (0, 4, 186.0, 100.0)])
    found = {r["row_index"]: r["by_nearest"] for r in mt.match_nearest_label(cells, mask(spark, grid)).collect()}
    assert found == {0: 5, 1: 6, 2: 6, 3: 6}  # a tie goes to the first pixel; the corner of the square counts


def test_find_cell_row(spark):
    cells = table(spark, [(0, 0, 10.0, 10.0), (0, 1, 20.0, 10.0), (0, 2, NAN, 0.0)])
    asked = spark.createDataFrame(
        [(1, 0, "9", 0.0, 0.0, 2), (2, 0, "9", 15.0, 10.0, -1), (3, 0, "3", 900.0, 0.0, None), (4, 0, "4", 900.0, 0.0, 7), (5, 0, "x", 900.0, 0.0, None), (6, 0, "2.0", 10.0, 85.0, None), (7, 0, "1", 10.0, 85.1, None)],
        "point_id long, image_id long, cell_id string, centroid_x double, centroid_y double, row_index long",
    )
    found = {r["point_id"]: r["found_row"] for r in mt.find_cell_row(asked, cells).collect()}
    assert found == {1: 2, 2: 0, 3: 2, 4: None, 5: None, 6: 0, 7: 0}


def test_statistics_keep_bad_pixels_in_the_denominator(spark):
    grid = np.array([[1, 1, 1, 1, 2]])
    own = pixels(spark, np.array([[10.0, NAN, INF, 1.0, NAN]]))
    limit = spark.createDataFrame([(0, 5.0)], "image_id long, threshold double")
    stats = agg.pixel_statistics_by_label(own, mask(spark, grid), limit)
    found = {r["label"]: tuple(r)[2:] for r in stats.collect()}
    assert found == {1: (4, 4, 2, 2, 11.0), 2: (1, 1, 0, 0, None)}
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 9)], "image_id long, row_index long, mask_label long")
    calls = {r["row_index"]: (r["denominator_pixels"], r["mean_intensity"], r["positive_fraction"], r["positive"]) for r in agg.threshold_calls(agg.cell_statistics(stats, rows), 0.5).collect()}
    assert calls == {0: (4, 5.5, 0.5, False), 1: (1, None, 0.0, False), 2: (0, None, 0.0, False)}
    assert {r["row_index"] for r in agg.threshold_calls(agg.cell_statistics(stats, rows), 0.49).filter("positive").collect()} == {0}
    with pytest.raises(ValueError):
        agg.threshold_calls(rows, 1.5)


def test_morphology(spark):
    grid = np.zeros((12, 12), int)
    grid[1:5, 1:7] = 1
    grid[8, 8] = 2
    grid[6:10, 1] = grid[9, 1:5] = 3  # an L
    own = mask(spark, grid)
    basic = {r["label"]: r for r in agg.morphology_basic(own).collect()}
    assert (basic[1]["area"], basic[1]["cy"], basic[1]["x_max"], basic[1]["extent"]) == (24, 2.5, 7, 1.0)
    ellipse = {r["label"]: r for r in agg.morphology_ellipse(own).collect()}
    assert math.isclose(ellipse[1]["major_axis"], 4 * math.sqrt(35 / 12)) and ellipse[2]["eccentricity"] == 0 and ellipse[2]["major_axis"] == 0
    perimeter = {r["label"]: r["perimeter"] for r in agg.morphology_perimeter(own).collect()}
    assert perimeter[1] == 16.0 and perimeter[2] == 0.0  # a rectangle's border pixels
    assert {r["label"]: r["perimeter"] for r in agg.morphology_perimeter(own, 3).collect()} == perimeter
    solidity = {r["label"]: r["solidity"] for r in agg.morphology_solidity(own).collect()}
    assert solidity[1] == 1.0 and solidity[2] == 1.0 and 0.5 < solidity[3] < 1


def test_histogram(spark):
    rows = spark.createDataFrame([(0, x) for x in (0.0, 1.0, 29.9, 30.0, NAN)] + [(1, 5.0)], "image_id long, v double")
    found = {(r["image_id"], r["bin"]): r["n"] for r in agg.histogram(rows, "v").collect()}
    assert len(found) == 60 and found[0, 0] == 1 and found[0, 1] == 1 and found[0, 29] == 2 and sum(n for (i, _), n in found.items() if i == 1) == 1
    assert np.histogram([5.0], 30, (4.5, 5.5))[0].tolist() == [found[1, b] for b in range(30)]
    fixed = agg.histogram(rows, "v", F.lit(1.0), F.lit(20.0))
    assert fixed.agg(F.sum("n")).first()[0] == 2


def test_schema_rules():
    assert sc.centroid_columns(["a", "Centroid X px", "Centroid X µm", "nucleus_center-y"]) == ("Centroid X µm", "nucleus_center-y")
    with pytest.raises(ValueError):
        sc.centroid_columns(["Centroid X"])
    assert [sc.is_feature(n) for n in ("Steroid", "Area px", "Bounding_Box", "Y-Max", "Label Id")] == [False, True, False, False, False]
    assert [sc.unique_column("Label", t, "Export") for t in (set(), {"Label"}, {"Label", "Export Label"})] == ["Label", "Export Label", "Export Label 2"]
    assert mt.identifier_columns(["x", "Cell_ID", "objectid", "LABEL-id ", "id"]) == ["Cell_ID", "objectid", "LABEL-id "]
    assert cs.unique_stems(["a/Slide.tif", "b/slide.tif", "SLIDE.qptiff", "other"]) == ["Slide", "slide_2", "SLIDE_3", "other"]
    assert cs.export_name("CD3+ T cell") == "CD3__T_cell_cells.tsv"


def test_channel_labels(spark):
    rows = spark.createDataFrame([(0, 0, " CD3 "), (0, 1, ""), (0, 2, "CD3"), (0, 3, None)], "image_id long, channel_index long, name string")
    assert [r["label"] for r in sc.safe_channel_labels(rows).orderBy("channel_index").collect()] == ["CD3", "Channel 2", "CD3 (2)", "Channel 4"]
    with pytest.raises(PySparkException):
        sc.safe_channel_labels(rows.union(spark.createDataFrame([(0, 4, "CD3 (2)")], rows.schema))).collect()


def test_phenotype_table(spark):
    one = spark.createDataFrame([(0, "1", 2.0), (1, "2", 3.0)], "row_index long, `Label Source` string, b double")
    two = spark.createDataFrame([(0, 5)], "row_index long, c int")
    calls = spark.createDataFrame([("s1", 0, True), ("s1", 1, False), ("s2", 0, True)], "image_name string, row_index long, positive boolean")
    trained = spark.createDataFrame([("s2", 0, "positive", 1), ("s2", 0, "negative", 2)], "image_name string, row_index long, label string, order int")
    found = sc.phenotype_table([one.withColumn("image_name", F.lit("s1")), two.withColumn("image_name", F.lit("s2"))], calls, "CD3", "Model", trained)
    assert found.columns == ["Image Name", "Cell Row", "Label Source", "b", "c", "CD3 Label", "Export Label Source"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("s1", 1, "1", "2.0", None, "Positive", "Model"), ("s1", 2, "2", "3.0", None, "Negative", "Model"), ("s2", 1, None, None, "5", "Negative", "Manual Training")], key=str)
    with pytest.raises(PySparkException):
        sc.phenotype_table([one.withColumn("image_name", F.lit("s1")), two.withColumn("image_name", F.lit("s2"))], calls.limit(2), "CD3", "Model").collect()


def test_rank(spark):
    rows = spark.createDataFrame([(int(i),) for i in np.random.default_rng(0).permutation(500)], "a long")
    assert all(r["a"] == r["rank"] for r in distributed_rank(rows, ["a"]).collect())
    assert all(r["a"] == 499 - r["rank"] for r in distributed_rank(rows, [F.desc("a")]).collect())
    assert distributed_rank(rows.limit(0), ["a"]).count() == 0


def scored(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(i % 3, i // 3, float(rng.integers(0, 11)) / 10, float(rng.integers(0, 40)), bool(rng.random() < 0.5), float(rng.random())) for i in range(n)]
    rows += [(0, 900, NAN, 1.0, True, 0.5), (0, 901, 0.9, NAN, True, 0.55), (0, 902, 0.1, INF, False, NAN)]
    return rows, spark.createDataFrame(rows, "image_index long, row_index long, positive_fraction double, mean_intensity double, called_positive boolean, positive_probability double")


def test_pools_and_draws_equal_numpy(spark):
    rows, cells = scored(spark)
    rows.sort(key=lambda r: r[:2])
    fraction, light = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    out = {(0, 5), (1, 7), (2, 11)}
    gone = np.array([r[:2] in out for r in rows])
    negative = np.flatnonzero(np.isfinite(fraction) & np.isfinite(light) & (fraction <= 0.4))
    order = negative[np.argsort(light[negative], kind="stable")]
    low, mid = order[: math.ceil(len(order) * 0.5)], order[math.ceil(len(order) * 0.5) : math.ceil(len(order) * 0.8)]
    positive = np.flatnonzero(np.isfinite(fraction) & (fraction > 0.4))
    top = positive[np.argsort(fraction[positive], kind="stable")[::-1]][: math.ceil(len(positive) * 0.3)]
    pools = {"low": low[~gone[low]], "mid": mid[~gone[mid]], "positive": top[~gone[top]]}
    excluded = spark.createDataFrame(list(out), "image_index long, row_index long")
    found = tr.automated_training_pools(cells, 0.4, excluded).collect()
    for name, pool in pools.items():
        own = sorted((r["place"], r["image_index"], r["row_index"]) for r in found if r["pool"] == name)
        assert own == [(place, *rows[i][:2]) for place, i in enumerate(pool)]
    rng = np.random.default_rng(42)
    want = {(n, *rows[i][:2]) for n, k in (("low", 15), ("mid", 10), ("positive", 25)) for i in rng.choice(pools[n], size=k, replace=False)}
    assert {(r["pool"], r["image_index"], r["row_index"]) for r in tr.automated_training_selection(cells, 0.4, excluded=excluded).collect()} == want
    with pytest.raises(ValueError):
        tr.automated_training_selection(cells, 0.99).collect()


def test_refinement_equals_numpy(spark):
    rows, cells = scored(spark)
    rows.sort(key=lambda r: r[:2])
    light, called, p = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    sure = np.where(called, p, 1 - p)
    valid = np.isfinite(p) & np.isfinite(light) & (sure < 0.7)
    negative, positive = np.flatnonzero(valid & ~called), np.flatnonzero(valid & called)
    high = negative[np.argsort(light[negative], kind="stable")][-math.ceil(len(negative) * 0.1) :]
    low = positive[np.argsort(light[positive], kind="stable")][: math.ceil(len(positive) * 0.1)]
    rng = np.random.default_rng(43)
    want = {(n, *rows[i][:2]) for n, pool in (("positive", high), ("negative", low)) for i in rng.choice(pool, size=5, replace=False)}
    found = tr.refinement_selection(cells, 0.7, seed=tr.stage_seed(42, 1)).collect()
    assert {(r["pool"], r["image_index"], r["row_index"]) for r in found} == want
    with pytest.raises(ValueError):
        tr.refinement_pools(cells, 0.5)


def test_stage_seed():
    assert tr.stage_seed((1 << 32) - 1, 2) == 1 and tr.stage_seed(None, 1) is None
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            tr.stage_seed(1, bad)


def test_folding(spark):
    rows = [(0, "a", 0, "positive", "supervised", 1), (0, "a", 0, "exclude", "supervised", 2), (0, "a", 0, "cancel", "supervised", 3), (0, "b", 1, "exclude", "automated", 1), (0, "b", 1, "exclude", "supervised", 5),
            (0, "c", None, "exclude", "automated", 1), (0, "d", 3, "exclude", "automated", 1), (0, "d", 3, "negative", "automated", 2)]
    actions = spark.createDataFrame(rows, "image_id long, cell_id string, row_index long, action string, mode string, ts long")
    assert {(r["cell_id"], r["label"]) for r in tr.fold_annotations(actions, ["ts"]).collect()} == {("d", "negative")}
    assert {r["row_index"] for r in tr.fold_exclusions(actions, ["ts"]).collect()} == {1}


def test_quotas_and_merge(spark):
    manual = spark.createDataFrame([("positive", "manual")] * 30 + [("negative", "manual")] * 3 + [("negative", "automated")] * 9, "label string, source string")
    assert tuple(tr.automated_quotas(manual).first()) == (0, 13, 9)
    current = spark.createDataFrame([(0, "a", "manual"), (0, "b", "automated"), (0, "c", "manual")], "image_id long, cell_id string, source string")
    new = spark.createDataFrame([(0, "c", "automated"), (0, "d", "automated")], current.schema)
    assert {tuple(r)[1:] for r in tr.merge_automated_annotations(current, new).collect()} == {("a", "manual"), ("c", "automated"), ("d", "automated")}
    assert tr.merge_automated_annotations(current, new, reset=True).count() == 2


def feature_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i // 2, i % 4 == 0, float(rng.normal(4 if i % 4 == 0 else 0)), "n/a" if i % 9 == 0 else str(float(rng.normal())), 1.0) for i in range(240)]
    return spark.createDataFrame([(a, b, d, e, f, int(c)) for a, b, c, d, e, f in rows], "image_id long, row_index long, `A: Cell Mean` double, B string, C double, target int")


def test_forest(spark, tmp_path):
    cells = feature_rows(spark)
    features = sc.shared_numeric_features(cells.drop("target"))
    assert features == ["A: Cell Mean", "B", "C"]
    model, used = rf.fit_forest(cells.filter("row_index < 60"), features, trees=20, depth=6)
    assert used == ["A: Cell Mean", "B"]
    keep = ["image_id", "row_index", "target"]
    found = rf.apply_forest(model, cells, used, keep).collect()
    assert np.mean([r["positive"] == bool(r["target"]) for r in found]) > 0.93 and all(0 <= r["positive_probability"] <= 1 for r in found)
    again = rf.apply_forest(model, cells.repartition(8), used, keep).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    rf.save_model(model, str(tmp_path / "m"), "P", used, 120, spark)
    loaded, about = rf.load_model(str(tmp_path / "m"), spark)
    assert about["feature_columns"] == used and sorted(map(tuple, rf.apply_forest(loaded, cells, used, keep).collect())) == sorted(map(tuple, found))
    spark.createDataFrame([(json.dumps(about | {"version": 2}),)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "m/about"))
    for bad in (lambda: rf.load_model(str(tmp_path / "m"), spark), lambda: rf.fit_forest(cells.filter("target = 1"), features), lambda: rf.apply_forest(model, cells.drop("B"), used, keep), lambda: sc.usable_features(cells, ["C"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException):
        rf.apply_forest(model, cells.withColumn("B", F.lit(INF)), used, keep).collect()


def test_a_forest_is_a_table_and_large_trees_grow_in_parts(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 3))
    target = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, target))]
    cells = spark.createDataFrame(rows + rows[:300], "row_index long, A double, B double, C double, target int")
    train, rest = cells.filter("row_index < 900"), cells.filter("row_index >= 900")
    whole, used = rf.fit_forest(train, ["A", "B", "C"], trees=12)
    parts, _ = rf.fit_forest(train.repartition(7), ["A", "B", "C"], trees=12, most=150)
    assert whole.trees.count() == whole.count == parts.count == 12 and whole.size % rf.NODE.itemsize == 0 and not whole.tops
    assert parts.trees.groupBy("tree").count().filter("count > 2").count() == 12 and set(parts.tops) == set(range(12))
    again, _ = rf.fit_forest(train.repartition(2), ["A", "B", "C"], trees=12, most=150)
    assert {tuple(r) for r in parts.trees.collect()} == {tuple(r) for r in again.trees.collect()} and again.tops == parts.tops
    rf.save_model(parts, str(tmp_path / "m"), "P", used, 900, spark)
    loaded, _ = rf.load_model(str(tmp_path / "m"), spark)
    for model in (whole, parts, loaded):
        right = lambda df: np.mean([r["positive"] == bool(r["target"]) for r in rf.apply_forest(model, df, used, ["target"]).collect()])  # noqa: B023, E731
        assert right(rest) > 0.9
    assert right(train) > 0.97


def test_a_tree_is_grown_until_its_leaves_are_pure():
    rng = np.random.default_rng(6)
    x, y, w = rng.integers(0, 50, (500, 4)).astype(float), rng.integers(0, 2, 500).astype(float), rng.integers(1, 4, 500).astype(float)
    nodes = rf.grow(x, y, w, 30, 2, rng)
    leaf = nodes[rf._below(nodes, x)]
    mixed = {tuple(v) for v, t in zip(x, y) if t} & {tuple(v) for v, t in zip(x, y) if not t}
    assert all(value == t for value, t, v in zip(leaf["value"], y, x) if tuple(v) not in mixed)
    assert (rf.grow(x, y, w, 0, 2, rng)["value"] == [np.average(y, weights=w)]).all()


def test_rows_go_down_a_tree_together():
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 40, (600, 3)).astype(float), rng.integers(0, 2, 600).astype(float)
    nodes = rf.grow(x, y, np.ones(600), 30, 2, rng)
    rows = np.concatenate([x, rng.normal(20, 30, (2 * rf.WALK_ROWS + 5, 3)), [[-INF, INF, 0.0]]])

    def end(row, at=0):
        n = nodes[at]
        return at if n["feature"] < 0 else end(row, n["left"] + int(row[n["feature"]] > n["threshold"]))

    some = np.r_[0:600, rf.WALK_ROWS - 3 : rf.WALK_ROWS + 3, len(rows) - 9 : len(rows)]
    assert [end(rows[i]) for i in some] == rf._below(nodes, rows)[some].tolist() and not rf._below(nodes[:0:-1][:1], rows).any()


def test_equal_cells_go_down_a_tree_once(spark):
    grid = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [3.0, 5.0]])
    rows, place = rf._different(grid, np.array([7, 5, 7, 6]))
    assert len(rows) == 3 and (rows[place] == grid).all()
    rows, place = rf._different(grid, np.array([7, 5, 7, 5]))  # one hash for different rows
    assert (rows[place] == grid).all() and len(rf._different(grid[:0], np.empty(0, np.int64))[0]) == 0
    cells = spark.range(400).select(F.col("id").alias("row_index"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("double").alias("A"), (F.col("id") % 3).cast("double").alias("B"), (F.col("id") % 5 > 2).cast("int").alias("target"))
    model, used = rf.fit_forest(cells, ["A", "B"], trees=15)
    copies = {(r["row_index"] % 15, r["positive_probability"]) for r in rf.apply_forest(model, cells, used, ["row_index"]).collect()}
    alone = {(r["row_index"], r["positive_probability"]) for i in range(3) for r in rf.apply_forest(model, cells.filter(F.col("row_index").between(5 * i, 5 * i + 4)), used, ["row_index"]).collect()}
    assert copies == alone


@pytest.mark.parametrize("cells,size", [(0, 1 << 10), (1, 1 << 10), (126_000, 4 << 20), (7_560_000, 200 << 20)])
def test_cells_and_trees_make_pairs_for_every_core(cells, size):
    blocks, groups = rf._pairs(cells, 13, rf.Forest(None, 300, size, []), 48)
    assert blocks * groups >= 48 and groups <= 300 and cells * 13 / blocks <= rf.MOST_VALUES and size / groups <= rf.TREE_BYTES
    assert blocks * groups < 400


def test_the_pairs_of_a_forest_are_tasks_of_their_own(spark):
    cells = spark.range(200).select(F.col("id").alias("row_index"), (F.col("id") % 17).cast("double").alias("A"), (F.col("id") % 17 > 8).cast("int").alias("target"))
    model, used = rf.fit_forest(cells, ["A"], trees=20)
    found = rf.apply_forest(model, cells, used, ["row_index", "target"])
    plan = found._jdf.queryExecution().toString()
    asked = rf._pairs(200, 1, model, rf.PAIRS * 4)
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(block" in plan and f", {asked[0] * asked[1]})" in plan
    assert all(r["positive"] == bool(r["target"]) for r in found.collect())


def test_hulls_of_many_labels_are_counted_together(monkeypatch):
    rng, labels = np.random.default_rng(7), []
    for i in range(300):
        rows = rng.integers(0, 30, rng.integers(1, 25)) + 7 * i if i % 2 else np.arange(1 + i % 40)  # with gaps, and rows of several tiles
        left = rng.integers(-20, 20, len(rows)) + 1000 * i
        labels.append((rows, left, left + rng.integers(0, 9, len(rows))))
    tall = (np.arange(agg.HULL_ROWS + 1), np.zeros(agg.HULL_ROWS + 1, int), np.full(agg.HULL_ROWS + 1, 4))
    wanted = [agg.hull_pixels(*label) for label in (*labels, tall)]
    together = lambda some: agg.hulls_pixels(*(np.concatenate(v) for v in zip(*some)), np.cumsum([len(label[0]) for label in some])).tolist()
    assert together([*labels, tall]) == wanted
    monkeypatch.setattr(agg, "HULL_VALUES", 700)
    monkeypatch.setattr(agg, "hull_pixels", None)  # labels of a cell's height are not worked on one by one
    assert together(labels) == wanted[:-1]


def test_an_automated_model_scores_between_its_fits_only(spark, monkeypatch):
    cells = spark.range(300).select((F.col("id") % 2).alias("image_index"), F.floor(F.col("id") / 2).alias("row_index"), F.when(F.col("id") % 3 == 0, 0.8).otherwise(0.1).alias("positive_fraction"), (F.col("id") % 50).cast("double").alias("mean_intensity"), (F.col("id") % 3 + F.col("id") % 7).cast("double").alias("A"))
    seen, apply = [], rf.apply_forest
    monkeypatch.setattr(rf, "apply_forest", lambda *a: seen.append(1) or apply(*a))
    model, used, training = automated_model(cells, ["A"], 0.35, limits=(0.95,), trees=5, refine=0)
    assert len(seen) == 1 and used == ["A"] and model.count == 5 and training.count() == 50
    scores, same = automated_phenotyping(cells, ["A"], 0.35, limits=(0.95,), trees=5, refine=0)
    assert len(seen) == 3 and scores.count() == 300 and same.exceptAll(training).count() == 0


def test_automated_phenotyping(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        high = i % 3 == 0
        rows.append((i % 2, i // 2, float(np.clip(rng.normal(0.6 if high else 0.1, 0.1), 0, 1)), float(rng.normal(100 if high else 50, 20)), float(rng.normal(3 if high else 0, 1.6)), float(rng.normal())))
    cells = spark.createDataFrame(rows, "image_index long, row_index long, positive_fraction double, mean_intensity double, A double, B double")
    manual = spark.createDataFrame([(0, 0, "positive"), (1, 1, "positive"), (0, 1, "negative")], "image_index long, row_index long, label string")
    scores, training = automated_phenotyping(cells, ["A", "B"], 0.35, manual=manual, limits=(0.75, 0.75), trees=15, depth=5, refine=1, path=str(tmp_path / "m"), about={"phenotype": "P", "channel_name": "A"})
    assert {(r["image_index"], r["row_index"], r["target"]) for r in training.filter("source = 'manual'").collect()} == {(0, 0, 1), (1, 1, 1), (0, 1, 0)}
    assert training.select("image_index", "row_index").distinct().count() == 54 and training.filter("source = 'automated' and target = 1").count() == 25
    _, about = rf.load_model(str(tmp_path / "m"), spark)
    assert about["training_samples"] == 54 and about["automated"]["channel_name"] == "A" and about["automated"]["refinement_positive_count"] == 1 and about["automated"]["random_seed"] == 42
    assert training.count() == 54 and training.groupBy("target").count().count() == 2 and scores.count() == 900
    right = [r["called_positive"] == ((2 * r["row_index"] + r["image_index"]) % 3 == 0) for r in scores.collect()]
    assert np.mean(right) > 0.75


def test_cell_table_order(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Cell ID,v\n" + "".join(f"{i},{i * 0.5}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = cs.read_cell_table(spark, str(path), 7)
        assert found.columns == ["image_id", "row_index", "Cell ID", "v"] and found.rdd.getNumPartitions() >= 1
        assert all(r["row_index"] == r["Cell ID"] and r["image_id"] == 7 for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text("Cell ID,v\n")
    with pytest.raises(ValueError):
        cs.read_cell_table(spark, str(path))


@pytest.mark.parametrize("names,rank,axes", [(None, 2, ["y", "x"]), (None, 5, ["t", "c", "z", "y", "x"]), ([" Y", "X "], 2, ["y", "x"])])
def test_axes(names, rank, axes):
    assert md.axes_of(names, rank) == axes


def test_axes_errors():
    for names, rank in ((["c", "y"], 2), (None, 7)):
        with pytest.raises(ValueError):
            md.axes_of(names, rank)


def test_tables_of_several_images_are_read_in_file_order(spark, tmp_path):
    paths = {}
    for i, columns in ((3, ["a", "b"]), (5, ["a", "c"]), (9, ["a", "b"])):
        paths[i] = str(tmp_path / f"image {i} + %41.csv")
        rows = spark.range(400).select(*[(F.col("id") * 10 + i).alias(c) for c in columns]).repartitionByRange(4, "a").sortWithinPartitions("a")
        cs.write_table(rows, paths[i], ",")
    found = cs.read_cell_tables(spark, paths)
    assert found.columns == ["image_id", "row_index", "a", "b", "c"] and found.count() == 1200
    assert all(r["a"] == r["row_index"] * 10 + r["image_id"] and (r["b"] is None) == (r["image_id"] == 5) for r in found.collect())
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="none"):
        cs.read_cell_tables(spark, paths | {11: str(tmp_path / "none.csv")})


def test_projects_round_trip(spark):
    images = spark.createDataFrame([(1, i, f"i{i}", f"c{i}", None, 7 if i else None, i, ["CD3"] if i == 2 else None, "DAPI", "m" if i == 2 else None) for i in range(4)],
        "project_id long, image_index int, image string, cell_data string, segmentation_mask string, current_x0 long, channel_index int, marker_names array<string>, nuclear_channel_name string, model_name string")
    notes = spark.createDataFrame([(1, 2, "5", "positive", 1.5, 2.5, 4, "automated"), (1, 2, "6", "negative", None, None, None, "manual")], "project_id long, image_index int, cell_id string, label string, centroid_x double, centroid_y double, row_index long, source string")
    gone = spark.createDataFrame([(1, 3, 9), (1, 3, 2)], "project_id long, image_index int, row_index long")
    settings = spark.createDataFrame([(1, "P", 2, False, 700, 33, "Cyan")], "project_id long, name string, current_image_index int, use_nucleus boolean, intensity_slider int, buffer_slider int, color string")
    parsed = pj.parse_projects(pj.write_projects(images, notes, gone, settings))
    back = {r["image_index"]: r["image"] for r in pj.project_images(parsed).collect()}
    assert sorted(back) == [0, 1, 2, 3] and back[0]["paths"]["image"] == "i0" and back[3]["automated_exclusions"] == [2, 9] and back[0]["viewer"]["current_x0"] is None and back[1]["viewer"]["current_x0"] == 7
    assert back[2]["cellpose_metadata"]["marker_names"] == ["CD3"] and back[1]["cellpose_metadata"] is None
    assert sorted(map(tuple, pj.project_annotations(parsed).select(*notes.columns).collect())) == sorted(map(tuple, notes.collect()))
    got = pj.project_settings(parsed).first().asDict()
    want = pj.SETTINGS | {"name": "P", "current_image_index": 2, "use_nucleus": False, "intensity_slider": 700, "buffer_slider": 33, "color": "Cyan"}
    assert {k: got[k] for k in want} == want


def test_metadata_with_prefix_and_several_images(spark):
    uri = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
    texts = [
        f'<ome:OME xmlns:ome="{uri}"><ome:Image><ome:Pixels><ome:Channel Name="A"/><ome:Channel/></ome:Pixels></ome:Image><ome:Image><ome:Pixels><ome:Channel Name="B"/></ome:Pixels></ome:Image></ome:OME>',
        f'<OME xmlns="{uri}"><Image><Pixels/></Image><Image><Pixels><Channel Name="C"/></Pixels></Image></OME>', "<OME><Image><Pixels><Channel Name='D'/></Pixels></Image></OME>", "<OME", None,
    ]
    rows = [(i, "tiff", 3, None, None, None, t, None, []) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "file_id long, kind string, channels int, reader_names array<string>, omero string, biomarkers array<string>, ome_xml string, imagej array<string>, pages array<string>")
    found = {}
    for r in sorted(md.resolve_channel_names(files).collect()):
        found.setdefault(r["file_id"], []).append(r["name"])
    numbered = [f"Channel {i}" for i in range(3)]
    assert found == {0: ["A", "Channel 1", "B"], 1: ["C"], 2: numbered, 3: numbered, 4: numbered}


def test_an_image_without_threshold_or_channel_is_an_error(spark):
    pixels = spark.createDataFrame([(i, y, x, 1.0) for i in (0, 1) for y in range(4) for x in range(4)], "image_id long, y long, x long, value double")
    mask = pixels.select("image_id", "y", "x", F.lit(1).cast("long").alias("label"))
    thresholds = spark.createDataFrame([(0, 0.5)], "image_id long, threshold double")
    for compartment in ("all", "nucleus"):
        with pytest.raises(PySparkException, match="for image 1"):
            agg.pixel_statistics_by_label(pixels, mask, thresholds, compartment).collect()
        assert agg.pixel_statistics_by_label(pixels.filter("image_id = 0"), mask.filter("image_id = 0"), thresholds, compartment).count() == 1
    cells = spark.createDataFrame([(0, 0, 1, 1.0, 1.0), (1, 0, 1, 1.0, 1.0)], "image_id long, row_index long, `Cell ID` long, x double, y double")
    channels = spark.createDataFrame([(0, "m"), (1, "n")], "image_id long, name string")
    both = thresholds.union(spark.createDataFrame([(1, 0.5)], thresholds.schema))
    with pytest.raises(ValueError, match="no channel m"):
        agg.phenotype_by_threshold(cells, mask, pixels, both, 0.2, channels=channels, channel="m")
    found = agg.phenotype_by_threshold(cells, mask, pixels, both, 0.2, channels=channels.withColumn("name", F.lit("m")), channel="m")
    assert [r["positive"] for r in found.collect()] == [True, True]


def test_project_versions(spark):
    note = lambda c, label="positive": {"cell_id": c, "label": label, "row_index": 1}
    old = {"format": pj.FORMAT, "version": 1, "paths": {"image": "i"}, "phenotype": {"name": "P", "annotations": [note("1"), note("1", "negative"), note("2", "maybe")]}, "viewer": {"threshold": {"inward_buffer_pixels": 4}}}
    new = {"format": pj.FORMAT, "version": 4, "images": [{"paths": {"image": "a"}, "annotations": [note("5")], "automated_exclusions": [0, 3, 99, -1]}, {"paths": {"image": "b"}}], "phenotype": {}, "viewer": {"threshold": {"intensity_slider": 700, "inward_buffer_microns": 1.26}}}
    rows = [(1, json.dumps(old)), (4, json.dumps(new))]
    parsed = pj.parse_projects(spark.createDataFrame(rows, "project_id long, value string"))
    assert {(r["project_id"], r["image_index"], r["cell_id"], r["label"]) for r in pj.project_annotations(parsed).collect()} == {(1, 0, "1", "negative"), (4, 0, "5", "positive")}
    counts = spark.createDataFrame([(4, 0, 10), (4, 1, 10)], "project_id long, image_index int, cells long")
    assert {r["row_index"] for r in pj.project_exclusions(parsed, counts).collect()} == {0, 3}
    settings = {r["project_id"]: (r["name"], r["fov_size"], r["intensity_slider"], r["positive_pixel_percent"], r["use_nucleus"], r["buffer_slider"]) for r in pj.project_settings(parsed).collect()}
    assert settings == {1: ("P", 512, 500, 25, True, 20), 4: ("", 512, 700, 25, True, 13)}
    for bad in ({"format": "x", "version": 4}, {"format": pj.FORMAT, "version": 9}):
        with pytest.raises(PySparkException):
            pj.parse_projects(spark.createDataFrame([(1, json.dumps(bad))], "project_id long, value string")).select("images").collect()


def test_a_stopped_segmentation_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    """Whenever a job stops between the writes, readers see the pair of before; afterwards the new one."""
    path = f"file://{tmp_path}/segmentation"
    write = lambda n: tl.write_segmentation(spark.createDataFrame([(0, n)], "image_id long, label long"), mask(spark, np.full((2, 3), n)), path, f"model {n}", ["m"], None, {0: "a.tif"})

    def seen():
        cells, about = tl.read_segmentation(spark, path)
        labels = {r["label"] for r in tl.read_mask_tiles(tl.read_segmentation_mask(spark, path)).collect()}
        return [r["label"] for r in cells.collect()], labels, about.first()["model_name"]

    with pytest.raises(FileNotFoundError):
        tl.read_segmentation(spark, path)
    write(1)
    assert seen() == ([1], {1}, "model 1")
    for broken in ("write_tiles", "unique_stems"):  # after the cell table; after the mask
        with monkeypatch.context() as m:
            m.setattr(tl, broken, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                write(2)
        assert seen() == ([1], {1}, "model 1")
    held = tl.read_segmentation(spark, path)[0]
    write(3)
    assert seen() == ([3], {3}, "model 3") and [r["label"] for r in held.collect()] == [1]  # who reads the version before may go on
    write(4)
    write(5)
    assert seen() == ([5], {5}, "model 5") and len(tl._commits(spark, path)[2]) == 2


def test_jobs_do_not_grow_with_the_number_of_images(spark, tmp_path):
    """Headers come from one scan: eight images take as many jobs as two."""
    for i in range(8):
        (tmp_path / f"cells {i}.tsv").write_text("Cell ID\tX\n" + "".join(f"{k}\t{i}.5\n" for k in range(i + 1)))
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (2, 8):
        spark.sparkContext.setJobGroup(f"read {n}", "")
        found = cs.read_cell_tables(spark, {i: f"{tmp_path}/cells {i}.tsv" for i in range(n)})
        assert {r["image_id"]: r["count"] for r in found.groupBy("image_id").count().collect()} == {i: i + 1 for i in range(n)}
        counts.append(len(tracker.getJobIdsForGroup(f"read {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]
    (tmp_path / "none.tsv").write_text("")
    with pytest.raises(ValueError, match="no cells"):
        cs.read_cell_tables(spark, {0: f"{tmp_path}/cells 0.tsv", 1: f"{tmp_path}/none.tsv"})


def test_a_large_identifier_with_a_fraction_is_none(spark):
    texts = ["7", "7.00001", "7.5", "50000.5", "123456789.5", "123456789", "40000.25", "0.5", "-3"]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "image_id long, row_index long, `Cell ID` string")
    found = [r["candidates"][0] for r in mt.identifier_candidates(rows).orderBy("row_index").collect()]
    assert found == [7, 7, 0, 0, 0, 123456789, 0, 0, 0]


def test_candidates_are_not_worked_out_for_each_pixel(spark, small):
    from lumicell import plans

    plan = plans.queries()["match_by_identifier"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("posexplode") == 1
    none = spark.createDataFrame([(0, 0, []), (0, 1, [0, 4]), (0, 2, None)], "image_id long, row_index long, candidates array<long>")
    labels = spark.createDataFrame([(0, 4)], "image_id long, known long")
    assert [tuple(r) for r in mt.match_by_identifier(none, labels).collect()] == [(0, 1, 4)]
