"""Rasters and masks on small hand-made images, against numpy."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumicell.functions import values as v
from lumicell.operators import mask as mk
from lumicell.operators import raster as rs
from lumicell.sources import tiles as tl

NAN, INF = float("nan"), float("inf")


def pixels(spark, grid, image=0, channel="m"):
    rows = [(image, channel, y, x, float(grid[y, x])) for y in range(grid.shape[0]) for x in range(grid.shape[1])]
    return spark.createDataFrame(rows, "image_id long, channel string, y long, x long, value double")


def mask(spark, grid, image=0):
    rows = [(image, int(y), int(x), int(grid[y, x])) for y, x in zip(*np.nonzero(grid))]
    return spark.createDataFrame(rows, "image_id long, y long, x long, label long")


def images(spark, *sizes):
    return spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate(sizes)], "image_id long, height long, width long")


def touching():
    grid = np.zeros((23, 31), int)
    grid[0:9, 0:8] = 1  # at two edges
    grid[2:15, 8:17] = 2  # touches the first
    grid[10:23, 20:31] = 3
    grid[16, 4] = 4  # a single pixel
    return grid


def plain_boundary(grid):
    padded = np.pad(grid, 1)
    return (grid > 0) & ((padded[:-2, 1:-1] != grid) | (padded[2:, 1:-1] != grid) | (padded[1:-1, :-2] != grid) | (padded[1:-1, 2:] != grid))


def as_set(df):
    return {(r["y"], r["x"]) for r in df.collect()}


def test_finite(spark):
    rows = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "a double")
    assert [r[0] for r in rows.select(v.finite(F.col("a"))).collect()] == [True, False, False, False, None]
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("x",), (None,)], "a string").select(v.number(F.col("a"))).collect()] == [1.5, None, None]


@pytest.mark.parametrize("side", [4, 7, 64])
def test_boundaries(spark, side):
    grid = touching()
    want = set(zip(*(a.tolist() for a in np.nonzero(plain_boundary(grid)))))
    assert as_set(mk.inner_boundaries(mask(spark, grid), side)) == want
    assert as_set(mk.inner_boundaries_by_join(mask(spark, grid))) == want


@pytest.mark.parametrize("buffer", [0, 1, 4, 10])
def test_compartments(spark, buffer):
    grid = touching()
    by, bx = np.nonzero(plain_boundary(grid))
    near = {(y, x) for y, x in zip(*(a.tolist() for a in np.nonzero(grid))) if ((by - y) ** 2 + (bx - x) ** 2).min() <= buffer * buffer}
    every = set(zip(*(a.tolist() for a in np.nonzero(grid))))
    for side in (5, 64):
        assert as_set(mk.compartment_mask(mask(spark, grid), "cytoplasm_membrane", buffer, side)) == near
        assert as_set(mk.compartment_mask(mask(spark, grid), "nucleus", buffer, side)) == every - near
    assert as_set(mk.compartment_mask_by_join(mask(spark, grid), "nucleus", buffer)) == every - near
    assert as_set(mk.compartment_mask(mask(spark, grid), "all", buffer)) == every


def test_compartment_errors(spark):
    with pytest.raises(ValueError):
        mk.compartment_mask(mask(spark, touching()), "wall")
    with pytest.raises(ValueError):
        mk.compartment_mask(mask(spark, touching()), "nucleus", -1)


def test_mask_violations(spark):
    own = mask(spark, touching())
    assert mk.mask_violations(own, images(spark, (23, 31))).count() == 0
    assert mk.mask_violations(own, images(spark, (22, 31))).first()["problem"] == "outside the image"
    with pytest.raises(ValueError):
        mk.validate_mask(own, images(spark, (22, 31)))


def test_windows(spark):
    grid = np.arange(600).reshape(20, 30)
    windows = spark.createDataFrame([(0, 1, 3, 5, 4, 6), (0, 2, 0, 0, 20, 30)], "image_id long, region_id int, y0 long, x0 long, height long, width long")
    found = rs.read_region(pixels(spark, grid), windows, side=7).collect()
    assert sorted(r["value"] for r in found if r["region_id"] == 1) == sorted(grid[3:7, 5:11].ravel().tolist())
    assert len(found) == 24 + 600 and all(r["fy"] == r["y"] - r["y0"] for r in found)
    for bad in ((0, 1, -1, 0, 2, 2), (0, 1, 0, 0, 0, 2), (0, 1, 19, 0, 2, 2), (9, 1, 0, 0, 1, 1)):
        with pytest.raises(ValueError):
            rs.check_windows(spark.createDataFrame([bad], windows.schema), images(spark, (20, 30)))


@pytest.mark.parametrize("size,most", [((20, 30), 7), ((20, 30), 100), ((1, 5), 2), ((33, 10), 10)])
def test_overview(spark, size, most):
    h, w = size
    grid = np.arange(h * w).reshape(h, w)
    scale = max(h / most, w / most, 1)
    oh, ow = max(int(np.rint(h / scale)), 1), max(int(np.rint(w / scale)), 1)
    want = grid[np.linspace(0, h - 1, oh).astype(int)][:, np.linspace(0, w - 1, ow).astype(int)]
    found = {(r["oy"], r["ox"]): r["value"] for r in rs.overview_resample(pixels(spark, grid), images(spark, size), most).collect()}
    assert found == {(y, x): want[y, x] for y in range(oh) for x in range(ow)}


@pytest.mark.parametrize("values,low,high", [([1, 2, 3, 4], 1.03, 3.97), ([5, 5, 5], 5, 6), ([NAN, INF], 0, 1), ([7, NAN, -INF], 7, 8)])
def test_contrast(spark, values, low, high):
    found = rs.contrast_limits(pixels(spark, np.array([values], float)), ["image_id"]).first()
    assert math.isclose(found["low"], low) and math.isclose(found["high"], high)


def test_grey(spark):
    grid = np.array([[0.0, 50.0, 100.0, NAN, INF, -INF]])
    found = {r["x"]: r["grey"] for r in rs.normalize_uint8(pixels(spark, grid), ["image_id"]).collect()}
    low, high = np.percentile([0, 50, 100], (1, 99))
    assert found == {0: 0, 1: int(np.rint((50 - low) / (high - low) * 255)), 2: 255, 3: 0, 4: 255, 5: 0}


def test_thresholds(spark):
    grid = np.array([[1.0, 2.0, NAN, 10.0, INF]])
    found = rs.intensity_threshold(pixels(spark, grid), ["image_id"], 2000)
    assert math.isclose(found.first()["threshold"], np.percentile([1, 2, 10], 99))
    assert rs.threshold_highlight(pixels(spark, grid), rs.intensity_threshold(pixels(spark, grid), ["image_id"], 0), ["image_id"]).count() == 3
    with pytest.raises(ValueError):
        rs.intensity_threshold(pixels(spark, grid), ["image_id"], 1, 0)


def test_random_fov(spark):
    rng = np.random.default_rng(0)
    grid = np.where(rng.random((40, 50)) < 0.02, 1000.0, 1.0)
    low, high = np.percentile(grid, (20, 99.5))
    threshold = low + 0.2 * (high - low)
    draw = np.random.default_rng(42)
    for attempt in range(50):
        y0, x0 = int(draw.integers(0, 40 - 8 + 1)), int(draw.integers(0, 50 - 8 + 1))
        share = (grid[y0 : y0 + 8, x0 : x0 + 8] > threshold).mean()
        if share >= 0.05:
            break
    found = rs.random_fov(pixels(spark, grid), images(spark, (40, 50)), 8, 42, 0.05, 50, 16).first()
    assert (found["attempt"], found["y0"], found["x0"]) == (attempt, y0, x0) and math.isclose(found["fraction"], share)
    with pytest.raises(PySparkException):
        rs.random_fov(pixels(spark, grid), images(spark, (40, 50)), 8, 42, 1.0, 3, 16).collect()
    with pytest.raises(PySparkException, match="does not fit"):
        rs.random_fov(pixels(spark, grid), images(spark, (40, 50)), 41).collect()
    with pytest.raises(PySparkException):
        rs.dapi_threshold(pixels(spark, np.ones((4, 4))), images(spark, (4, 4))).collect()


def test_segmentation_input_errors(spark):
    own = pixels(spark, np.arange(12.0).reshape(3, 4))
    size = images(spark, (3, 4))
    for markers, nuclear in (([], None), (["DAPI 1"], None), (["m", "other"], None), (["m"], "d")):
        with pytest.raises(ValueError):
            rs.segmentation_input(own, size, markers, nuclear)
    assert {r["ch1"] for r in rs.segmentation_input(own, size, ["m"]).collect()} == {0}


@pytest.mark.parametrize("side", [3, 8])
def test_tiles_round_trip(spark, tmp_path, side):
    grid = np.arange(70.0).reshape(7, 10)
    tl.write_tiles(tl.pixels_to_tiles(pixels(spark, grid), side), str(tmp_path / "t"))
    tiles = spark.read.parquet(str(tmp_path / "t"))
    found = {(r["y"], r["x"]): r["value"] for r in tl.tiles_to_pixels(tiles).collect()}
    assert found == {(y, x): grid[y, x] for y in range(7) for x in range(10)}
    part = tl.tiles_to_pixels(tl.tiles_in_window(tiles, 2, 4, 3, 2, side)).filter("y >= 2 and y < 5 and x >= 4 and x < 6")
    assert sorted(r["value"] for r in part.collect()) == sorted(grid[2:5, 4:6].ravel().tolist())
    plan = tl.tiles_in_window(tiles.filter("channel = 'm'"), 2, 4, 3, 2, side)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "GreaterThanOrEqual(tile_y" in plan


def test_window_conversions(spark):
    one = spark.range(1)
    got = one.select(
        v.buffer_px_from_um(F.lit(2.0)).alias("px"), v.buffer_slider_from_px(F.lit(4)).alias("slider"), v.window_start(F.lit(2.0), F.lit(32), F.lit(100)).alias("low"),
        v.window_start(F.lit(99.0), F.lit(32), F.lit(100)).alias("high"), v.window_start(F.lit(18.5), F.lit(32), F.lit(100)).alias("even"),
    ).first()
    assert tuple(got) == (4, 20, 0, 68, 2)


def test_percentiles_equal_those_of_all_values(spark):
    """Selection by ranges is exact for values of any size and for any ties, for all groups at once."""
    rng = np.random.default_rng(3)
    kinds = {
        "small": rng.integers(0, 65536, 2000).astype(float), "spread": rng.normal(size=1000) * 10.0 ** rng.integers(-300, 300, 1000), "ties": rng.integers(0, 3, 500).astype(float),
        "tiny": np.array([5e-324 * i for i in range(50)] + [1.0]), "huge": np.array([-1.7e308, 1.7e308, 1e-10, -1e-10, 0.0, 3.0]), "one": np.array([4.25]), "none": np.array([]), "two": np.array([1.0, 2.0]),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, values in kinds.items() for v in [*values, NAN, INF, -INF]], "g string, value double").repartition(3)
    shares = (0.0, 0.01, 0.2, 0.5, 0.99, 1.0)
    want = {r["g"]: r["p"] for r in rows.filter(F.abs("value") < INF).groupBy("g").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("p")).collect()}
    found = {r["g"]: r["p"] for r in rs.percentiles(rows, ["g"], shares).collect()}
    assert found.keys() == kinds.keys() and all(found[k] == want.get(k, [None] * len(shares)) for k in kinds)


def test_a_threshold_needs_finite_pixels(spark):
    rows = spark.createDataFrame([(0, NAN), (0, INF)], "image_id long, value double")
    with pytest.raises(PySparkException, match="no finite pixel"):
        rs.intensity_threshold(rows, ["image_id"], 500).collect()


def test_pixels_are_packed_by_tile_before_they_are_shuffled(spark):
    import pandas as pd

    from lumicell.operators.gather import by_tile, packed

    pixels = spark.range(40 * 40).selectExpr("if(id % 2 = 0, 'a', null) as image_id", "id div 40 - 3 as y", "id % 40 as x", "id as label").repartition(3)
    pieces = packed(pixels, ["image_id"], 16, 2, {"label": "<i8"})
    assert pieces.count() <= 3 * 2 * 4 * 4  # tasks, images, tiles: a row of each holds its pixels
    run = lambda key, rows: pd.DataFrame({"image_id": key[0], "ty": key[1], "tx": key[2], "y": rows["y"], "x": rows["x"], "label": rows["label"]})
    found = {tuple(r) for r in by_tile(pieces, ["image_id"], 16, {"label": "<i8"}, run, "image_id string, ty long, tx long, y long, x long, label long").collect()}
    near = lambda c: range((c - 2) // 16, (c + 2) // 16 + 1)
    assert found == {(r["image_id"], a, b, r["y"], r["x"], r["label"]) for r in pixels.collect() for a in near(r["y"]) for b in near(r["x"])}


def test_segmentation_input_is_packed_by_tile(spark):
    rng = np.random.default_rng(1)
    grids = {c: rng.integers(0, 50, (3, 300)).astype(float) for c in ("a", "b", "d")}
    rows = pixels(spark, grids["d"], channel="d").unionByName(pixels(spark, grids["a"], channel="a")).unionByName(pixels(spark, grids["b"], channel="b").filter("x <> 280"))
    rows = rows.filter("channel <> 'a' or x <> 280")  # a column with the nuclear channel alone
    found = rs.segmentation_input(rows, images(spark, (3, 300)), ["a", "b"], "d")
    assert found.dtypes == [("image_id", "bigint"), ("y", "bigint"), ("x", "bigint"), ("ch0", "int"), ("ch1", "int"), ("ch2", "int")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_id" in plan and ", tile_y" in plan and "SortMergeJoin" not in plan  # tiles are shuffled, not pixels, and pixels meet their limits where they are

    def unit(grid, kept):
        low, high = np.percentile(grid[:, kept], (1, 99))
        return np.clip((grid - low) / (high - low), 0, 1)

    kept = np.arange(300) != 280
    ch0, ch1 = (unit(grids["a"], kept) + unit(grids["b"], kept)) / 2 * 255, unit(grids["d"], kept | True) * 255
    got = {(r["y"], r["x"]): (r["ch0"], r["ch1"], r["ch2"]) for r in found.collect()}
    assert len(got) == found.count() == 900
    assert got == {(y, x): (int(ch0[y, x]) if x != 280 else None, int(ch1[y, x]), 0) for y in range(3) for x in range(300)}
