"""Stored tiles against pixel rows and brute force: statistics, compartments, shapes and matches."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumicell.operators import aggregate as agg
from lumicell.operators import blocks as bk
from lumicell.operators import mask as mk
from lumicell.operators import match as mt
from lumicell.operators import pyramid as py
from lumicell.sources import tiles as tl
from tests.test_raster import INF, NAN, mask, pixels, touching


def labels(spark, grid, side, image=0):
    rows = mask(spark, grid, image).select("image_id", F.lit("mask").alias("channel"), "y", "x", F.col("label").alias("value"))
    # unlabelled pixels too, so that tiles are whole
    every = pixels(spark, np.zeros(grid.shape), image, "mask").join(rows.select("y", "x", F.col("value").alias("own")), ["y", "x"], "left")
    return tl.pixels_to_tiles(every.select("image_id", "channel", "y", "x", F.coalesce(F.col("own").cast("double"), "value").alias("value")), side, "<u4")


def rounded(frame, digits=9):
    columns = sorted(frame.columns)
    return sorted((tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in columns) for r in frame.collect()), key=repr)


def slide(seed, shape=(41, 53), cells=9):
    """Discs that touch, overlap the sides and each other, some in several pieces."""
    rng = np.random.default_rng(seed)
    grid = np.zeros(shape, int)
    y, x = np.mgrid[: shape[0], : shape[1]]
    for label in range(1, cells + 1):
        for _ in range(rng.integers(1, 3)):
            cy, cx, r = rng.integers(0, shape[0]), rng.integers(0, shape[1]), rng.integers(0, 9)
            grid[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = label
    values = np.where(rng.random(shape) < 0.1, NAN, rng.integers(0, 100, shape).astype(float) + 1e4)
    values[0, 0], values[grid == 1] = INF, NAN  # one cell without any finite pixel
    return grid, values


@pytest.mark.parametrize("side", [13, 16, 64])
@pytest.mark.parametrize("compartment,buffer", [("all", 4), ("nucleus", 0), ("nucleus", 3), ("cytoplasm_membrane", 10), ("cytoplasm_membrane", 2.5)])
def test_statistics_of_tiles_equal_those_of_rows(spark, side, compartment, buffer):
    grid, values = slide(side)
    limit = spark.createDataFrame([(0, 1e4 + 50.0)], "image_id long, threshold double")
    own = pixels(spark, values)
    got = bk.pixel_statistics(tl.pixels_to_tiles(own, side), labels(spark, grid, side), limit, compartment, buffer)
    assert rounded(got) == rounded(agg.pixel_statistics_by_label(own, mask(spark, grid), limit, compartment, buffer))


@pytest.mark.parametrize("buffer", [0, 1, 2.5, 4, 7, 10])
def test_compartment_tiles_equal_the_join_of_rows(spark, buffer):
    grid, _ = slide(3)
    rows, tiles = mask(spark, grid), labels(spark, grid, 13)
    for compartment in ("nucleus", "cytoplasm_membrane"):
        got = tl.read_mask_tiles(bk.compartment_tiles(tiles, compartment, buffer))
        assert rounded(got) == rounded(mk.compartment_mask_by_join(rows, compartment, buffer))


def test_boundary_tiles(spark):
    for grid in (slide(4)[0], touching()):
        assert rounded(tl.read_mask_tiles(bk.boundary_tiles(labels(spark, grid, 5)))) == rounded(mk.inner_boundaries_by_join(mask(spark, grid)))
    whole = bk.compartment_tiles(labels(spark, touching(), 5))
    assert rounded(tl.read_mask_tiles(whole)) == rounded(mask(spark, touching()))
    with pytest.raises(ValueError):
        bk.compartment_tiles(whole, "membrane")
    with pytest.raises(ValueError):
        bk.compartment_tiles(whole, "nucleus", -1)


@pytest.mark.parametrize("radius", [0, 1, 1.5, 3, 10, 60])
def test_distances_are_exact(radius):
    rng = np.random.default_rng(1)
    for shape, share in (((1, 1), 1), ((1, 30), 0.1), ((30, 1), 0.1), ((25, 31), 0.02), ((25, 31), 0)):
        boundary = rng.random(shape) < share
        y, x = np.nonzero(boundary)
        gy, gx = np.mgrid[: shape[0], : shape[1]]
        want = ((gy[..., None] - y) ** 2 + (gx[..., None] - x) ** 2 <= radius * radius).any(-1)
        assert (mk.near_grid(boundary, radius) == want).all()


@pytest.mark.parametrize("side", [7, 16, 64])
def test_measurements_of_tiles_equal_those_of_rows(spark, side):
    grid, values = slide(side + 1)
    other = np.arange(grid.size, dtype=float).reshape(grid.shape) * 1e-3
    rows = pixels(spark, values, 0, "m").unionByName(pixels(spark, other, 0, "dapi"))
    images = spark.createDataFrame([(0, 0.25)], "image_id long, pixel_size_um double")
    tiles, cells = labels(spark, grid, side), mask(spark, grid)
    got = bk.intensity_statistics(tl.pixels_to_tiles(rows, side), tiles)
    assert rounded(got, 6) == rounded(agg.intensity_statistics(rows, cells), 6)
    got = bk.measure_cells(tl.pixels_to_tiles(rows, side), tiles, images, ["m", "dapi"], 0.5)
    want = agg.measure_cells(rows, cells, images, ["m", "dapi"], 0.5)
    assert got.columns == want.columns and rounded(got, 6) == rounded(want, 6)
    with pytest.raises(ValueError):
        bk.measure_cells(rows, tiles, images, ["m", "m"], 0.5)


def plain_hull(y, x):
    """Pixels in the hull of all edge midpoints, with every edge tried on every pixel."""
    points = sorted({(2 * a + da, 2 * b + db) for a, b in zip(y, x) for da, db in ((0, 1), (0, -1), (1, 0), (-1, 0))})
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    edges = [(a, b) for a in points for b in points if a != b and all(cross(a, b, p) >= 0 for p in points)]
    return sum(all(cross(a, b, (2 * gy, 2 * gx)) >= 0 for a, b in edges) for gy in range(min(y), max(y) + 1) for gx in range(min(x), max(x) + 1))


def test_hulls_equal_brute_force():
    rng = np.random.default_rng(2)
    shapes = [([5], [7]), ([0, 0, 0], [1, 2, 9]), ([3, 4, 5], [2, 2, 2]), ([0, 9], [0, 9]), ([0, 0, 5, 5, 9], [0, 9, 0, 9, 4])]
    shapes += [tuple(rng.integers(0, 9, (2, n)).tolist()) for n in (3, 5, 8, 12)]
    for y, x in shapes:
        cells = sorted(set(zip(y, x)))
        rows = sorted({a for a, _ in cells})
        ends = [np.array(v) for v in zip(*[(r, min(b for a, b in cells if a == r), max(b for a, b in cells if a == r)) for r in rows])]
        assert agg.hull_pixels(*ends) == plain_hull(*map(list, zip(*cells)))


def test_a_label_over_many_tiles_far_out(spark):
    """Sums of squares of large coordinates stay exact."""
    grid = np.zeros((6, 40), int)
    grid[1:5, 3:37] = 9
    near = bk.morphology(labels(spark, grid, 8)).first()
    far = labels(spark, grid, 8)
    far = far.withColumns({"y0": F.col("y0") + 8 * 10**7, "x0": F.col("x0") + 8 * 10**7, "tile_y": F.col("tile_y") + 10**7, "tile_x": F.col("tile_x") + 10**7})
    far = bk.morphology(far).first()
    for c in ("area", "extent", "perimeter", "solidity", "major_axis", "minor_axis", "eccentricity"):
        assert near[c] == far[c]
    assert far["cy"] == near["cy"] + 8e7 and math.isclose(near["major_axis"], 4 * math.sqrt((34**2 - 1) / 12))


def cell_table(spark, rows):
    return spark.createDataFrame(rows, "image_id long, row_index long, x double, y double, `Cell ID` double")


@pytest.mark.parametrize("side", [17, 64, 256])
def test_matches_on_tiles_equal_those_on_rows(spark, side):
    grid, _ = slide(7, (180, 230), 14)
    rng = np.random.default_rng(side)
    grid[rng.random(grid.shape) < 0.2] = 0
    rows = [(0, i, float(rng.integers(-40, 260) + rng.choice([0, 0.5, 0.25])), float(rng.integers(-40, 220) + rng.choice([0, 0.5])), float(rng.choice([NAN, 2, 99, 3.5]))) for i in range(150)]
    rows += [(0, 200, NAN, 1.0, NAN), (0, 201, 1e7, 1.0, NAN), (0, 202, 5.0, INF, NAN), (7, 0, 5.0, 5.0, NAN)]
    cells, tiles, own = cell_table(spark, rows), labels(spark, grid, side), mask(spark, grid)
    assert rounded(bk.match_by_centroid(cells, tiles, side)) == rounded(mt.match_by_centroid(cells, own))
    for radius in (75, 9, 0):
        assert rounded(bk.match_nearest_label(cells, tiles, radius, side)) == rounded(mt.match_nearest_label(cells, own, radius))
    got = bk.map_cells_to_labels(cells, tiles, 75, False, side)
    assert rounded(got) == rounded(mt.map_cells_to_labels(cells, own, 75, False))
    assert rounded(bk.tile_labels(tiles)) == rounded(mt.existing_labels(own).select("image_id", "known"))
    with pytest.raises(PySparkException):
        bk.map_cells_to_labels(cells, tiles, side=side).collect()


def test_nearest_label_keeps_ties_in_row_major_order(spark):
    grid = np.zeros((200, 200), int)
    grid[100, 100], grid[100, 110], grid[20, 20] = 5, 6, 7
    cells = cell_table(spark, [(0, 0, 105.0, 100.0, NAN), (0, 1, 105.4, 100.0, NAN), (0, 2, 175.0, 175.0, NAN), (0, 3, 176.0, 100.0, NAN), (0, 4, 186.0, 100.0, NAN)])
    for side in (16, 105, 256):
        assert {r["row_index"]: r["by_nearest"] for r in bk.match_nearest_label(cells, labels(spark, grid, side), 75, side).collect()} == {0: 5, 1: 6, 2: 6, 3: 6}


def test_many_cells_at_one_place(spark, monkeypatch):
    """Rows at one place are looked up in groups of bounded size."""
    monkeypatch.setattr(bk, "TOGETHER", 100)
    grid = np.zeros((20, 20), int)
    grid[5, 5] = 1
    cells = cell_table(spark, [(0, i, 5.0 if i % 2 else 6.0, 5.0, NAN) for i in range(2000)])
    assert bk.match_by_centroid(cells, labels(spark, grid, 16), 16).count() == 1000
    assert bk.match_nearest_label(cells, labels(spark, grid, 16), 75, 16).filter("by_nearest = 1").count() == 2000


def test_no_pixel_rows_are_shuffled(spark):
    """The plan of measurements has one exchange of whole tiles and one of states, besides that of the images."""
    grid, values = slide(5)
    images = spark.createDataFrame([(0, 0.25)], "image_id long, pixel_size_um double")
    found = bk.measure_cells(spark.createDataFrame(tl.pixels_to_tiles(pixels(spark, values), 16).collect(), tl.pixels_to_tiles(pixels(spark, values), 16).schema), spark.createDataFrame(labels(spark, grid, 16).collect(), labels(spark, grid, 16).schema), images, ["m"], 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("tile_y" in line for line in shuffles) == 1 and not any("Arguments: y" in line or " x#" in line.split("hashpartitioning")[1] for line in shuffles)


def test_queries_of_the_raster_tiles(spark, small):
    """The derived tiles hold the derived raster."""
    from lumicell import fixtures as fx

    tiles = fx.raster_tiles(spark, small, 64)
    for channel, rows in (("mask", fx.raster(spark, small).select("image_id", "y", "x", F.col("label").cast("double").alias("value"))), ("marker", fx.marker(spark, small)), ("dapi", fx.dapi(spark, small))):
        told = lambda df: {(r["image_id"], r["y"], r["x"]): str(r["value"]) for r in df.collect()}
        got, want = told(tl.tiles_to_pixels(tiles.filter(F.col("channel") == channel))), told(rows)
        assert all(got[k] == v for k, v in want.items()) and all(v in ("nan", "0.0") for k, v in got.items() if k not in want)


def test_summed_tables_count_windows(spark):
    """Counts by look-ups equal those of the windows' pixels; windows may go over tiles and the image's side."""
    rng = np.random.default_rng(9)
    values = np.where(rng.random((37, 50)) < 0.1, NAN, rng.integers(0, 100, (37, 50)).astype(float))
    limit = spark.createDataFrame([(0, 60.0)], "image_id long, threshold double")
    asked = [(0, i, int(rng.integers(0, 37)), int(rng.integers(0, 50)), int(rng.integers(1, 30)), int(rng.integers(1, 30))) for i in range(60)]
    windows = spark.createDataFrame(asked, "image_id long, region_id long, y0 long, x0 long, height long, width long")
    for side in (8, 64):
        found = {r["region_id"]: r["fraction"] for r in py.positive_fraction(tl.pixels_to_tiles(pixels(spark, values), side), limit, windows, ["image_id", "region_id"], side).collect()}
        for _, i, y, x, h, w in asked:
            part = values[y : y + h, x : x + w]
            part = part[np.isfinite(part)]
            assert found[i] == ((part > 60).mean() if len(part) else 0)


def test_pyramid_levels_and_overviews(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = np.where(rng.random((45, 70)) < 0.2, NAN, rng.integers(0, 100, (45, 70)).astype(float))
    values[:4, :4] = NAN
    path = f"file://{tmp_path}/pyramid"
    py.write_pyramid(tl.pixels_to_tiles(pixels(spark, values), 8), path, 2, 8)
    stored = spark.read.parquet(path)
    want = values
    for level in range(3):
        got = np.full(want.shape, -1.0)
        for r in tl.tiles_to_pixels(stored.filter(F.col("level") == level)).collect():
            got[r["y"], r["x"]] = r["value"]
        assert np.array_equal(got, want, equal_nan=True)
        want = py.halved(want)
    sizes = py.level_sizes(spark.createDataFrame([(0, 45, 70)], "image_id long, height long, width long"), 2)
    assert [(r["level"], r["height"], r["width"]) for r in sizes.orderBy("level").collect()] == [(0, 45, 70), (1, 23, 35), (2, 12, 18)]
    small = py.overview(stored, sizes, 20)  # the second level is the smallest with 20 or more
    assert {(r["oy"], r["ox"]) for r in small.collect()} == {(y, x) for y in range(13) for x in range(20)}
    assert "level" in small._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]  # other levels are not read
    half = py.halved(values)
    assert all(np.isnan(r["value"]) and np.isnan(half[y, x]) or r["value"] == half[y, x] for r in small.collect() for y, x in [(py.picked(23, 35 / 20)[r["oy"]], py.picked(35, 35 / 20)[r["ox"]])])


def test_a_batch_of_whole_tiles_has_few_bytes(spark, small):
    """Workers hold a batch at once, so its size may follow neither the number of tiles nor that of channels."""
    import pyarrow as pa

    from lumicell import fixtures as fx
    from lumicell.functions.rank import TILE_BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    tile = fx.raster_tiles(spark, small).filter("channel = 'dapi'").limit(1).select("data")
    many = tile.crossJoin(F.broadcast(spark.range(100))).coalesce(1).withColumn("data", F.expr("substring(concat(data, repeat('x', 500000)), 1, 500000)"))
    found = many.mapInArrow(sizes, "rows long, bytes long").agg(F.sum("rows").alias("rows"), F.max("bytes").alias("bytes")).first()
    assert found["rows"] == 100 and found["bytes"] <= TILE_BATCH_BYTES + 500000 + 4096
