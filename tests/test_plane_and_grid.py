import math
import random

import pytest
from pyspark.sql import functions as F

from curbside.functions import Grid, distance, normalize_lon
from curbside.functions.plane import box_far, box_near

XY = "x double, y double"


def truncating(grid, x, y):
    column, row = int((x - grid.left) / grid.size_x), int((y - grid.bottom) / grid.size_y)
    cell = column + row * grid.cells_x
    return cell if 0 <= cell < grid.overflow else grid.overflow


def checking(grid, x, y):
    column, row = math.floor((x - grid.left) / grid.size_x), math.floor((y - grid.bottom) / grid.size_y)
    ok = 0 <= column < grid.cells_x and 0 <= row < grid.cells_y
    return column + row * grid.cells_x if ok else grid.overflow


@pytest.mark.parametrize("grid", [Grid(), Grid(0, 3, 5, -1, 5, 3), Grid(-1, 1, 1, -1, 1, 7)])
def test_cells(spark, grid):
    rng = random.Random(1)
    spread_x, spread_y = (grid.right - grid.left) * 2, (grid.top - grid.bottom) * 2
    points = [(grid.left + rng.uniform(-1, 1) * spread_x, grid.bottom + rng.uniform(-1, 1) * spread_y)
              for _ in range(500)]
    points += [(float(x), float(y)) for x in (grid.left, grid.right) for y in (grid.bottom, grid.top)]
    rows = spark.createDataFrame(points, XY).select(
        "x", "y", grid.cell_compat(F.col("x"), F.col("y")).alias("a"), grid.cell(F.col("x"), F.col("y")).alias("b")
    ).collect()
    assert [(r.a, r.b) for r in rows] == [(truncating(grid, r.x, r.y), checking(grid, r.x, r.y)) for r in rows]


def test_cell_quirks(spark):
    grid = Grid()
    points = [(-73.70, 40.62), (-74.05, 40.62), (1e300, 40.62), (None, 40.62), (math.nan, 40.62), (math.inf, -math.inf)]
    rows = spark.createDataFrame(points, XY).select(
        grid.cell_compat(F.col("x"), F.col("y")), grid.cell(F.col("x"), F.col("y"))
    ).collect()
    # right of the extent wraps into the next row, just left of it counts as the first column
    assert [tuple(r) for r in rows] == [(2, 4), (0, 4), (4, 4), (4, 4), (4, 4), (4, 4)]


def test_centers(spark):
    grid = Grid(0, 3, 4, 0, 2, 3)
    rows = grid.centers(spark).orderBy("cell").collect()
    assert [tuple(r) for r in rows] == [(j * 2 + i, 1.0 + 2 * i, 0.5 + j) for j in range(3) for i in range(2)]
    assert grid.count == 7
    back = grid.centers(spark).select("cell", grid.cell_compat(F.col("lon"), F.col("lat")).alias("again"))
    assert all(r.cell == r.again for r in back.collect())


def test_bad_grid():
    for args in ((0, 1, 0, 0, 1, 1), (0, 0, 1, 1, 1, 1), (0, 1, 1, 0, 0, 1)):
        with pytest.raises(ValueError):
            Grid(*args)


def test_distance(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(-180, 180) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = [r[0] for r in df.select(distance(*map(F.col, "abcd"))).collect()]
    assert found == [math.sqrt((c - a) * (c - a) + (d - b) * (d - b)) for a, b, c, d in rows]


def test_box_bounds_hold_to_the_last_bit(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(500):
        x0, y0 = rng.uniform(-75, -73), rng.uniform(40, 41)
        x1, y1 = x0 + rng.random() * 10 ** -rng.randint(0, 12), y0 + rng.random() * 10 ** -rng.randint(0, 12)
        rows.append((rng.uniform(-75, -73), rng.uniform(40, 41), x0, x1, y0, y1,
                     min(x1, max(x0, rng.uniform(x0, x1))), min(y1, max(y0, rng.uniform(y0, y1)))))
    names = ["px", "py", "x0", "x1", "y0", "y1", "tx", "ty"]
    df = spark.createDataFrame(rows, names)
    box = [F.col(c) for c in names[:6]]
    dist = distance(F.col("px"), F.col("py"), F.col("tx"), F.col("ty"))
    assert df.where((box_near(*box) > dist) | (box_far(*box) < dist)).count() == 0


def test_normalize_lon(spark):
    df = spark.createDataFrame([(v,) for v in (-180.0, 180.0, 540.0, -73.5, 286.5, 0.0, -200.0)], "lon double")
    assert [r[0] for r in df.select(normalize_lon(F.col("lon"))).collect()] == [
        -180.0, -180.0, -180.0, -73.5, -73.5, 0.0, 160.0
    ]
