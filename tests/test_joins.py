import math
import random

import pytest
from brute import dist
from pyspark.sql import functions as F

from curbside.operators import within
from curbside.operators.spread import fragment_join, hot_keys, skew_join

CLIENT, TAXI = "client_id long, lon double, lat double", "taxi_id long, lon double, lat double"


def check_within(spark, clients, taxis, radius, **options):
    found = within(spark.createDataFrame(clients, CLIENT), spark.createDataFrame(taxis, TAXI), radius, **options)
    expected = []
    for c in clients:
        for t in taxis:
            if None not in c and None not in t and dist(c, t) < radius:
                expected.append((c[0], t[0], dist(c, t)))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("limit", [4096, 3])
def test_within(spark, limit):
    rng = random.Random(limit)

    def points(n):
        tight = [(i, rng.uniform(-73.9, -73.899), rng.uniform(40.7, 40.701)) for i in range(n // 3)]
        return tight + [(i, rng.uniform(-74.05, -73.72), rng.uniform(40.58, 40.85)) for i in range(n // 3, n)]

    check_within(spark, points(120), points(200), 0.02, limit=limit)


def test_within_is_strict_and_handles_strange_positions(spark):
    lattice = [(i, float(i % 6), float(i // 6)) for i in range(36)]
    strange = [(100, math.inf, 0.0), (101, math.nan, 0.0), (102, None, 1.0), (103, 1e300, 1.0), (104, 1e15, 1e15),
               (105, 1e15 + 0.5, 1e15), (106, -1e10, 2.0), (107, -1e10 - 0.75, 2.0)]
    check_within(spark, lattice + strange, lattice + strange, 1.0)


def test_within_joins_on_cells(spark):
    rng = random.Random(9)
    points = [(i, rng.random(), rng.random()) for i in range(300)]
    found = within(spark.createDataFrame(points, CLIENT), spark.createDataFrame(points, TAXI), 0.2, limit=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "_lp" in plan and "_rp" in plan


@pytest.mark.parametrize("radius", [0.0, -1.0, math.inf, math.nan])
def test_bad_radius(spark, radius):
    with pytest.raises(ValueError):
        within(spark.createDataFrame([], CLIENT), spark.createDataFrame([], TAXI), radius)


def rows(rng, n):
    """A third of the rows under one key."""
    return [(0 if i % 3 == 0 else rng.randint(1, 40), i) for i in range(n)]


def test_hot_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(10)], "k long, v long")
    assert [tuple(r) for r in hot_keys(df, ["k"], 10).collect()] == [(1, 10)]
    assert hot_keys(df, ["k"], 100) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how):
    rng = random.Random(4)
    left = spark.createDataFrame(rows(rng, 600) + [(99, 1), (None, 2)], "k long, a long")
    right = spark.createDataFrame([(k, k * 10) for k in range(30)], "k long, b long")
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, skew_join(left, right, ["k"], ["a"], how, limit=20).collect())) == plain
    assert sorted(map(str, skew_join(left, right, ["k"], ["a"], how).collect())) == plain


def test_the_hot_key_is_spread(spark):
    rng = random.Random(5)
    left = spark.createDataFrame(rows(rng, 900), "k long, a long")
    right = spark.createDataFrame([(k, k * 10) for k in range(41)], "k long, b long")
    joined = skew_join(left, right, ["k"], ["a"], limit=30, keep_piece=True)
    sizes = [r["count"] for r in joined.groupBy("k", "_piece").count().where("k = 0").collect()]
    assert len(sizes) == 10 and max(sizes) < 60


def test_fragment_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame(rows(rng, 300), "k long, a long")
    right = spark.createDataFrame(rows(rng, 240), "k long, b long")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    for limit in (7, 50, 1000):
        hot = hot_keys(left, ["k"], limit), hot_keys(right, ["k"], limit)
        assert sorted(map(tuple, fragment_join(left, right, ["k"], ["a"], ["b"], *hot).collect())) == plain


@pytest.mark.parametrize("radius", [1e-9, 1e-6, 0.02, 1e5])
def test_cells_fit_any_radius(spark, radius):
    """Positions in metres or degrees: the number of cells follows the radius, however small it is."""
    from curbside.operators.radius import _cell, around

    rng = random.Random(8)
    points = [(i, rng.uniform(-1e6, 1e6) if i % 2 else -73.9 + i * radius / 3, 40.7) for i in range(200)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    cells = df.withColumns(_cell("lon", "lat", 2.0 ** -20 if radius < 1e-7 else radius)).select("_cx").distinct().count()
    assert radius > 1 or cells > 100
    c = df.select(F.col("id").alias("client_id"), "lon", "lat")
    t = df.select(F.col("id").alias("taxi_id"), "lon", "lat")
    found = {(r.client_id, r.taxi_id) for r in within(c, t, radius).collect()}
    assert found == {(a, b) for a, x, _ in points for b, y, _ in points if abs(x - y) < radius}
    assert around(df.limit(1).withColumns(_cell("lon", "lat", 1.0))).count() == 9


def test_copies_of_a_row_are_spread(spark):
    left = spark.createDataFrame([(0, 7)] * 1000, "k long, a long").repartition(20)
    right = spark.createDataFrame([(0, 1)], "k long, b long")
    joined = skew_join(left, right, ["k"], ["a"], limit=50, keep_piece=True)
    assert joined.count() == 1000 and joined.select("_piece").distinct().count() >= 8
