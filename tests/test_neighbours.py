import math
import random

import pytest
from brute import knn, same
from pyspark.sql import functions as F

from curbside.operators import merge_lists, nearest

CLIENT, TAXI = "client_id long, lon double, lat double", "taxi_id long, lon double, lat double"


def uniform(rng, n, x0=-74.05, x1=-73.72, y0=40.58, y1=40.85, first=0):
    return [(first + i, rng.uniform(x0, x1), rng.uniform(y0, y1)) for i in range(n)]


def crowded(rng, n):
    """A third of all rows within a millionth of a degree, a third on few spots, the rest spread."""
    tight = uniform(rng, n // 3, -73.9, -73.9 + 1e-6, 40.7, 40.7 + 1e-6)
    spots = [(n + i, -73.85 + (i % 5) * 0.001, 40.65) for i in range(n // 3)]
    return tight + spots + uniform(rng, n - 2 * (n // 3), first=3 * n)


def run(spark, clients, taxis, k=4, radius=None, **options):
    c, t = spark.createDataFrame(clients, CLIENT), spark.createDataFrame(taxis, TAXI)
    rows = nearest(c, t, k=k, max_distance=radius, **options).select("client_id", "taxi_id", "rk", "dist").collect()
    return [tuple(r) for r in rows]


def check(spark, clients, taxis, k=4, radius=None, keep_empty=False, **options):
    found = run(spark, clients, taxis, k, radius, keep_empty=keep_empty, **options)
    assert same(found, knn(clients, taxis, k, radius, keep_empty))


@pytest.mark.parametrize("k", [1, 4, 9])
def test_uniform(spark, k):
    rng = random.Random(k)
    check(spark, uniform(rng, 120), uniform(rng, 700), k)


def test_small_limits_change_nothing(spark):
    rng = random.Random(5)
    check(spark, uniform(rng, 80), uniform(rng, 400), leaf_rows=2, piece_rows=3)


def test_a_third_in_one_place_on_both_sides(spark):
    rng = random.Random(6)
    check(spark, crowded(rng, 120), crowded(rng, 900), leaf_rows=8, part_rows=50, piece_rows=16)


def test_default_limits_with_a_crowd(spark):
    rng = random.Random(7)
    check(spark, crowded(rng, 90), crowded(rng, 1500), part_rows=100)


def test_clients_elsewhere(spark):
    rng = random.Random(8)
    check(spark, uniform(rng, 40, 10, 11, 50, 51), crowded(rng, 300), leaf_rows=8, part_rows=20)


def test_from_the_top(spark):
    rng = random.Random(9)
    check(spark, crowded(rng, 60), crowded(rng, 600), leaf_rows=8, part_rows=40)


def test_all_at_one_spot(spark):
    spot = [(i, -73.9, 40.7) for i in range(300)]
    check(spark, [(1, -73.9, 40.7), (2, -73.8, 40.7)], spot, leaf_rows=2)


def test_on_a_line_and_on_a_ring(spark):
    line = [(i, -73.9, 40.0 + i * 0.01) for i in range(200)]
    ring = [(1000 + i, 5 * math.cos(i / 32 * math.pi), 5 * math.sin(i / 32 * math.pi)) for i in range(64)]
    check(spark, [(1, 0.0, 0.0), (2, -73.9, 41.0), (3, -70.0, 40.5)], line + ring, leaf_rows=4, part_rows=16)


def test_ties_on_a_lattice(spark):
    lattice = [(i, float(i % 12), float(i // 12)) for i in range(144)]
    check(spark, [(i, i % 7 + 0.5, i // 7 + 0.5) for i in range(49)] + [(100, 3.0, 3.0)], lattice, 6, part_rows=12)


@pytest.mark.parametrize("radius", [1.0, 0.05, 1e-9])
def test_radius_is_strict(spark, radius):
    lattice = [(i, float(i % 8), float(i // 8)) for i in range(64)]
    check(spark, [(1, 2.0, 2.0), (2, 2.5, 2.5), (3, 99.0, 2.0)], lattice, 5, radius, keep_empty=True)


def test_radius_on_a_crowd(spark):
    rng = random.Random(11)
    check(spark, crowded(rng, 60), crowded(rng, 600), 4, 0.004, keep_empty=True, leaf_rows=8, part_rows=30, piece_rows=9)


def test_strange_positions(spark):
    inf, nan = math.inf, math.nan
    rng = random.Random(12)
    far = [(500, 1e6, 1e6), (501, -1e300, 3.0), (502, 2.0, 1e300), (503, inf, 1.0), (504, 1.0, -inf), (505, nan, 1.0),
           (506, nan, nan), (507, inf, -inf), (508, None, 1.0), (509, 1e12, -1e12)]
    check(spark, uniform(rng, 20) + far, uniform(rng, 200) + far, leaf_rows=8, part_rows=20, keep_empty=True)
    check(spark, uniform(rng, 5) + far, uniform(rng, 2) + far[5:9], keep_empty=True)
    check(spark, far, far, 12, keep_empty=True)
    check(spark, far, far, 3, 1e7, keep_empty=True)


def test_a_crowd_beyond_the_outermost_cells(spark):
    rng = random.Random(19)
    junk = [(1000 + i, 1e30 * (1 + i / 7), -1e31 / (i + 1)) for i in range(120)]
    clients = uniform(rng, 20) + [(100 + i, 1e30 * (1 + i / 5), -1e30) for i in range(10)]
    check(spark, clients, uniform(rng, 150) + junk, leaf_rows=8, part_rows=20)


def test_crowds_within_crowds(spark):
    """Every crowd holds a crowd a thousand times smaller; no depth ends the search."""
    rng = random.Random(20)
    nested = [(100 * d + i, rng.uniform(0, 0.001**d), rng.uniform(0, 0.001**d)) for d in range(5) for i in range(12)]
    check(spark, nested[::6], nested, k=2, leaf_rows=4, part_rows=8)


def test_one_large_group_among_many(spark):
    """The top of the tree is small in every group, not only on average."""
    rng = random.Random(21)
    taxis = [(i, x, y, i if i < 30 else 1000) for i, x, y in uniform(rng, 300)]
    clients = [(i, x, y, 1000 if i % 2 else i) for i, x, y in uniform(rng, 20)]
    c = spark.createDataFrame(clients, CLIENT + ", zone long")
    t = spark.createDataFrame(taxis, TAXI + ", zone long")
    found = nearest(c, t, k=2, by=("zone",), part_rows=16).select("client_id", "taxi_id", "rk", "dist").collect()
    expected = [row for z in {z for *_, z in clients} for row in knn([r[:3] for r in clients if r[3] == z], [r[:3] for r in taxis if r[3] == z], 2)]
    assert same([tuple(r) for r in found], expected)


def test_few_or_no_taxis(spark):
    clients = [(1, 0.0, 0.0), (2, 1.0, 1.0)]
    check(spark, clients, [(1, 3.0, 3.0)], keep_empty=True)
    check(spark, clients, [], keep_empty=True)
    check(spark, clients, [])
    check(spark, [], [(1, 3.0, 3.0)], keep_empty=True)
    check(spark, [(1, 0.0, 0.0)], [(1, None, 3.0)], keep_empty=True)


def test_groups(spark):
    rng = random.Random(13)
    clients, taxis = uniform(rng, 30), crowded(rng, 300)
    c = spark.createDataFrame(clients, CLIENT).withColumn("zone", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    t = spark.createDataFrame(taxis, TAXI).withColumn("zone", (F.col("taxi_id") % 3).cast("int"))
    for options in ({}, {"part_rows": 20}, {"leaf_rows": 4, "part_rows": 10, "piece_rows": 4}):
        rows = nearest(c, t, by=("zone",), keep_empty=True, **options).collect()
        for zone in range(4):
            expected = knn(clients, [x for x in taxis if x[0] % 3 == zone], keep_empty=True)
            assert same([(r.client_id, r.taxi_id, r.rk, r.dist) for r in rows if r.zone == zone], expected)


def test_lists_of_cells_merge_to_the_global_list(spark):
    rng = random.Random(14)
    clients, taxis = uniform(rng, 30), uniform(rng, 200)
    c = spark.createDataFrame(clients, CLIENT).withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(2))))
    t = spark.createDataFrame(taxis, TAXI).withColumn("zone", (F.col("taxi_id") % 3).cast("int"))
    merged = merge_lists(nearest(c, t, by=("zone",), max_distance=0.05))
    assert same([tuple(r) for r in merged.collect()], knn(clients, taxis, radius=0.05))


def test_no_pairwise_join(spark, plans):
    rng = random.Random(15)
    run(spark, crowded(rng, 60), crowded(rng, 600), leaf_rows=8, part_rows=40, piece_rows=9)
    assert {"parts", "first", "reached", "hot"} <= {label for label, _ in plans}
    for _, plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_spots_are_trimmed_before_the_shuffle(spark, plans):
    rng = random.Random(17)
    run(spark, uniform(rng, 10), [(i, -73.9, 40.7) for i in range(300)] + uniform(rng, 100, first=300), part_rows=50)
    trimmed = next(plan for label, plan in plans if label == "parts")
    assert trimmed.count("WindowGroupLimit") == 2
    assert trimmed.index("WindowGroupLimit") < trimmed.index("Exchange hashpartitioning") < trimmed.rindex("WindowGroupLimit")


def jobs_of(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def nested(rng, n, depth, first=0):
    return [(first + i, -73.9 + rng.random() * 10.0 ** -rng.randint(0, depth), 40.7 + rng.random() * 10.0 ** -rng.randint(0, depth))
            for i in range(n)]


def test_number_of_jobs(spark):
    """Crowds inside crowds cost no further jobs."""
    counts = []
    for depth in (0, 4, 9):
        rng = random.Random(22)
        taxis, clients = nested(rng, 1500, depth), nested(rng, 100, depth)
        counts.append(jobs_of(spark, lambda: check(spark, clients, taxis, part_rows=64)))
    assert max(counts) <= 40 and max(counts) - min(counts) <= 6


def test_parts_are_even(spark):
    """Parts hold about as many taxis each, whatever the positions; and every taxi has one part."""
    from curbside.operators import neighbours

    rng = random.Random(23)
    for taxis in (nested(rng, 4000, 9), crowded(rng, 4000), uniform(rng, 4000) + [(5000 + i, 1e30 * (i + 1), -1e200) for i in range(9)]):
        rows = spark.createDataFrame(taxis, "taxi_id long, _x double, _y double")
        task = neighbours._Task("client_id", "taxi_id", [], 4, math.inf, 32, 200, 100)
        parts = neighbours._Parts(task, rows)
        sizes = [r["count"] for r in parts.rows.groupBy("_part").count().collect()]
        assert max(sizes) <= 800 and 5 <= len(sizes) <= 80


def test_leaves_against_all_pairs():
    import numpy as np
    from curbside.operators.neighbours import Leaves

    rng = np.random.default_rng(24)
    for n, leaf in ((1, 4), (50, 4), (500, 16)):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
        px, py = rng.uniform(-3, 15, 40), rng.integers(0, 12, 40).astype(float)
        bound = np.where(np.arange(40) % 3 == 0, 2.0, math.inf)
        found, who = Leaves(x, y, leaf).nearest(px, py, 5, bound, 4.0)
        for q in range(40):
            d = np.sqrt((x - px[q]) ** 2 + (y - py[q]) ** 2)
            wanted = sorted((v, i) for i, v in enumerate(d) if v <= bound[q] and v < 4.0)[:5]
            assert [(v, i) for v, i in zip(found[q], who[q]) if v < math.inf] == wanted


def test_positions_over_many_magnitudes(spark):
    rng = random.Random(18)
    taxis = [(i, -73.9 + rng.random() * 10.0 ** -rng.randint(0, 9), 40.7 + rng.random() * 10.0 ** -rng.randint(0, 9))
             for i in range(400)]
    clients = [(i, -73.9 + rng.random() * 10.0 ** -rng.randint(0, 9), 40.7) for i in range(30)]
    check(spark, clients, taxis, leaf_rows=4, part_rows=20)


def test_bad_arguments(spark):
    c, t = spark.createDataFrame([], CLIENT), spark.createDataFrame([], TAXI)
    for options in ({"k": 0}, {"max_distance": 0.0}, {"max_distance": math.inf}, {"max_distance": math.nan}):
        with pytest.raises(ValueError):
            nearest(c, t, **options)
