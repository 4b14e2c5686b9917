import random

import pytest
from brute import knn, same

from curbside.functions import Grid
from curbside.operators import merge_lists, nearest
from curbside.plans import match, match_all, match_cells, match_parts, part_lists

CLIENT, TAXI = "client_id long, lon double, lat double", "taxi_id long, lon double, lat double"
GRID = Grid(0, 2, 2, 0, 2, 2)


def points(rng, n):
    """Some on a lattice, so that distances tie, some anywhere, some outside the grid."""
    return [(i, rng.randint(0, 8) / 4, rng.randint(0, 8) / 4) if i % 2 else (i, rng.uniform(-1, 3), rng.uniform(-1, 3))
            for i in range(n)]


def frames(spark, clients, taxis):
    return spark.createDataFrame(clients, CLIENT), spark.createDataFrame(taxis, TAXI)


def lists(df):
    return [tuple(r) for r in df.select("client_id", "taxi_id", "rk", "dist").collect()]


@pytest.mark.parametrize("seed,n_taxis", [(1, 60), (2, 3)])
def test_all_strategies_agree(spark, seed, n_taxis):
    rng = random.Random(seed)
    clients, taxis = points(rng, 25), points(rng, n_taxis)
    c, t = frames(spark, clients, taxis)
    expected = knn(clients, taxis)
    assert same(lists(match_all(c, t)), expected)
    assert same(lists(match_parts(c, t)), expected)
    assert same(lists(nearest(c, t, max_distance=1e6)), expected)


def test_clients_without_taxis(spark):
    c, t = frames(spark, [(1, 0.5, 0.5), (2, 1.0, 1.0)], [])
    assert lists(match_all(c, t)) == []
    assert sorted(lists(match_parts(c, t))) == [(1, None, None, None), (2, None, None, None)]
    assert match_cells(c, t, grid=GRID).count() == 2 * 4


def test_no_clients(spark):
    c, t = frames(spark, [], [(1, 0.5, 0.5)])
    for method in ("all", "parts", "cells"):
        assert match(c, t, method).count() == 0


def test_lists_per_part(spark):
    rng = random.Random(3)
    clients, taxis = points(rng, 10), points(rng, 40)
    rows = part_lists(*frames(spark, clients, taxis), parts=3).collect()
    for part in range(3):
        expected = knn(clients, [t for t in taxis if t[0] % 3 == part], keep_empty=True)
        assert same([(r.client_id, r.taxi_id, r.rk, r.dist) for r in rows if r.part == part], expected)


def test_lists_per_cell(spark):
    rng = random.Random(4)
    clients, taxis = points(rng, 12), points(rng, 60)

    def cell(x, y):
        number = int(x) + int(y) * 2
        return number if 0 <= number < 4 else 4

    c, t = frames(spark, clients, taxis)
    found = match_cells(c, t, grid=GRID, max_distance=0.5)
    rows = found.collect()
    for number in range(4):
        held = [x for x in taxis if cell(x[1], x[2]) == number]
        expected = knn(clients, held, radius=0.5, keep_empty=True)
        assert same([(r.client_id, r.taxi_id, r.rk, r.dist) for r in rows if r.cell == number], expected)
    inside = [x for x in taxis if cell(x[1], x[2]) < 4]
    assert same(lists(merge_lists(found)), knn(clients, inside, radius=0.5))


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        match(*frames(spark, [], []), "guess")


@pytest.mark.parametrize("cells, limit", [(100, 32_768), (100, 5), (2, 32_768)])
def test_cells_are_searched_by_near_clients_only(spark, cells, limit):
    """The pairs that are searched follow the pairs that are near, not clients x cells."""
    from curbside.operators.movement import with_cell
    from curbside.operators.radius import near_groups

    rng = random.Random(6)
    grid = Grid(0, 10, 10, 0, cells, cells)
    clients = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(50)] + [(90, None, 1.0), (91, float("nan"), 1.0), (92, 1e300, 1.0)]
    taxis = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(400)]
    c, t = frames(spark, clients, taxis)
    inside = with_cell(t, grid, compat=False)
    pairs = [(r.client_id, r.cell) for r in near_groups(c, inside, 0.15, "cell", limit=limit).collect()]
    needed = set()
    cell_of = {r.taxi_id: r.cell for r in inside.collect()}
    for i, x, y in clients[:50]:
        needed |= {(i, cell_of[j]) for j, u, v in taxis if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 < 0.15}
    assert len(pairs) == len(set(pairs)) and needed <= set(pairs) and len(pairs) <= 4 * len(needed) + 60
