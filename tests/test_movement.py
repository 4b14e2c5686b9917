import random

import pytest

from curbside.functions import Grid
from curbside.operators import (
    cell_deltas,
    cell_members,
    cell_stats,
    latest,
    moved_taxis,
    transitions,
    with_moved_flag,
    with_previous,
)

GRID = Grid(0, 2, 2, 0, 2, 2)
CENTER = {0: (0.5, 0.5), 1: (1.5, 0.5), 2: (0.5, 1.5), 3: (1.5, 1.5), 4: (9.0, 9.0)}
PINGS = "taxi_id long, seq long, lon double, lat double"


def ping(taxi, seq, cell):
    return (taxi, seq, *CENTER[cell])


def make(spark, pings):
    return spark.createDataFrame(pings, PINGS)


def random_pings(rng, n):
    """A third of the pings come from taxi 0; some messages arrive twice or more, in any order."""
    seqs = rng.sample(range(10 * n), n)
    pings = [ping(0 if i % 3 == 0 else rng.randint(1, 20), s, rng.randint(0, 4)) for i, s in enumerate(seqs)]
    pings += rng.choices(pings, k=n // 5) + [pings[0]] * (n // 4)
    rng.shuffle(pings)
    return pings


def histories(pings):
    """Cells per taxi in the order of ``seq``, copies dropped."""
    cell = {v: k for k, v in CENTER.items()}
    out = {}
    for taxi, seq, x, y in sorted(set(pings)):
        out.setdefault(taxi, []).append((seq, cell[x, y]))
    return out


def changes(pings):
    return sorted((t, s, a, b) for t, h in histories(pings).items() for (_, a), (s, b) in zip(h, h[1:]) if a != b)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [1_000_000, 25, 1])
def test_transitions(spark, limit):
    pings = random_pings(random.Random(limit), 300)
    assert got(transitions(make(spark, pings), GRID, limit=limit)) == changes(pings)


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_deltas_add_up_to_the_members(spark, limit):
    pings = random_pings(random.Random(8), 200)
    deltas = got(cell_deltas(make(spark, pings), GRID, limit=limit))
    first = [(t, h[0][0], "add", h[0][1]) for t, h in histories(pings).items()]
    moved = changes(pings)
    added, gone = [(t, s, "add", b) for t, s, _, b in moved], [(t, s, "del", a) for t, s, a, _ in moved]
    assert deltas == sorted(first + added + gone)
    held = {}
    for taxi, _, op, cell in deltas:
        held[taxi, cell] = held.get((taxi, cell), 0) + (1 if op == "add" else -1)
    assert sorted((c, t) for (t, c), n in held.items() if n) == got(cell_members(make(spark, pings), GRID))


def test_moved_taxis_and_flags(spark):
    pings = random_pings(random.Random(9), 200)
    last = {t: h[-2:] for t, h in histories(pings).items()}
    expected = sorted((t, h[0][1], h[1][1]) for t, h in last.items() if len(h) == 2 and h[0][1] != h[1][1])
    moved = moved_taxis(make(spark, pings), GRID)
    assert got(moved) == expected
    ids = {t for t, _, _ in expected}
    for limit in (32_768, 5):
        flagged = with_moved_flag(make(spark, pings), moved, limit=limit).select("taxi_id", "seq", "moved")
        assert got(flagged) == sorted((p[0], p[1], p[0] in ids) for p in pings)


def test_one_shuffle_for_short_histories(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = transitions(make(spark, [ping(1, 1, 0)]), GRID)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1


def test_edge_cases(spark):
    pings = [ping(1, 1, 0), ping(1, 2, 1), ping(1, 3, 0),  # leaves and returns
             ping(2, 1, 3), ping(2, 2, 3),                 # stays
             ping(3, 5, 4),                                # seen once, outside
             ping(4, 1, 0), ping(4, 2, 4), ping(4, 2, 4)]  # leaves the extent, message repeated
    df = make(spark, pings)
    assert got(transitions(df, GRID)) == [(1, 2, 0, 1), (1, 3, 1, 0), (4, 2, 0, 4)]
    assert got(moved_taxis(df, GRID)) == [(1, 1, 0), (4, 0, 4)]
    assert got(cell_members(df, GRID)) == [(0, 1), (3, 2), (4, 3), (4, 4)]


def test_cell_stats(spark):
    pings = [ping(1, 1, 0), ping(1, 2, 1), ping(2, 3, 1), ping(3, 4, 4)]
    waiting = [(1, 0.5, 0.5), (2, 0.6, 0.6), (3, 1.5, 1.5)]
    clients = spark.createDataFrame(waiting, "client_id long, lon double, lat double")
    names = ["cell", "n_updates", "n_unique", "n_held", "n_clients", "n_to_remove"]
    assert got(cell_stats(make(spark, pings), clients, GRID).select(*names)) == [
        (0, 1, 1, 0, 2, 1), (1, 2, 2, 2, 0, 0), (3, 0, 0, 0, 1, 0), (4, 1, 1, 1, 0, 0)
    ]


def test_latest(spark):
    pings = random_pings(random.Random(10), 200)
    newest = {t: max(p[1:] for p in pings if p[0] == t) for t in {p[0] for p in pings}}
    assert got(latest(make(spark, pings), "taxi_id")) == sorted((t, x, y) for t, (_, x, y) in newest.items())


def test_latest_needs_an_order(spark):
    with pytest.raises(ValueError):
        latest(make(spark, []).drop("seq"), "taxi_id")


def test_latest_aggregates_before_the_shuffle(spark):
    plan = latest(make(spark, [ping(1, 1, 0)]), "taxi_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


@pytest.mark.parametrize("step", [lambda s: s, lambda s: s**3, lambda s: s if s < 990 else 10**12 + s])
def test_a_hot_id_is_cut_into_even_runs(spark, plans, step):
    df = spark.createDataFrame([(0, step(s), s % 7) for s in range(1000)] + [(1, 5, 3)], "id long, seq long, v long")
    rows = with_previous(df, "id", "v", limit=100)
    assert got(rows.where("id = 0")) == [(0, step(s), s % 7, (s - 1) % 7 if s else None) for s in range(1000)]
    assert got(rows.where("id = 1")) == [(1, 5, 3, None)]
    assert any(label == "runs" and "rangepartitioning" in plan and ", 10)" in plan for label, plan in plans)
