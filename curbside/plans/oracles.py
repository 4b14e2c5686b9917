"""Plain SQL with the same results as the queries, for DuckDB over the whole tables."""

from __future__ import annotations

TABLES = """
with pings as (
  select user_id as taxi_id, event_id as seq,
    cast(-7405000 + (event_id * 7919)   % 33000 as double) / cast(100000 as double) as lon,
    cast( 4058000 + (event_id * 104729) % 27000 as double) / cast(100000 as double) as lat
  from events),
reqs as (
  select o_custkey as client_id, o_orderkey as seq,
    cast(-7405000 + (o_orderkey * 15485863) % 33000 as double) / cast(100000 as double) as lon,
    cast( 4058000 + (o_orderkey * 32452843) % 27000 as double) / cast(100000 as double) as lat
  from orders),
fleet as (
  select o_orderkey as taxi_id,
    cast(-7405000 + (o_orderkey * 7919)   % 33000 as double) / cast(100000 as double) as lon,
    cast( 4058000 + (o_orderkey * 104729) % 27000 as double) / cast(100000 as double) as lat
  from orders),
riders as (
  select c_custkey as client_id,
    cast(-7405000 + (c_custkey * 15485863) % 33000 as double) / cast(100000 as double) as lon,
    cast( 4058000 + (c_custkey * 32452843) % 27000 as double) / cast(100000 as double) as lat
  from customer),
taxis as (
  select taxi_id, lon, lat from (
    select *, row_number() over (partition by taxi_id order by seq desc) as rn from pings) where rn = 1),
clients as (
  select client_id, lon, lat from (
    select *, row_number() over (partition by client_id order by seq desc) as rn from reqs) where rn = 1)
"""


def _offset(axis: str, compat: bool) -> str:
    low, high = {"lon": ("-74.02", "-73.76"), "lat": ("40.61", "40.82")}[axis]
    low, high = f"cast({low} as double)", f"cast({high} as double)"
    offset = f"(({axis} - {low}) / (({high} - {low}) / cast(2 as double)))"
    return f"cast(trunc({offset}) as int)" if compat else offset


def _cell(compat: bool = True) -> str:
    ix, iy = _offset("lon", compat), _offset("lat", compat)
    if compat:
        return f"(case when {ix} + {iy} * 2 >= 4 or {ix} + {iy} * 2 < 0 then 4 else {ix} + {iy} * 2 end)"
    inside = f"{ix} >= 0 and {ix} < 2 and {iy} >= 0 and {iy} < 2"
    return f"(case when {inside} then cast(floor({ix}) + floor({iy}) * 2 as int) else 4 end)"


def _dist(a: str, b: str) -> str:
    dx, dy = f"({b}.lon - {a}.lon)", f"({b}.lat - {a}.lat)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


MOVES = f""",
cells as (select taxi_id, seq, {_cell()} as cell from pings),
moves as (
  select taxi_id, seq, cell, lag(cell) over (partition by taxi_id order by seq) as prev,
    row_number() over (partition by taxi_id order by seq desc) as back
  from cells),
moved as (select taxi_id, prev from moves where back = 1 and prev <> cell)
"""

LAST_CELL = "select cell, taxi_id from moves where back = 1"

DELTAS = """select taxi_id, seq, 'add' as op, cell from moves where prev is null or prev <> cell
  union all select taxi_id, seq, 'del' as op, prev as cell from moves where prev <> cell"""


def _pairs(clients: str = "clients", taxis: str = "taxis", where: str = "") -> str:
    return f""",
pairs as (select c.client_id, t.taxi_id, {_dist("c", "t")} as dist from {clients} c, {taxis} t),
ranked as (
  select client_id, taxi_id, dist,
    cast(row_number() over (partition by client_id order by dist, taxi_id) as int) as rk
  from pairs {where})
"""


LIST = "select client_id, taxi_id, rk, dist from ranked where rk <= 4"



def _crowded(name: str, key: str, steps: tuple[int, int], lone: tuple[str, str]) -> str:
    lon, lat = (f"cast({corner} as double) + cast(({key} * {step}) % 1000 as double) / cast(10000000 as double)"
                for corner, step in zip(("-73.9", "40.7"), steps))
    return f"""
  select {key}, case {key} % 3 when 0 then {lon} when 1 then {lone[0]} else lon end as lon,
    case {key} % 3 when 0 then {lat} when 1 then {lone[1]} else lat end as lat from {name}"""


CROWDS = f""",
crowded_fleet as ({_crowded("fleet", "taxi_id", (7919, 104729), (
    "cast(-73.85 as double) + cast(taxi_id % 5 as double) / cast(1000 as double)", "cast(40.65 as double)"))}),
crowded_riders as ({_crowded("riders", "client_id", (15485863, 32452843), (
    "cast(10 as double) + cast(client_id % 7 as double)", "cast(50 as double)"))})
"""

PART_LISTS = f""",
ranked as (
  select c.client_id, t.taxi_id, cast(t.taxi_id % 10 as int) as part, {_dist("c", "t")} as dist,
    cast(row_number() over (partition by c.client_id, t.taxi_id % 10 order by {_dist("c", "t")}, t.taxi_id) as int) as rk
  from clients c, taxis t),
parts as (select cast(range as int) as part from range(10))
select c.client_id, p.part, r.taxi_id, r.rk
from clients c cross join parts p
left join ranked r on r.client_id = c.client_id and r.part = p.part and r.rk <= 4
"""

def _cell_lists(clients: str = "clients", taxis: str = "taxis") -> str:
    return f""",
held as (select taxi_id, lon, lat, {_cell()} as cell from {taxis}),
ranked as (
  select c.client_id, h.taxi_id, h.cell, {_dist("c", "h")} as dist,
    cast(row_number() over (partition by c.client_id, h.cell order by {_dist("c", "h")}, h.taxi_id) as int) as rk
  from {clients} c, held h where {_dist("c", "h")} < cast(0.5 as double)),
grid as (select cast(range as int) as cell from range(4))
select g.cell, c.client_id, r.taxi_id, r.rk, r.dist
from {clients} c cross join grid g
left join ranked r on r.client_id = c.client_id and r.cell = g.cell and r.rk <= 4
"""


CENTERS = f""",
cells as (select lon, lat, {_cell()} as cell from pings),
grid as (
  select cast(range as int) as cell,
    cast(-74.02 as double) + (cast(range % 2 as double) + cast(0.5 as double))
      * ((cast(-73.76 as double) - cast(-74.02 as double)) / cast(2 as double)) as lon,
    cast(40.61 as double) + (cast(range // 2 as double) + cast(0.5 as double))
      * ((cast(40.82 as double) - cast(40.61 as double)) / cast(2 as double)) as lat
  from range(4))
select g.cell, g.lon as center_lon, g.lat as center_lat, count(*) as n,
  min({_dist("g", "c")}) as closest, max({_dist("g", "c")}) as farthest
from grid g join cells c on c.cell = g.cell group by 1, 2, 3
"""

STATS = f""",
updates as (select cell, count(*) as n_updates, count(distinct taxi_id) as n_unique from cells group by cell),
held as (select cell, count(*) as n_held from moves where back = 1 group by cell),
waiting as (select {_cell()} as cell, count(*) as n_clients from clients group by 1),
leaving as (select prev as cell, count(*) as n_to_remove from moved group by 1),
every as (select cell from updates union select cell from waiting)
select e.cell, cast(coalesce(n_updates, 0) as bigint) as n_updates, cast(coalesce(n_unique, 0) as bigint) as n_unique,
  cast(coalesce(n_held, 0) as bigint) as n_held, cast(coalesce(n_clients, 0) as bigint) as n_clients,
  cast(coalesce(n_to_remove, 0) as bigint) as n_to_remove
from every e left join updates on updates.cell = e.cell left join held on held.cell = e.cell
  left join waiting on waiting.cell = e.cell left join leaving on leaving.cell = e.cell
"""

WRAP = "cast(360 as double)"
LON = f"(lon + {WRAP} + cast(180 as double))"

ORACLES = {
    "decode_taxi": TABLES + "select taxi_id, seq, lon, lat from pings",
    "decode_client": TABLES + "select client_id, seq, lon, lat from reqs",
    "drop_malformed": TABLES + "select taxi_id, seq, lon, lat from pings where seq % 10 > 1",
    "malformed": TABLES + "select seq % 10 = 1 as is_json, count(*) as n from pings where seq % 10 <= 1 group by 1",
    "decode_files": TABLES + "select taxi_id, lon, lat from taxis",
    "latest_taxi": TABLES + "select taxi_id, lon, lat from taxis",
    "latest_client": TABLES + "select client_id, lon, lat from clients",
    "distance": TABLES + f"select p.taxi_id, p.seq, {_dist('p', 't')} as dist "
                         "from pings p join taxis t on t.taxi_id = p.taxi_id",
    "normalize_lon": TABLES + f"select seq, round({LON} - {WRAP} * floor({LON} / {WRAP}) - cast(180 as double), 9) as lon, "
                              "lat from pings",
    "grid_cell": TABLES + f"select taxi_id, seq, {_cell(False)} as cell from pings",
    "grid_cell_compat": TABLES + f"select taxi_id, seq, {_cell()} as cell from pings",
    "grid_centers": TABLES + CENTERS,
    "knn_cross": TABLES + _pairs() + LIST,
    "knn_broadcast": TABLES + _pairs() + "select c.client_id, r.taxi_id, r.rk, r.dist from clients c "
                                         "left join ranked r on r.client_id = c.client_id and r.rk <= 4",
    "knn_partial": TABLES + PART_LISTS,
    "knn_merged": TABLES + _pairs() + "select c.client_id, r.taxi_id, r.rk, r.dist from clients c "
                                      "left join ranked r on r.client_id = c.client_id and r.rk <= 4",
    "knn_per_cell": TABLES + _cell_lists(),
    "knn_global": TABLES + _pairs(where="where dist < cast(0.5 as double)") + LIST,
    "knn_grid": TABLES + _pairs() + LIST,
    "knn_fleet": TABLES + _pairs("riders", "fleet") + LIST,
    "knn_fleet_parts": TABLES + _pairs("riders", "fleet") + "select c.client_id, r.taxi_id, r.rk, r.dist from riders c "
                                                            "left join ranked r on r.client_id = c.client_id and r.rk <= 4",
    "knn_fleet_cells": TABLES + _cell_lists("riders", "fleet"),
    "knn_clustered": TABLES + CROWDS + _pairs("crowded_riders", "crowded_fleet") + LIST,
    "knn_within_clustered": TABLES + CROWDS
                            + _pairs("crowded_riders", "crowded_fleet", "where dist < cast(0.02 as double)") + LIST,
    "radius_join": TABLES + _pairs() + "select client_id, taxi_id, dist from pairs where dist < cast(0.02 as double)",
    "knn_within": TABLES + _pairs(where="where dist < cast(0.02 as double)") + LIST,
    "transitions": TABLES + MOVES + "select taxi_id, seq, prev, cell from moves where prev <> cell",
    "moved_taxis": TABLES + MOVES + "select taxi_id from moved",
    "moved_flag_join": TABLES + MOVES + "select p.taxi_id, p.seq, m.taxi_id is not null as moved "
                                        "from pings p left join moved m on m.taxi_id = p.taxi_id",
    "cell_deltas": TABLES + MOVES + DELTAS,
    "cell_members": TABLES + MOVES + LAST_CELL,
    "cell_stats": TABLES + MOVES + STATS,
    "stream_latest": TABLES + "select taxi_id, lon, lat from taxis",
    "stream_changes": TABLES + "select taxi_id, lon, lat from taxis",
    "stream_knn": TABLES + _pairs() + LIST,
    "stream_transitions": TABLES + MOVES + "select taxi_id, seq, prev, cell from moves where prev <> cell",
    "stream_cell_counts": TABLES + MOVES + """
        select g.cell, coalesce(u.n, 0) as n_updates, coalesce(h.n, 0) as n_held from (select cast(range as int) as cell from range(5)) g
        left join (select cell, count(*) as n from cells group by 1) u on u.cell = g.cell
        left join (select cell, count(*) as n from moves where back = 1 group by 1) h on h.cell = g.cell""",
    "stream_late_transitions": TABLES + MOVES + "select taxi_id, seq, prev, cell from moves where prev <> cell",
    "stream_appended": TABLES + "select taxi_id, lon, lat from taxis",
    "stream_deltas": TABLES + MOVES + DELTAS,
    "stream_cell_members": TABLES + MOVES + LAST_CELL,
    "stream_member_changes": TABLES + MOVES + LAST_CELL,
    "stream_knn_incremental": TABLES + _pairs() + LIST,
}
