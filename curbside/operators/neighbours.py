"""Exact k nearest neighbours without comparing every pair.

The plane is cut into parts with about as many taxis each, however they lie: a bounded sample is halved at its median
again and again, along the axis in which it spreads more, until a part is expected to hold ``part_rows`` taxis. What is
cut too coarsely or too finely costs time, no result depends on it. Two rounds of meetings of clients with parts follow:

1. Every client meets the part it lies in. The k-th distance found there bounds what can be in its list; so do the
   boxes around the taxis of the parts, which say how far k taxis are at most.
2. Clients whose bound reaches into the boxes of further parts meet these.

Inside a meeting the taxis are sorted into leaves of some dozen rows, and clients look only at leaves that their bound
reaches. Parts with many clients are cut into pieces. The number of jobs is fixed, however crowds are nested.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.functions.plane import distance
from curbside.operators.spread import fragment_join, hot_counts
from curbside.session import ship, stage

# Taxis that a part should hold, and clients of a part that meet them in one task.
PART_ROWS, PIECE_ROWS = 8_192, 8_192
# Parts at most; with more taxis than these hold the parts grow.
MAX_PARTS = 4_096
# Rows of the sample per part.
SAMPLE_ROWS = 48
LEAF_ROWS = 32
# Clients whose reach is compared with all boxes at once.
BATCH_ROWS = 1_024
INF = math.inf


@dataclass
class Cuts:
    """A tree of cuts: ``axis`` -1 marks a part, whose number is in ``low``; otherwise ``low`` and ``high`` are nodes."""

    axis: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    parts: int = 0

    @classmethod
    def of(cls, spots: np.ndarray, most: int) -> Cuts:
        """Halve the rows of ``spots`` (x, y) until no part has more than ``most``, or only one spot is left."""
        cuts = cls()
        open_rows = [(spots, -1, False)]
        while open_rows:
            rows, parent, is_high = open_rows.pop()
            node = len(cuts.axis)
            if parent >= 0:
                (cuts.high if is_high else cuts.low)[parent] = node
            # halved before the subtraction, which then can't exceed the range of doubles
            spread = rows.max(axis=0) / 2 - rows.min(axis=0) / 2 if len(rows) else np.zeros(2)
            axis = int(spread.argmax())
            if len(rows) <= most or not spread[axis] > 0:
                cuts._add(-1, 0.0, cuts.parts)
                cuts.parts += 1
                continue
            along = np.sort(rows[:, axis])
            value = along[len(along) // 2]
            value = value if value > along[0] else along[np.searchsorted(along, value, side="right")]
            cuts._add(axis, float(value), -1)
            open_rows += [(rows[rows[:, axis] >= value], node, True), (rows[rows[:, axis] < value], node, False)]
        return cuts

    def _add(self, axis: int, value: float, low: int) -> None:
        for column, entry in zip((self.axis, self.value, self.low, self.high), (axis, value, low, -1)):
            column.append(entry)

    def part(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The part of each finite position."""
        axis, value, low, high = (np.array(c) for c in (self.axis, self.value, self.low, self.high))
        node = np.zeros(len(x), np.int64)
        while (inner := axis[node] >= 0).any():
            own = node[inner]
            below = np.where(axis[own] == 0, x[inner], y[inner]) < value[own]
            node[inner] = np.where(below, low[own], high[own])
        return low[node]


class Leaves:
    """Taxis of one meeting in leaves; a taxi's number is its place in the order of ids."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: int):
        self.x, self.y, self.order = x, y, np.arange(len(x))
        self.nodes: list[tuple] = []  # box, then children, or -1 and the range in ``order``
        self.root = self._build(0, len(x), size)

    def _build(self, start: int, end: int, size: int) -> int:
        own = self.order[start:end]
        x, y = self.x[own], self.y[own]
        box = (x.min(), x.max(), y.min(), y.max())
        if end - start <= size:
            self.nodes.append((box, -1, start, end))
        else:
            middle = (end - start) // 2
            along = x if box[1] / 2 - box[0] / 2 >= box[3] / 2 - box[2] / 2 else y
            self.order[start:end] = own[np.argpartition(along, middle)]
            low, high = self._build(start, start + middle, size), self._build(start + middle, end, size)
            self.nodes.append((box, 0, low, high))
        return len(self.nodes) - 1

    def nearest(self, px: np.ndarray, py: np.ndarray, k: int, bound: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and taxis of the ``k`` nearest per client, no farther than ``bound`` and closer than ``radius``.

        Unused places have an infinite distance.
        """
        self.px, self.py, self.bound, self.radius = px, py, np.minimum(bound, radius), radius
        self.found, self.who = np.full((len(px), k), INF), np.full((len(px), k), np.iinfo(np.int64).max)
        self.home = np.full(len(px), -1)
        if len(self.x) and len(px):
            self._home(self.root, np.arange(len(px)))
            self._visit(self.root, np.arange(len(px)))
        return self.found, self.who

    def _near(self, node: int, clients: np.ndarray) -> np.ndarray:
        x0, x1, y0, y1 = self.nodes[node][0]
        return near(self.px[clients], self.py[clients], x0, x1, y0, y1)

    def _home(self, node: int, clients: np.ndarray) -> None:
        """Each client looks at one leaf first, the one that closer children lead to."""
        _, kind, low, high = self.nodes[node]
        if not len(clients):
            return
        if kind < 0:
            self.home[clients] = node
            self._look(low, high, clients)
            return
        first = self._near(low, clients) <= self._near(high, clients)
        self._home(low, clients[first])
        self._home(high, clients[~first])

    def _visit(self, node: int, clients: np.ndarray) -> None:
        _, kind, low, high = self.nodes[node]
        # a taxi exactly at the bound can win by its id
        clients = clients[self._near(node, clients) <= np.minimum(self.bound[clients], self.found[clients, -1])]
        if kind < 0:
            clients = clients[self.home[clients] != node]
            if len(clients):
                self._look(low, high, clients)
        elif len(clients):
            self._visit(low, clients)
            self._visit(high, clients)

    def _look(self, start: int, end: int, clients: np.ndarray) -> None:
        taxis = self.order[start:end]
        dx, dy = self.x[taxis] - self.px[clients, None], self.y[taxis] - self.py[clients, None]
        dist = np.sqrt(dx * dx + dy * dy)
        dist[(dist > self.bound[clients, None]) | (dist >= self.radius)] = INF
        who = np.where(dist < INF, taxis, np.iinfo(np.int64).max)
        dist = np.concatenate([self.found[clients], dist], axis=1)
        who = np.concatenate([self.who[clients], who], axis=1)
        best = np.lexsort((who, dist))[:, :self.found.shape[1]]
        self.found[clients], self.who[clients] = np.take_along_axis(dist, best, 1), np.take_along_axis(who, best, 1)


def near(px, py, x0, x1, y0, y1):
    """Distance to the closest spot of a box; rounding is monotonic, so no taxi inside it is computed to be closer."""
    dx, dy = np.maximum(np.maximum(x0 - px, px - x1), 0.0), np.maximum(np.maximum(y0 - py, py - y1), 0.0)
    return np.sqrt(dx * dx + dy * dy)


def far(px, py, x0, x1, y0, y1):
    """Distance to the farthest spot of a box; never below the distance to a taxi inside it."""
    dx, dy = np.maximum(np.abs(px - x0), np.abs(x1 - px)), np.maximum(np.abs(py - y0), np.abs(y1 - py))
    return np.sqrt(dx * dx + dy * dy)


@dataclass(frozen=True)
class _Task:
    """Names and limits of one call."""

    client: str
    taxi: str
    by: list[str]
    k: int
    radius: float
    leaf: int
    part: int
    piece: int

    @property
    def who(self) -> list[str]:
        return [*self.by, self.client]

    @property
    def key(self) -> list[str]:
        return [*self.by, "_part"]


def nearest(
    clients: DataFrame, taxis: DataFrame, *, k: int = 4, max_distance: float | None = None, by: tuple[str, ...] = (),
    keep_empty: bool = False, client_id: str = "client_id", taxi_id: str = "taxi_id", x: str = "lon", y: str = "lat",
    copy_inputs: bool = True, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The ``k`` nearest taxis of each client as ``*by, client_id, taxi_id, rk, dist``, nearest first.

    Ties go to the smaller ``taxi_id``. With ``max_distance`` only taxis strictly closer count. With ``by`` a client
    row is matched to the taxis that agree with it on these columns. ``keep_empty`` keeps a client without any taxi as
    one row of NULLs. Rows are expected to be unique by ``(by, id)`` on both sides. NaN distances sort last and rows
    with a missing coordinate match nothing.

    Both inputs are read several times and therefore written to the shared folder first; ``copy_inputs=False`` spares
    that for plain scans. ``leaf_rows``, ``part_rows`` and ``piece_rows`` tune the size of tasks, never the result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if max_distance is not None and not max_distance > 0:
        raise ValueError("max_distance must be positive")
    if max_distance is not None and math.isinf(max_distance):
        raise ValueError("leave max_distance out instead of passing infinity")
    task = _Task(client_id, taxi_id, list(by), k, INF if max_distance is None else float(max_distance),
                 max(leaf_rows, 2 * k), max(part_rows, 2 * k), piece_rows)

    ship(clients.sparkSession)
    riders = clients.select(*task.who, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    rows = taxis.select(*task.by, taxi_id, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    for name in task.by:
        rows = rows.where(F.col(name).isNotNull())
    hits = (F.posexplode_outer if keep_empty else F.posexplode)("_best").alias("_at", "_hit")
    out = [*task.who, f"_hit.{taxi_id}", (F.col("_at") + 1).alias("rk"), "_hit.dist"]
    few = rows.limit(task.part + 1).toArrow()
    if few.num_rows <= task.part:
        return _among_few(task, riders, few, rows.schema[taxi_id].dataType.simpleString()).select(*task.who, hits).select(*out)
    if copy_inputs:
        riders, rows = stage(riders, "clients"), stage(rows, "taxis")
    parts = _Parts(task, rows)
    ordinary = F.coalesce(_finite("_px") & _finite("_py"), F.lit(False))
    lists = _meet(task, parts.placed(riders.where(ordinary), "_px", "_py").withColumn("_bound", F.lit(INF)), parts.rows)
    if parts.boxes:
        first = stage(lists, "first")
        others = _meet(task, stage(parts.reached(first), "reached"), parts.rows)
        lists = _with_more(task, first, others)
    nothing = F.array().cast(lists.schema["_best"].dataType).alias("_best")
    lists = lists.select(*task.who, "_px", "_py", "_best").unionByName(riders.where(~ordinary).select(*task.who, "_px", "_py", nothing))
    if max_distance is None:
        lists = _filled(task, stage(lists, "lists"), rows)
    return lists.select(*task.who, hits).select(*out)


def _best_type(task: _Task, kind: str) -> str:
    return f"array<struct<dist:double,`{task.taxi}`:{kind}>>"


def _as_lists(task: _Task, dist: np.ndarray, who: np.ndarray, held: np.ndarray, ids: pa.Array) -> pa.Array:
    """Lists of ``dist`` and taxi; ``held`` marks the places of a client's row that are used, the first ones."""
    offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
    taken = ids.take(pa.array(who[held])) if held.any() else ids.slice(0, 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(dist[held]), taken], names=["dist", task.taxi]))


def _among_few(task: _Task, riders: DataFrame, few: pa.Table, kind: str) -> DataFrame:
    """``*who, _best`` of all clients, for taxis that fit in one part: they travel with the code, nothing is shuffled."""
    few = few.take(pc.sort_indices(few[task.taxi])) if few.num_rows else few
    ids = few[task.taxi].combine_chunks()
    x, y = (few[c].to_numpy() for c in ("_x", "_y"))
    keys = list(zip(*(few[c].to_pylist() for c in task.by))) if task.by else [()] * len(x)
    groups: dict[tuple, list[int]] = {}
    for row, key in enumerate(keys):
        groups.setdefault(key, []).append(row)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every taxi of a group may fill up a list, only those at finite positions are worth a search
        held = {key: np.array(rows) for key, rows in groups.items()}
        trees = {key: (rows[ok], Leaves(x[rows[ok]], y[rows[ok]], task.leaf) if ok.any() else None)
                 for key, rows in held.items() for ok in [np.isfinite(x[rows]) & np.isfinite(y[rows])]}
        for batch in batches:
            px, py = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_px", "_py"))
            present = ~(np.array(batch.column("_px").is_null()) | np.array(batch.column("_py").is_null()))
            own = list(zip(*(batch.column(c).to_pylist() for c in task.by))) if task.by else None
            dist, who = np.full((len(px), task.k), INF), np.full((len(px), task.k), -1)
            clients_of: dict[tuple, list[int]] = {}
            if own is None:
                clients_of[()] = np.flatnonzero(present)
            else:
                for row in np.flatnonzero(present).tolist():
                    clients_of.setdefault(own[row], []).append(row)
            for key, clients in clients_of.items():
                if key not in trees:
                    continue
                clients = np.asarray(clients)
                rows, tree = trees[key]
                near_ones = clients[np.isfinite(px[clients]) & np.isfinite(py[clients])]
                if tree is not None and len(near_ones):
                    found, places = tree.nearest(px[near_ones], py[near_ones], task.k, np.full(len(near_ones), INF), task.radius)
                    dist[near_ones], who[near_ones] = found, np.where(found < INF, rows[np.minimum(places, len(rows) - 1)], -1)
                short = clients[(who[clients] < 0).any(axis=1)]
                if task.radius == INF and len(short):
                    _complete(task, dist, who, short, px, py, held[key], x, y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in task.who), _as_lists(task, dist, who, who >= 0, ids)], names=[*task.who, "_best"])

    hits = _best_type(task, kind)
    return riders.mapInArrow(search, riders.select(*task.who, F.lit(None).cast(hits).alias("_best")).schema)


def _complete(task: _Task, dist, who, short, px, py, rows, x, y) -> None:
    """Lists that are too short, made of all taxis of the group: those at no finite distance come last, NaN after all."""
    for at in range(0, len(short), BATCH_ROWS):
        clients = short[at:at + BATCH_ROWS]
        with np.errstate(invalid="ignore", over="ignore"):
            dx, dy = x[rows] - px[clients, None], y[rows] - py[clients, None]
            every = np.sqrt(dx * dx + dy * dy)
        order = np.argsort(every, axis=1, kind="stable")[:, :task.k]  # NaN sorts last, equal ones by id
        dist[clients, :order.shape[1]] = np.take_along_axis(every, order, 1)
        who[clients, :order.shape[1]] = rows[order]


def _with_more(task: _Task, lists: DataFrame, more: DataFrame) -> DataFrame:
    """``lists`` with the best of their own hits and those of the rows of ``more`` for the same client."""
    more = more.groupBy(*task.who).agg(F.flatten(F.collect_list("_best")).alias("_more"))
    joined = lists.join(more, task.who, "left")
    every = F.slice(F.sort_array(F.concat("_best", "_more")), 1, task.k)
    return joined.withColumn("_best", F.coalesce(every, "_best")).drop("_more")


def merge_lists(
    lists: DataFrame, *, k: int = 4, client_id: str = "client_id", taxi_id: str = "taxi_id", by: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """One list of ``k`` per client (and ``by``) out of several partial lists, e.g. one per cell or part.

    Rows without a taxi say that the client exists. The group limit trims each client before the shuffle.
    """
    order = Window.partitionBy(client_id, *by).orderBy(F.col("dist").asc_nulls_last(), F.col(taxi_id).asc_nulls_last())
    ranked = lists.select(*by, client_id, taxi_id, "dist").withColumn("rk", F.row_number().over(order))
    found = F.col(taxi_id).isNotNull()
    kept = ranked.where((F.col("rk") <= k) & (found | (F.col("rk") == 1) if keep_empty else found))
    return kept.select(*by, client_id, taxi_id, F.when(found, F.col("rk")).alias("rk"), "dist")


def _finite(name: str) -> Column:
    return F.coalesce(F.abs(name) < F.lit(INF), F.lit(False))


class _Parts:
    """Taxis at finite positions by part, and the boxes of the parts of groups that have more than one."""

    def __init__(self, task: _Task, rows: DataFrame):
        self.task, self.cuts, self.boxes = task, {}, {}
        rows = rows.where(_finite("_x") & _finite("_y"))
        total = rows.count()
        self.size = max(task.part, -(-total // MAX_PARTS))
        self.groups: DataFrame | None = None
        if total > self.size:
            # as a group has more than ``size`` rows, there are at most MAX_PARTS of them
            sizes = rows.groupBy(*task.by).agg(F.count("*").alias("_n")) if task.by else None
            large = sizes.where(F.col("_n") > self.size).collect() if task.by else [()]
            if large:
                self._cut(rows, large, total)
        self.rows = rows.withColumn("_part", F.lit(0))
        if self.groups is not None:
            rows = rows if self.crowds is None else self._trimmed(rows)
            self.rows = stage(self.placed(rows, "_x", "_y"), "parts")
            found = self.rows.join(F.broadcast(self.groups), task.by) if task.by else self.rows.withColumn("_group", F.lit(0))
            boxes = found.groupBy("_group", "_part").agg(
                F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y"), F.count("*")).collect()
            for number in self.cuts:
                own = sorted((tuple(r)[1:] for r in boxes if r[0] == number))
                self.boxes[number] = np.array(own, float).reshape(-1, 6)

    def _cut(self, rows: DataFrame, large: list, total: int) -> None:
        """Cut every large group by its rows in a sample of bounded size."""
        task, spark = self.task, rows.sparkSession
        keys = [tuple(r[c] for c in task.by) for r in large]
        columns = {c: pa.array([key[at] for key in keys]) for at, c in enumerate(task.by)}
        numbers = spark.createDataFrame(pa.table({**columns, "_group": pa.array(range(len(keys)), pa.int32())}))
        self.groups = numbers.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in task.by), "_group")
        share = min(1.0, SAMPLE_ROWS * MAX_PARTS / total, 2.0 * SAMPLE_ROWS * -(-total // self.size) / total)
        picked = F.pmod(F.xxhash64(task.taxi, F.lit(41)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
        sample = rows.where(picked)
        sample = sample.join(F.broadcast(self.groups), task.by) if task.by else sample.withColumn("_group", F.lit(0))
        table = sample.select("_group", "_x", "_y").toArrow()
        group, spots = table["_group"].to_numpy(), np.column_stack([table["_x"].to_numpy(), table["_y"].to_numpy()])
        order = np.lexsort((spots[:, 1], spots[:, 0], group))
        group, spots = group[order], spots[order]
        most = max(1, math.ceil(self.size * share))
        crowds = []
        for number in range(len(keys)):
            own = spots[group == number]
            self.cuts[number] = Cuts.of(own, most)
            if len(own):
                spot, count = np.unique(own, axis=0, return_counts=True)
                crowds += [(number, float(sx), float(sy)) for sx, sy in spot[count > max(2, most // 4)]]
        # spots that alone fill a good part of a part: no more than four for each part
        columns = zip(("_group", "_x", "_y"), (pa.int32(), pa.float64(), pa.float64()), zip(*crowds))
        self.crowds = spark.createDataFrame(pa.table({name: pa.array(column, kind) for name, kind, column in columns})) if crowds else None

    def _trimmed(self, rows: DataFrame) -> DataFrame:
        """Of the taxis on one spot only the k smallest ids can be in a list; the group limit drops others early."""
        task = self.task
        spots = self.crowds.join(F.broadcast(self.groups), "_group").drop("_group") if task.by else self.crowds.drop("_group")
        keys = [*task.by, "_x", "_y"]
        crowded = rows.join(F.broadcast(spots), keys, "left_semi")
        first = Window.partitionBy(*keys).orderBy(task.taxi)
        crowded = crowded.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= task.k).drop("_at")
        return rows.join(F.broadcast(spots), keys, "left_anti").unionByName(crowded)

    def placed(self, rows: DataFrame, x: str, y: str) -> DataFrame:
        """``rows`` with the part that their position is in; a group that isn't cut is part 0."""
        if self.groups is None:
            return rows.withColumn("_part", F.lit(0))
        cuts = self.cuts
        rows = rows.join(F.broadcast(self.groups), self.task.by, "left") if self.task.by else rows.withColumn("_group", F.lit(0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group = batch.column("_group").fill_null(-1).to_numpy(zero_copy_only=False)
                px, py = (batch.column(c).to_numpy(zero_copy_only=False) for c in (x, y))
                part = np.zeros(len(group), np.int32)
                for number in np.unique(group[group >= 0]):
                    own = group == number
                    part[own] = cuts[number].part(px[own], py[own])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "_part"])

        return rows.mapInArrow(place, rows.withColumn("_part", F.lit(0)).schema).drop("_group")

    def reached(self, lists: DataFrame) -> DataFrame:
        """A row for each further part that a client's list can hold taxis of, with the bound on its k-th distance."""
        task, boxes = self.task, self.boxes
        kth = F.coalesce(F.try_element_at("_best", F.lit(task.k))["dist"], F.lit(INF))
        rows = lists.select(*task.who, "_px", "_py", "_part", kth.alias("_bound"))
        rows = rows.join(F.broadcast(self.groups), task.by) if task.by else rows.withColumn("_group", F.lit(0))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_ROWS):
                    batch = whole.slice(at, BATCH_ROWS)
                    group = batch.column("_group").to_numpy()
                    px, py, bound = (batch.column(c).to_numpy() for c in ("_px", "_py", "_bound"))
                    bound, home = bound.copy(), batch.column("_part").to_numpy()
                    who, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                    for number in np.unique(group):
                        own, box = np.flatnonzero(group == number), boxes[number]
                        spots = (px[own, None], py[own, None], *box[:, 1:5].T)
                        low, high = near(*spots), far(*spots)
                        # the closest boxes that hold k taxis together bound the k-th distance
                        order = np.argsort(high, axis=1)
                        held = np.cumsum(box[order, 5], axis=1) >= task.k
                        reached = np.take_along_axis(high, order, 1)[np.arange(len(own)), held.argmax(axis=1)]
                        bound[own] = np.minimum(bound[own], np.where(held[:, -1], reached, INF))
                        hits = (low <= bound[own, None]) & (low < task.radius) & (low < INF) & (box[:, 0] != home[own, None])
                        rows_hit, parts_hit = np.nonzero(hits)
                        who.append(own[rows_hit])
                        part.append(box[parts_hit, 0].astype(np.int32))
                    taken = pa.array(np.concatenate(who))
                    columns = [batch.column(c).take(taken) for c in (*task.who, "_px", "_py")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(part)), pa.array(bound).take(taken)],
                                                     names=[*task.who, "_px", "_py", "_part", "_bound"])

        return rows.mapInArrow(reach, rows.drop("_group").schema)


def _meet(task: _Task, riders: DataFrame, taxis: DataFrame) -> DataFrame:
    """``*who, _px, _py, _part, _best`` of every row of ``riders``: its nearest taxis of its part, up to its bound.

    Both sides have a bounded number of rows in a meeting: parts with many clients are cut into pieces, and the taxis
    of the part are copied to each.
    """
    counts = riders.groupBy(*task.key).agg(F.count("*").alias("_n"))
    hot = hot_counts(counts, task.key, task.piece)
    left, right = riders, taxis.select(*task.key, task.taxi, "_x", "_y")
    if hot is None:
        left, right = left.withColumn("_piece", F.lit(0)), right.withColumn("_piece", F.lit(0))
    else:
        # a fan is at most the number of clients by the size of a piece
        fan = F.coalesce("_fan", F.lit(1))
        piece = F.pmod(F.xxhash64(task.client, F.spark_partition_id()), fan).cast("int")
        left = left.join(hot, task.key, "left").withColumn("_piece", piece).drop("_fan")
        right = right.join(hot, task.key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    kind = taxis.schema[task.taxi].dataType
    out = riders.select(*task.who, "_px", "_py", "_part").schema
    hits = _best_type(task, kind.simpleString())
    schema = riders.select(*task.who, "_px", "_py", "_part", F.lit(None).cast(hits).alias("_best")).schema
    keys = [*task.key, "_piece"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(task, out.names), schema)


def _meeting(task: _Task, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right[task.taxi])) if right.num_rows else right
        px, py, bound = (left[c].to_numpy() for c in ("_px", "_py", "_bound"))
        taxis = [right[c].to_numpy() for c in ("_x", "_y")]
        found = who = np.zeros((len(px), 0))
        if right.num_rows and len(px):
            found, who = Leaves(*taxis, task.leaf).nearest(px, py, task.k, bound, task.radius)
        best = _as_lists(task, found, who, found < INF, right[task.taxi].combine_chunks())
        return pa.table([*(left[c] for c in names), best], names=[*names, "_best"])

    return meet


def _filled(task: _Task, lists: DataFrame, rows: DataFrame) -> DataFrame:
    """Lists that are too short filled up with taxis at no finite distance.

    Such a distance depends only on whether coordinates are finite, infinite or NaN, or is beyond the range of doubles;
    the first k taxis of each kind are all that can be listed.
    """

    def kind(name: str) -> Column:
        value = F.col(name)
        return F.when(F.isnan(value), 3).when(value == INF, 2).when(value == -INF, 1).otherwise(0)

    short = lists.where((F.size("_best") < task.k) & F.col("_px").isNotNull() & F.col("_py").isNotNull())
    if short.isEmpty():
        return lists
    first = Window.partitionBy(*task.by, "_kx", "_ky").orderBy(task.taxi)
    kinds = rows.withColumns({"_kx": kind("_x"), "_ky": kind("_y")}).withColumn("_at", F.row_number().over(first))
    kinds = stage(kinds.where(F.col("_at") <= task.k).withColumn("_root", F.lit(0)).select("_root", *task.by, task.taxi, "_x", "_y"), "kinds")
    keys = ["_root", *task.by]
    # 16 k rows per group at most: the side to copy, and the clients of a group are cut into pieces
    short = short.withColumn("_root", F.lit(0)).drop("_best")
    hot = hot_counts(short.groupBy(*keys).agg(F.count("*").alias("_n")), keys, task.piece)
    dist = distance(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"))
    pairs = fragment_join(short, kinds, keys, [task.client], [], hot, None).withColumn("dist", dist)
    pairs = pairs.where(~(F.abs("dist") < F.lit(INF))).select(*task.who, F.array(F.struct("dist", task.taxi)).alias("_best"))
    return _with_more(task, lists, pairs)
