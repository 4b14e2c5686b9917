"""Repair of the roles of conversations at the lowest cost, and their rendering.

The automaton knows which role may follow which: an optional system turn, then user and assistant by turns, the last one
being the assistant's. Each source turn is kept, merged into the turn before, or given another role, and empty turns are
put in before it or at the end. The cheapest way for a run of turns is a matrix: from each last role before the run to
each last role after it. Such matrices multiply (minimum of sums), so long conversations are cut into runs, runs into
runs of runs, and the way through all of them is chosen from the top down. No task ever holds more than a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import read
from curbside.session import stage

ROLES = ("start", "system", "user", "assistant")
FOLLOWS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LAST = "assistant"
MERGE, INSERT, RELABEL = 1, 2, 3
#: Numbers of turns (or of runs) in a run.
RUN = 256
START = 0
STATES = len(ROLES)
FAR = np.inf


def _inserted() -> list[list[list[int] | None]]:
    """Shortest legal series of empty turns from one role to the turn before another: ``[from][to]``."""
    ways: list[list[list[int] | None]] = [[None] * STATES for _ in ROLES]
    for begin in range(STATES):
        ways[begin][begin] = []
        line = [begin]
        for at in line:
            for name in FOLLOWS[ROLES[at]]:
                to = ROLES.index(name)
                if ways[begin][to] is None:
                    ways[begin][to] = ways[begin][at] + [to]
                    line.append(to)
    return ways


WAYS = _inserted()


def moves(role: str | None) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, list[int]]]]:
    """Cost of taking in one turn, from each last role to each next one, and how: an action and the empty turns before.

    A role outside the automaton has to be changed. Of equally cheap ways the first of keep, merge, relabel is taken,
    then the one with fewer empty turns.
    """
    cost, how = np.full((STATES, STATES), FAR), {}
    for p in range(STATES):
        for q in range(1, STATES):
            change = 0 if ROLES[q] == role else RELABEL
            options = []
            if p == q:
                options.append((MERGE + change, 1, "merge", []))
            for before in range(STATES):
                way = WAYS[p][before]
                if way is not None and ROLES[q] in FOLLOWS[ROLES[before]]:
                    options.append((INSERT * len(way) + change, 2 if change else 0, "relabel" if change else "keep", way))
            if options:
                best = min(options, key=lambda o: (o[0], o[1], len(o[3])))
                cost[p, q], how[p, q] = best[0], best[2:]
    return cost, how


KNOWN = {role: moves(role) for role in (*ROLES[1:], None)}
END = np.array([INSERT * len(WAYS[p][ROLES.index(LAST)]) if WAYS[p][ROLES.index(LAST)] is not None and p != START else FAR for p in range(STATES)])


def taken(role: str | None) -> tuple[np.ndarray, dict]:
    return KNOWN.get(role, KNOWN[None])


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Cheapest way through several matrices, one after another."""
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m[None]).min(axis=1)
    return total


def states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The role after each matrix on the cheapest way from ``first`` to ``last``; of equal ones the lowest in order."""
    costs = [np.where(np.arange(STATES) == first, 0, FAR)]
    for m in matrices[:-1]:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    out = [last]
    for m, cost in zip(reversed(matrices[1:]), reversed(costs[1:])):
        out.append(int(np.argmin(cost + m[:, out[-1]])))
    return out[::-1]


class Row(NamedTuple):
    """A turn or a run of turns; each step fills what it needs."""

    conv_id: int | None
    run: int
    at: int | None = None
    turn: int | None = None
    role: str | None = None
    text: str | None = None
    matrix: list[float] | None = None
    first: int | None = None
    last: int | None = None
    closes: bool | None = None


def _runs(rows: DataFrame, order: list[str], work: Callable[[list[Row]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of every (``conv_id``, ``run``), in order. A task streams through its runs."""
    dealt = rows.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", *order)
    names = [column.split()[0] for column in schema.split(", ")]
    kinds = [KINDS[column.split()[1]] for column in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(names), kinds)], names=names)

        held: list[Row] = []
        for batch in batches:
            out: list[tuple] = []
            used = [name for name in batch.schema.names if name in Row._fields]
            for values in zip(*(batch.column(name).to_pylist() for name in used)):
                row = Row(**dict(zip(used, values)))
                if held and row[:2] != held[0][:2]:
                    out += work(held)
                    held = []
                held.append(row)
            yield made(out)
        if held:
            yield made(work(held))

    return dealt.mapInArrow(apply, schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
MATRIX = "conv_id long, at long, matrix array<double>"


def _matrix_of_turns(run: list[Row]) -> list[tuple]:
    return [(run[0].conv_id, run[0].run, product([taken(row.role)[0] for row in run]).ravel().tolist())]


def _matrices(run: list[Row]) -> list[np.ndarray]:
    return [np.array(row.matrix).reshape(STATES, STATES) for row in run]


def _matrix_of_runs(run: list[Row]) -> list[tuple]:
    return [(run[0].conv_id, run[0].run, product(_matrices(run)).ravel().tolist())]


def _ways_of_runs(run: list[Row]) -> list[tuple]:
    found = states(_matrices(run), run[0].first, run[0].last)
    return [(row.conv_id, row.at, first, last) for row, first, last in zip(run, [run[0].first, *found], found)]


PIECES = "conv_id long, turn long, piece int, role string, action string, cost int, rendered string"


def _pieces(run: list[Row]) -> list[tuple]:
    out: list[tuple] = []
    before = run[0].first

    def add(row: Row, piece: int, state: int, action: str, cost: int, text: str) -> None:
        opened = "\n" + text if action == "merge" else ("" if before == START else "<|end|>\n") + f"<|{ROLES[state]}|>\n{text}"
        out.append((row.conv_id, row.turn, piece, ROLES[state], action, cost, opened))

    for row, state in zip(run, states([taken(row.role)[0] for row in run], before, run[0].last)):
        action, empty = taken(row.role)[1][before, state]
        for k, own in enumerate(empty):
            add(row, k, own, "insert", INSERT, "")
            before = own
        cost = RELABEL * (ROLES[state] != row.role) + MERGE * (action == "merge")
        add(row, len(empty), state, action, cost, row.text)
        before = state
    if run[0].closes:
        for own in WAYS[before][ROLES.index(LAST)]:
            add(run[-1], out[-1][2] + 1, own, "insert", INSERT, "")
            before = own
        out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
    return out


def repair(conversations: DataFrame, run: int = RUN) -> DataFrame:
    """Pieces of the repaired and rendered conversations: put together by ``turn`` and ``piece`` they are the text.

    ``action`` says what became of a source turn (keep, merge, relabel) or that an empty turn was put in (insert);
    ``cost`` adds up to the lowest one possible. Turns go by ``turn``, a null one first; turns of the same number by
    role and text. Rows that repeat all of ``conv_id``, ``turn``, ``role`` and ``text`` count once. A null text is empty,
    a role is read without case and white space, a null or unknown one is changed. Rows with a null ``conv_id`` are one
    conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    low, high = rows.agg(F.min("turn"), F.max("turn")).first()
    low, levels = low or 0, 1
    while run**levels <= (high or 0) - low + 1:
        levels += 1
    once = rows.distinct().withColumn("at", F.coalesce(F.col("turn") - low + 1, F.lit(0)))
    turns = once.withColumn("run", F.floor(F.col("at") / run))
    order = ["at", "role", "text"]
    sized = []  # the matrices of each level, as rows (conv_id, at, matrix)
    below = _runs(turns, order, _matrix_of_turns, MATRIX)
    for _ in range(levels - 1):
        sized.append(stage(below, "runs"))
        below = _runs(sized[-1].withColumn("run", F.floor(F.col("at") / run)), ["at"], _matrix_of_runs, MATRIX)
    # the whole conversation begins with the start and ends where the closing turns cost least
    ends = F.array(*(F.element_at("matrix", START * STATES + q + 1) + F.lit(float(END[q])) for q in range(STATES)))
    ways = below.select("conv_id", "at", F.lit(START).alias("first"), (F.array_position(ends, F.array_min(ends)) - 1).cast("int").alias("last"))
    for matrices in reversed(sized):
        parts = matrices.withColumn("run", F.floor(F.col("at") / run))
        ways = _runs(_with_ways(parts, ways), ["at"], _ways_of_runs, "conv_id long, at long, first int, last int")
    closing = once.groupBy("conv_id").agg(F.floor(F.max("at") / run).alias("final"))
    told = _with_ways(turns, ways).alias("t").join(closing.alias("c"), F.expr("t.conv_id <=> c.conv_id")).select(
        "t.*", (F.col("run") == F.col("final")).alias("closes"))
    return _runs(told, order, _pieces, PIECES)


def _with_ways(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows of runs with the roles before and after their run."""
    return rows.alias("r").join(ways.alias("w"), F.expr("r.conv_id <=> w.conv_id and r.run = w.at")).select("r.*", "w.first", "w.last")


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))
