"""The three ways to match the current clients with the current taxis.

They answer the same question with different side effects on the result: which clients without a taxi stay in it, and
whether it is one list per client or one per part or cell. All of them run on ``nearest``, none compares every pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.grid import Grid
from curbside.operators.movement import with_cell
from curbside.operators.neighbours import merge_lists, nearest
from curbside.operators.radius import near_groups
from curbside.session import stage

# fixed values: list length, number of taxi parts, search radius
K = 4
PARTS = 10
RADIUS = 0.5


def match(clients: DataFrame, taxis: DataFrame, method: str = "all", **options) -> DataFrame:
    """Match by the strategy named ``all``, ``parts`` or ``cells``."""
    strategies = {"all": match_all, "parts": match_parts, "cells": match_cells}
    if method not in strategies:
        raise ValueError(f"method must be one of {sorted(strategies)}, not {method!r}")
    return strategies[method](clients, taxis, **options)


def match_all(clients: DataFrame, taxis: DataFrame, *, k: int = K, copy_inputs: bool = True) -> DataFrame:
    """``client_id, taxi_id, rk, dist``; a client without taxis is left out."""
    return nearest(clients, taxis, k=k, copy_inputs=copy_inputs)


def part_lists(
    clients: DataFrame, taxis: DataFrame, *, k: int = K, parts: int = PARTS, copy_inputs: bool = True
) -> DataFrame:
    """``part, client_id, taxi_id, rk, dist``: the nearest taxis of each client within each part of the taxis."""
    every_part = clients.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    taxis = taxis.withColumn("part", F.pmod("taxi_id", F.lit(parts)).cast("int"))
    return nearest(every_part, taxis, k=k, by=("part",), keep_empty=True, copy_inputs=copy_inputs)


def merged_parts(
    clients: DataFrame, taxis: DataFrame, *, k: int = K, parts: int = PARTS, copy_inputs: bool = True
) -> DataFrame:
    """``client_id, taxi_id, rk, dist``: the lists of all parts merged to one list per client."""
    return merge_lists(part_lists(clients, taxis, k=k, parts=parts, copy_inputs=copy_inputs), k=k, keep_empty=True)


def match_parts(clients: DataFrame, taxis: DataFrame, *, k: int = K, copy_inputs: bool = True) -> DataFrame:
    """``client_id, taxi_id, rk, dist`` as merged from the lists of the parts; a client without taxis has one row.

    The nearest of all taxis are the nearest of the nearest of any parts, so one search does and nothing is merged.
    """
    return nearest(clients, taxis, k=k, keep_empty=True, copy_inputs=copy_inputs)


def match_cells(
    clients: DataFrame, taxis: DataFrame, *, grid: Grid = Grid(), k: int = K, max_distance: float = RADIUS,
    compat: bool = True, copy_inputs: bool = True,
) -> DataFrame:
    """``cell, client_id, taxi_id, rk, dist``: a list per client and cell, the overflow cell left out.

    A client without a taxi within ``max_distance`` in a cell is one row of NULLs there. Only clients near taxis of a
    cell search it; the empty pairs, which are rows of the result but no work, are added at the end.
    """
    inside = with_cell(taxis, grid, compat=compat).where(F.col("cell") < grid.overflow).select("cell", "taxi_id", "lon", "lat")
    if copy_inputs:
        clients, inside = stage(clients.select("client_id", "lon", "lat"), "clients"), stage(inside, "taxis")
    searching = stage(near_groups(clients, inside, max_distance, "cell"), "searching")
    found = stage(nearest(searching, inside, k=k, max_distance=max_distance, by=("cell",), copy_inputs=False), "found")
    every = clients.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(grid.overflow - 1))).alias("cell"))
    empty = every.join(found.select("client_id", "cell").distinct(), ["client_id", "cell"], "left_anti")
    nobody = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("taxi_id", "rk", "dist")]
    return found.unionByName(empty.select("cell", "client_id", *nobody))
