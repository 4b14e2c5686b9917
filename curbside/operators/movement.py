"""Cell changes of moving taxis and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbside.functions.grid import Grid
from curbside.operators.spread import KEY_ROWS, skew_join
from curbside.operators.state import ID_ROWS, latest, once, with_previous
from curbside.session import stage


def with_cell(df: DataFrame, grid: Grid, *, x: str = "lon", y: str = "lat", compat: bool = True) -> DataFrame:
    """Add the ``cell`` column; ``compat`` picks the truncating formula over the one that checks each axis."""
    cell = grid.cell_compat if compat else grid.cell
    return df.withColumn("cell", cell(F.col(x), F.col(y)))


def transitions(
    pings: DataFrame, grid: Grid, *, id_col: str = "taxi_id", seq_col: str = "seq", compat: bool = True,
    limit: int = ID_ROWS,
) -> DataFrame:
    """``id, seq, prev, cell``: the pings that put a taxi into another cell than its ping before."""
    moves = _moves(pings, grid, id_col, seq_col, compat, limit)
    return moves.where(F.col("prev") != F.col("cell")).select(id_col, seq_col, "prev", "cell")


def cell_deltas(
    pings: DataFrame, grid: Grid, *, id_col: str = "taxi_id", seq_col: str = "seq", compat: bool = True,
    limit: int = ID_ROWS,
) -> DataFrame:
    """``id, seq, op, cell``: ``add`` at first sight, ``del`` from the old cell and ``add`` to the new at each change."""
    return as_deltas(_moves(pings, grid, id_col, seq_col, compat, limit), id_col, seq_col)


def as_deltas(moves: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``id, seq, op, cell`` of rows ``id, seq, prev, cell``: nothing for a ping that stayed in its cell."""
    add, gone = (F.struct(F.lit(op).alias("op"), F.col(of).alias("cell"))
                 for op, of in (("add", "cell"), ("del", "prev")))
    deltas = F.when(F.col("prev").isNull(), F.array(add)).when(F.col("prev") != F.col("cell"), F.array(gone, add))
    return moves.select(id_col, seq_col, F.inline(deltas))


def moved_taxis(
    pings: DataFrame, grid: Grid, *, id_col: str = "taxi_id", seq_col: str = "seq", compat: bool = True
) -> DataFrame:
    """``id, prev, cell`` of the taxis whose last ping changed their cell.

    Only the last two messages of a taxi count. Each task first keeps its own last two per taxi, copies included, so
    little is shuffled however many messages or copies a taxi has.
    """
    rows = _cells(pings, grid, id_col, seq_col, compat).withColumn("_task", F.spark_partition_id())
    of_task = Window.partitionBy(id_col, "_task").orderBy(F.desc(seq_col))
    newest = Window.partitionBy(id_col).orderBy(F.desc(seq_col))
    # a copy of a message has the rank of the message
    few = once(rows.withColumn("_at", F.dense_rank().over(of_task)).where(F.col("_at") <= 2), id_col, seq_col, "cell")
    return (
        few.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= 2)
        .groupBy(id_col)
        .agg(F.max(F.when(F.col("_at") == 2, F.col("cell"))).alias("prev"),
             F.max(F.when(F.col("_at") == 1, F.col("cell"))).alias("cell"))
        .where(F.col("prev") != F.col("cell"))
    )


def with_moved_flag(
    pings: DataFrame, moved: DataFrame, *, id_col: str = "taxi_id", limit: int = KEY_ROWS
) -> DataFrame:
    """Every ping with the flag ``moved``: whether its taxi is among ``moved`` (one row per taxi)."""
    flags = moved.select(id_col, F.lit(True).alias("moved"))
    joined = skew_join(pings, flags, [id_col], ["seq"], how="left", limit=limit)
    return joined.withColumn("moved", F.coalesce("moved", F.lit(False)))


def cell_members(
    pings: DataFrame, grid: Grid, *, id_col: str = "taxi_id", seq_col: str = "seq", compat: bool = True
) -> DataFrame:
    """``cell, id``: the cell each taxi is in after its last ping."""
    return latest(_cells(pings, grid, id_col, seq_col, compat), id_col, seq_col=seq_col, value_cols=("cell",)).select(
        "cell", id_col
    )


def cell_stats(
    pings: DataFrame, clients: DataFrame, grid: Grid, *, id_col: str = "taxi_id", seq_col: str = "seq",
    compat: bool = True,
) -> DataFrame:
    """Counts per cell: ``n_updates`` pings, ``n_unique`` taxis among them, ``n_held`` taxis now in the cell,
    ``n_clients`` clients, and ``n_to_remove`` taxis whose last ping left the cell."""
    in_cells = _cells(pings, grid, id_col, seq_col, compat)
    # pings count per (taxi, cell) before they count per cell, so no cell is gathered in one task; the last ping of a
    # taxi is in the cell with the highest seq of all
    per_taxi = stage(in_cells.groupBy(id_col, "cell").agg(F.count("*").alias("n"), F.max(seq_col).alias("last")), "per_taxi")
    held = per_taxi.groupBy(id_col).agg(F.max_by("cell", "last").alias("cell"))
    moved = moved_taxis(pings, grid, id_col=id_col, seq_col=seq_col, compat=compat)
    leaving = moved.select(F.col("prev").alias("cell"))
    rows = F.count("*")
    return _by_cell([
        per_taxi.groupBy("cell").agg(F.sum("n").alias("n_updates"), rows.alias("n_unique")),
        held.groupBy("cell").agg(rows.alias("n_held")),
        with_cell(clients, grid, compat=compat).groupBy("cell").agg(rows.alias("n_clients")),
        leaving.groupBy("cell").agg(rows.alias("n_to_remove")),
    ])


def _by_cell(parts: list[DataFrame]) -> DataFrame:
    """Put counts per cell side by side; a missing count is 0."""
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tall.groupBy("cell").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tall.columns if c != "cell"])


def _cells(pings, grid, id_col, seq_col, compat) -> DataFrame:
    return with_cell(pings, grid, compat=compat).select(id_col, seq_col, "cell")


def _moves(pings, grid, id_col, seq_col, compat, limit) -> DataFrame:
    return with_previous(_cells(pings, grid, id_col, seq_col, compat), id_col, "cell", seq_col=seq_col, limit=limit)
