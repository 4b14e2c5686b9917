"""Cell changes per micro-batch, by the batch operators and a ledger of last cells.

Each micro-batch looks up the last ``seq`` and cell of its taxis as the micro-batch before left them, puts them before its
own pings, and adds what changed to the ledger. A repeated micro-batch finds the same and so gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from curbside.functions.grid import Grid
from curbside.operators.movement import as_deltas, with_cell
from curbside.operators.state import ID_ROWS, with_previous
from curbside.session import scratch_scope, stage
from curbside.streaming.ledger import COMPACT, Ledger
from curbside.streaming.sinks import all_batches, commit, drop_batches

# side tables of a result folder; readers of the folder pass over names with an underscore
LAST, LATE, COUNTS = "_last", "_late", "_counts"
COUNTED, COUNTS_SCHEMA = ("updates", "came", "left"), "cell int, updates long, came long, left long"
# Cells that are counted side by side.
MOST_CELLS = 1_000


def last_cells(out: str, every: int = COMPACT) -> Ledger:
    return Ledger(f"{out}/{LAST}", "taxi_id long, seq long, cell int", ("taxi_id",), every=every)


def follow_cells(
    grid: Grid, out: str, *, deltas: bool = False, compat: bool = True, keep: int | None = None, limit: int = ID_ROWS,
    every: int = COMPACT, counts: bool = False,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for pings ``taxi_id, seq, lon, lat``.

    Writes the changes to ``out``, the last cells of changed taxis to the ledger ``out/_last`` and the pings that came too late to take part (older
    than the last one of their taxi in an earlier micro-batch) to ``out/_late``. ``keep`` bounds the number of folders.
    With ``counts`` the counts per cell (see ``live_counts``) are taken while these are written, without another pass.
    """
    if counts and grid.count > MOST_CELLS:
        raise ValueError(f"counts are for grids of at most {MOST_CELLS} cells")

    ledger = last_cells(out, every)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            told, moved = Observation(), Observation()
            pings = with_cell(batch, grid, compat=compat).select("taxi_id", "seq", "cell")
            if counts:
                pings = pings.observe(told, *_per_cell(grid, "updates", F.col("cell"), F.lit(True)))
            pings = stage(pings.distinct(), "pings")
            seeds = stage(ledger.as_of(spark, batch_id - 1, pings.select("taxi_id").distinct()), "seeds")
            known = seeds.select("taxi_id", F.col("seq").alias("_seq"))
            aged = stage(pings.join(known, "taxi_id", "left").withColumn("_late", F.coalesce(F.col("seq") <= F.col("_seq"), F.lit(False))), "aged")
            late = aged.where("_late and seq < _seq").select("taxi_id", "seq", "cell")
            fresh = aged.where("not _late").select("taxi_id", "seq", "cell")
            # taxis of which nothing new was heard take no part in the search for changes
            seeds = seeds.join(fresh.select("taxi_id").distinct(), "taxi_id", "left_semi")
            moves = with_previous(fresh.unionByName(seeds), "taxi_id", "cell", limit=limit)
            moves = moves.join(seeds.select("taxi_id", "seq", F.lit(True).alias("_seed")), ["taxi_id", "seq"], "left").where("_seed is null")
            if counts:
                came = F.col("prev").isNull() | (F.col("prev") != F.col("cell"))
                moves = moves.observe(moved, *_per_cell(grid, "came", F.col("cell"), came),
                                      *_per_cell(grid, "left", F.col("prev"), F.col("prev") != F.col("cell")))
            changes = as_deltas(moves, "taxi_id", "seq") if deltas else moves.where("prev <> cell").select("taxi_id", "seq", "prev", "cell")
            now = fresh.groupBy("taxi_id").agg(F.max("seq").alias("seq"), F.max_by("cell", "seq").alias("cell"))
            commit(changes, out, batch_id)
            commit(late, f"{out}/{LATE}", batch_id)
            ledger.append(now, batch_id)
            if counts:
                seen = {**told.get, **moved.get}
                rows = [(cell, *(seen[f"{name}_{cell}"] for name in COUNTED)) for cell in range(grid.count)]
                commit(spark.createDataFrame(rows, COUNTS_SCHEMA), f"{out}/{COUNTS}", batch_id)
        if keep:
            drop_batches(spark, out, keep)
            drop_batches(spark, f"{out}/{LATE}", keep)

    return run


def _per_cell(grid: Grid, name: str, cell: Column, counts: Column) -> list[Column]:
    return [F.count_if((cell == number) & counts).alias(f"{name}_{number}") for number in range(grid.count)]


def live_counts(spark: SparkSession, out: str) -> DataFrame:
    """``cell, n_updates, n_held, n_left`` after the newest micro-batch: pings, taxis now in the cell, departures from it.

    For a stream of ``follow_cells`` with ``counts``; a micro-batch has one small row per cell.
    """
    per_batch = all_batches(spark, f"{out}/{COUNTS}")
    return per_batch.groupBy("cell").agg(
        F.sum("updates").alias("n_updates"), F.sum(F.col("came") - F.col("left")).alias("n_held"), F.sum("left").alias("n_left"))


def history(out: str, every: int = COMPACT) -> Ledger:
    """The last messages of each taxi, oldest first, and whether there were more."""
    schema = "taxi_id long, batch long, pings array<struct<seq:bigint,cell:int>>, more boolean"
    return Ledger(f"{out}/_history", schema, ("taxi_id",), "batch", every)


def correct_cells(
    grid: Grid, out: str, *, depth: int, compat: bool = True, limit: int = ID_ROWS, every: int = COMPACT
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for pings that may come late: ``taxi_id, seq, prev, cell, op`` of changed changes.

    A late ping takes its place among the last ``depth`` ones of its taxi. What this makes of the cell changes around it is
    told as ``retract`` of the old and ``insert`` of the new ones; see ``fold_transitions``. Pings older than all that is
    known of a taxi that had more go to ``out/_late``. Repeated pings change nothing.
    """
    ledger = history(out, every)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            pings = stage(with_cell(batch, grid, compat=compat).select("taxi_id", "seq", "cell").distinct(), "pings")
            old = stage(ledger.as_of(spark, batch_id - 1, pings.select("taxi_id").distinct()), "old")
            known = stage(old.select("taxi_id", F.inline("pings")).select("taxi_id", "seq", "cell"), "known")
            first = old.where("more").select("taxi_id", F.element_at("pings", 1)["seq"].alias("_first"))
            told = pings.join(first, "taxi_id", "left").withColumn("_late", F.coalesce(F.col("seq") < F.col("_first"), F.lit(False)))
            fresh = told.where("not _late").select("taxi_id", "seq", "cell").join(known.select("taxi_id", "seq"), ["taxi_id", "seq"], "left_anti")
            fresh = stage(fresh, "fresh")
            # taxis of which nothing new was heard stay as they are
            known = known.join(fresh.select("taxi_id").distinct(), "taxi_id", "left_semi")
            every_ping = stage(known.unionByName(fresh), "all")
            change = ["taxi_id", "seq", "prev", "cell"]
            after, before = (stage(with_previous(rows, "taxi_id", "cell", limit=limit).where("prev <> cell").select(*change), "moves")
                             for rows in (every_ping, known))
            changes = after.join(before, change, "left_anti").withColumn("op", F.lit("insert")).unionByName(
                before.join(after, change, "left_anti").withColumn("op", F.lit("retract")))
            commit(changes, out, batch_id)
            commit(told.where("_late").select("taxi_id", "seq", "cell"), f"{out}/{LATE}", batch_id)
            newest = Window.partitionBy("taxi_id").orderBy(F.desc("seq"))
            kept = every_ping.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= depth)
            kept = kept.groupBy("taxi_id").agg(F.sort_array(F.collect_list(F.struct("seq", "cell"))).alias("pings"))
            sizes = every_ping.groupBy("taxi_id").agg(F.count("*").alias("_n")).join(old.select("taxi_id", "more"), "taxi_id", "left")
            sizes = sizes.select("taxi_id", (F.coalesce("more", F.lit(False)) | (F.col("_n") > depth)).alias("more"))
            ledger.append(kept.join(sizes, "taxi_id").withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return run


def fold_transitions(changes: DataFrame) -> DataFrame:
    """``taxi_id, seq, prev, cell``: the cell changes that stand after all ``insert`` and ``retract`` rows."""
    sign = F.when(F.col("op") == "insert", 1).otherwise(-1)
    standing = changes.groupBy("taxi_id", "seq", "prev", "cell").agg(F.sum(sign).alias("_n")).where("_n > 0")
    return standing.select("taxi_id", "seq", "prev", "cell")
