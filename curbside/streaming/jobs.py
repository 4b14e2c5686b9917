"""Streaming jobs: decoded feeds in, one result folder per micro-batch out.

Every job resumes from its checkpoint folder. ``trigger`` is a processing time such as ``"2 seconds"`` or ``None`` to
work off what is there and stop.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbside.functions.grid import Grid
from curbside.operators.movement import with_cell
from curbside.plans.matching import match
from curbside.session import scratch_scope
from curbside.streaming.current import current_table, split, tagged
from curbside.streaming.members import BUCKETS, member_changes
from curbside.streaming.movement import correct_cells, follow_cells
from curbside.streaming.sinks import commit, drop_batches, write_batches

# fixed value: the default micro-batch interval
INTERVAL = "2 seconds"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: off the heap, its changes uploaded to the checkpoint folder."""
    wanted = {_PROVIDER: _ROCKSDB, _CHANGELOG: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start_matching(
    taxis: DataFrame, clients: DataFrame, out: str, checkpoint: str, *, method: str = "all",
    trigger: str | None = INTERVAL, then: Callable[[DataFrame, int], None] | None = None, keep: int | None = None,
    **options,
) -> StreamingQuery:
    """Match all current clients with all current taxis in every micro-batch.

    Each batch gives ``out/state`` (the current tables) and ``out/matches`` (the result of the strategy), which is then
    handed to ``then``, e.g. ``print_batches()``. With ``keep`` only so many of the newest folders of each stay.
    """

    def run(current: DataFrame, batch_id: int) -> None:
        spark = current.sparkSession
        # written once and read back: the strategies read the tables several times
        state = commit(current, f"{out}/state", batch_id)
        with scratch_scope(spark):
            table = spark.read.schema(current.schema).parquet(state)
            found = match(*split(table), method=method, copy_inputs=False, **options)
            matches = commit(found, f"{out}/matches", batch_id)
            if then:
                then(spark.read.schema(found.schema).parquet(matches), batch_id)
        if keep:
            drop_batches(spark, f"{out}/state", keep)
            drop_batches(spark, f"{out}/matches", keep)

    return _start(current_table(tagged(taxis, clients)), run, checkpoint, "complete", trigger)


def start_latest(
    rows: DataFrame, id_col: str, out: str, checkpoint: str, *, changes_only: bool = False,
    trigger: str | None = INTERVAL, keep: int | None = None,
) -> StreamingQuery:
    """The whole current table of one feed (``id, lon, lat, seq``) with every micro-batch.

    With ``changes_only`` just the rows of the ids heard of, for tables too large to be written each time; ``latest``
    over all batches is then the current table.
    """
    current = rows.groupBy(id_col).agg(
        F.max_by("lon", "seq").alias("lon"), F.max_by("lat", "seq").alias("lat"), F.max("seq").alias("seq")
    )
    return _start(current, write_batches(out, keep), checkpoint, "update" if changes_only else "complete", trigger)


def start_cell_members(
    pings: DataFrame, grid: Grid, out: str, checkpoint: str, *, compat: bool = True, trigger: str | None = INTERVAL,
    keep: int | None = None,
) -> StreamingQuery:
    """The members of every cell (``cell, taxi_id, seq``) with every micro-batch.

    The state is the cell of each taxi and not the taxis of each cell: a move replaces one row, no cell is ever
    gathered in one place, and a taxi cannot be in two cells.
    """
    cells = with_cell(pings, grid, compat=compat)
    members = cells.groupBy("taxi_id").agg(F.max_by("cell", "seq").alias("cell"), F.max("seq").alias("seq"))
    return _start(members.select("cell", "taxi_id", "seq"), write_batches(out, keep), checkpoint, "complete", trigger)


def start_member_changes(
    pings: DataFrame, grid: Grid, out: str, checkpoint: str, *, compat: bool = True, trigger: str | None = INTERVAL,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Who came into a cell or left it (``cell, taxi_id, seq, op``) with every micro-batch; see ``fold_members``."""
    changes = member_changes(pings, grid, compat=compat, buckets=buckets)
    return _start(changes, write_batches(out), checkpoint, "append", trigger)


def start_transitions(
    pings: DataFrame, grid: Grid, out: str, checkpoint: str, *, deltas: bool = False, compat: bool = True,
    trigger: str | None = INTERVAL, keep: int | None = None, history: int | None = None, counts: bool = False,
) -> StreamingQuery:
    """The cell changes of each micro-batch, or with ``deltas`` the ``add`` and ``del`` rows they stand for.

    Pings older than the last one of their taxi can't change what was already written; they go to ``out/_late``. With
    ``history`` they can, among so many last pings of each taxi: see ``correct_cells``. With ``counts`` every micro-batch also
    has its counts per cell, see ``live_counts``.
    """
    if history:
        return _start(pings, correct_cells(grid, out, depth=history, compat=compat), checkpoint, "append", trigger)
    return _start(pings, follow_cells(grid, out, deltas=deltas, compat=compat, keep=keep, counts=counts), checkpoint, "append", trigger)


def _start(
    df: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, mode: str, trigger: str | None
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    with rocksdb(df.sparkSession):
        return writer.start()
