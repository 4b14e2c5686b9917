"""Members of cells as keyed state: only what changed leaves a micro-batch.

Two stateful steps in a row. The first knows the last message of each taxi and hands on ``add`` and ``del`` rows; the second
knows the members of each cell, a map per (cell, bucket of the taxi's id), so that the members of a crowded cell are spread
over buckets. A taxi is in the cell of its last message; late and repeated messages change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from curbside.functions.grid import Grid
from curbside.operators.movement import with_cell

BUCKETS = 64

# the process that asks a handler for its state runs beside the driver and has no files of the application
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SEEN = StructType([StructField("seq", LongType()), StructField("cell", IntegerType())])
_MEMBER = StructType([StructField("taxi_id", LongType())])
_SINCE = StructType([StructField("seq", LongType())])
DELTAS = StructType([StructField("cell", IntegerType()), StructField("bucket", IntegerType()), StructField("taxi_id", LongType()),
                     StructField("seq", LongType()), StructField("op", StringType())])
CHANGES = StructType([StructField("cell", IntegerType()), StructField("taxi_id", LongType()), StructField("seq", LongType()),
                      StructField("op", StringType())])


class LastCell(StatefulProcessor):
    """``add`` and ``del`` rows of the taxis that are in another cell after a micro-batch than before."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        taxi = int(key[0])
        before = self.seen.get() if self.seen.exists() else None
        last = before
        for frame in rows:
            newest = frame.loc[frame["seq"].idxmax()]
            if last is None or int(newest["seq"]) > last[0]:
                last = (int(newest["seq"]), int(newest["cell"]))
        if last is not None and last != before:
            self.seen.update(last)
        changes = []
        if last is not None and (before is None or before[1] != last[1]):
            bucket = taxi % self.buckets
            if before is not None:
                changes.append((before[1], bucket, taxi, last[0], "del"))
            changes.append((last[1], bucket, taxi, last[0], "add"))
        yield pd.DataFrame(changes, columns=DELTAS.names)

    def close(self) -> None:
        pass


class Members(StatefulProcessor):
    """Members of a (cell, bucket); hands on who came in and who left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", _MEMBER, _SINCE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        changes = []
        for frame in rows:
            # a taxi has at most one row per cell and micro-batch
            for taxi, seq, op in zip(frame["taxi_id"], frame["seq"], frame["op"]):
                member, held = (int(taxi),), self.members.containsKey((int(taxi),))
                if op == "add":
                    self.members.updateValue(member, (int(seq),))
                elif held:
                    self.members.removeKey(member)
                if held != (op == "add"):
                    changes.append((int(key[0]), int(taxi), int(seq), "in" if op == "add" else "out"))
        yield pd.DataFrame(changes, columns=CHANGES.names)

    def close(self) -> None:
        pass


def member_changes(pings: DataFrame, grid: Grid, *, compat: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The stream ``cell, taxi_id, seq, op``: taxis that came ``in`` or went ``out`` with each micro-batch."""
    cells = with_cell(pings, grid, compat=compat).select("taxi_id", "seq", "cell")
    deltas = cells.groupBy("taxi_id").transformWithStateInPandas(LastCell(buckets), DELTAS, "Append", "None")
    return deltas.groupBy("cell", "bucket").transformWithStateInPandas(Members(), CHANGES, "Append", "None")


def fold_members(changes: DataFrame) -> DataFrame:
    """``cell, taxi_id``: who is in which cell after all ``changes``."""
    last = Window.partitionBy("cell", "taxi_id").orderBy(F.desc("seq"))
    rows = changes.withColumn("_at", F.row_number().over(last)).where("_at = 1 and op = 'in'")
    return rows.select("cell", "taxi_id")
