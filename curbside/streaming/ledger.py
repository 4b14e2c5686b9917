"""Tables by key that grow by changes: what a micro-batch writes follows what it changed.

A ledger is a base, the whole table as of some micro-batch, and the changes of each micro-batch since. It is merged when it
is read; every so many micro-batches the merged table becomes the next base. A micro-batch reads the ledger as of the one
before it, whose files no later one touches, so a repeated micro-batch finds what it found the first time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.streaming.sinks import batch_path, commit, drop_before, finished_batches

BASE, CHANGES = "base", "changes"
# Micro-batches of changes that a reader merges at most.
COMPACT = 10


@dataclass(frozen=True)
class Ledger:
    """The newest row per ``keys`` by the column ``order``, with the columns ``values``.

    ``schema`` is of keys, order and values. Of rows of one key the one with the highest ``order`` counts, so rows of one
    key that share it have to be copies.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    order: str = "seq"
    every: int = COMPACT

    def append(self, changes: DataFrame, batch_id: int) -> None:
        """Add the changed rows of a micro-batch, and at times write the next base."""
        spark = changes.sparkSession
        commit(changes.select(*self._columns(spark)), f"{self.path}/{CHANGES}", batch_id)
        bases = [n for n in finished_batches(spark, f"{self.path}/{BASE}") if n < batch_id]
        if batch_id - (bases[-1] if bases else -1) >= self.every:
            commit(self.as_of(spark, batch_id), f"{self.path}/{BASE}", batch_id)
            # a repeated micro-batch may still need the base before
            if bases:
                drop_before(spark, f"{self.path}/{BASE}", bases[-1])
                drop_before(spark, f"{self.path}/{CHANGES}", bases[-1] + 1)

    def changed(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows that a finished micro-batch added."""
        return spark.read.schema(self.schema).parquet(batch_path(spark, f"{self.path}/{CHANGES}", batch_id))

    def as_of(self, spark: SparkSession, batch_id: int, only: DataFrame | None = None) -> DataFrame:
        """The table after ``batch_id``, or the rows whose key is in ``only`` (keys, no repeated ones)."""
        bases = [n for n in finished_batches(spark, f"{self.path}/{BASE}") if n <= batch_id]
        since = bases[-1] if bases else -1
        folders = [batch_path(spark, f"{self.path}/{BASE}", since)] if bases else []
        folders += [batch_path(spark, f"{self.path}/{CHANGES}", n)
                    for n in finished_batches(spark, f"{self.path}/{CHANGES}") if since < n <= batch_id]
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*folders)
        if only is not None:
            rows = rows.join(only.select(*self.keys), [*self.keys], "left_semi")
        if len(folders) == 1:
            return rows
        values = [c for c in self._columns(spark) if c not in (*self.keys, self.order)]
        newest = rows.groupBy(*self.keys).agg(*[F.max_by(c, self.order).alias(c) for c in values], F.max(self.order).alias(self.order))
        return newest.select(*self._columns(spark))

    def _columns(self, spark: SparkSession) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]
