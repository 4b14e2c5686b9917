"""Sinks that give the same rows however often a micro-batch is repeated, and that show whole batches only.

A batch is written to a folder of its own that nobody reads yet. A manifest then names that folder; it gets its place by a
single rename, which also replaces the one of an earlier run of the batch. Readers go by manifests, so they see a batch
as it was or as it is, never a part of it or a gap.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbside.session import _hadoop

MANIFESTS, RUN = "_batches", "run"


def commit(df: DataFrame, out: str, batch_id: int) -> str:
    """Write ``df`` as batch ``batch_id`` of ``out``, in place of an earlier run of it, and return its folder."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    folder = f"{out}/batch_id={batch_id}/{RUN}={run}"
    df.write.parquet(folder)
    fs, made = _hadoop(spark, f"{out}/{MANIFESTS}/.{batch_id}-{run}")
    stream = fs.create(made)
    stream.write(bytearray(run.encode()))
    stream.close()
    _, place = _hadoop(spark, f"{out}/{MANIFESTS}/{batch_id}")
    java = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(java, "Options$Rename"), 1)
    how[0] = getattr(java, "Options$Rename").OVERWRITE
    java.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(place), how)
    return folder


def batch_path(spark: SparkSession, out: str, batch_id: int) -> str:
    """The folder that holds a finished batch."""
    fs, manifest = _hadoop(spark, f"{out}/{MANIFESTS}/{batch_id}")
    stream = fs.open(manifest)
    run = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{out}/batch_id={batch_id}/{RUN}={run}"


def write_batches(out: str, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one folder per batch, replaced if the batch runs again.

    With ``keep`` only so many of the newest batches stay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        commit(batch, out, batch_id)
        if keep:
            drop_batches(batch.sparkSession, out, keep)

    return write


def print_batches(rows: int = 10) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: show the first rows of each batch.

    The order makes every task run, which a stateful batch needs; a plain ``show`` would stop after a few.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        print(f"batch {batch_id}")
        batch.orderBy(*batch.columns).show(rows, truncate=False)

    return show


def finished_batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches that have a manifest."""
    fs, root = _hadoop(spark, f"{out}/{MANIFESTS}")
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit())


def drop_batches(spark: SparkSession, out: str, keep: int) -> None:
    """Delete all but the ``keep`` newest batches."""
    drop_before(spark, out, [*finished_batches(spark, out)[-keep:], 0][0])


def drop_before(spark: SparkSession, out: str, first: int) -> None:
    """Delete the batches before ``first``: the manifest goes first, so that nobody starts to read one."""
    for number in finished_batches(spark, out):
        if number < first:
            for path in (f"{out}/{MANIFESTS}/{number}", f"{out}/batch_id={number}"):
                fs, place = _hadoop(spark, path)
                fs.delete(place, True)


def last_batch(spark: SparkSession, out: str) -> DataFrame:
    """Result of the newest batch."""
    return spark.read.parquet(batch_path(spark, out, finished_batches(spark, out)[-1]))


def all_batches(spark: SparkSession, out: str) -> DataFrame:
    """Results of all batches with their ``batch_id``."""
    folders = [batch_path(spark, out, n) for n in finished_batches(spark, out)]
    return spark.read.option("basePath", out).parquet(*folders).drop(RUN)
