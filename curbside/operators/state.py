"""Latest row and previous row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbside.operators.spread import hot_keys
from curbside.session import stage

# Rows of one id that are sorted in one task.
ID_ROWS = 1_000_000


def latest(
    df: DataFrame, id_col: str, *, seq_col: str = "seq", value_cols: tuple[str, ...] = ("lon", "lat")
) -> DataFrame:
    """The row with the highest ``seq_col`` of each id.

    One ``max_by`` per column keeps the buffers fixed-width: the plan hash-aggregates before the shuffle, and an id
    with most of the rows costs no more than any other. ``seq_col`` orders the rows of an id, so rows of one id that
    share it have to be copies of one message.
    """
    if seq_col not in df.columns:
        raise ValueError(f"state needs an order column, {seq_col!r} is missing")
    return df.groupBy(id_col).agg(*[F.max_by(c, seq_col).alias(c) for c in value_cols])


def once(df: DataFrame, id_col: str, seq_col: str, value_col: str) -> DataFrame:
    """One row per ``(id, seq)``: copies of a message collapse before the shuffle."""
    return df.groupBy(id_col, seq_col).agg(F.max(value_col).alias(value_col))


def with_previous(
    df: DataFrame, id_col: str, value_col: str, *, seq_col: str = "seq", limit: int = ID_ROWS
) -> DataFrame:
    """``id, seq, value, prev``: every message of an id next to the value of the message before it.

    Ids with more than ``limit`` messages are sorted over many tasks and so cut into runs of consecutive ``seq``. Inside
    a run the previous value is an ordinary ``lag``; the first row of a run takes the last value of the run before,
    looked up in a table with one row per run.
    """
    columns = [id_col, seq_col, value_col]
    hot = hot_keys(df.select(id_col), [id_col], limit)
    # one shuffle by id serves both the copies and the order
    short = df if hot is None else df.join(hot, id_col, "left_anti")
    short = once(short.select(*columns).repartition(id_col), id_col, seq_col, value_col)
    short = short.withColumn("prev", F.lag(value_col).over(Window.partitionBy(id_col).orderBy(seq_col)))
    if hot is None:
        return short

    pieces = hot.agg(F.sum("_fan")).first()[0]
    rows = once(df.join(hot, id_col, "left_semi"), id_col, seq_col, value_col).select(*columns)
    # written down, the number of the task is a property of the row
    runs = rows.repartitionByRange(pieces, id_col, seq_col).withColumn("_run", F.spark_partition_id())
    runs = stage(runs, "runs")
    run = Window.partitionBy(id_col, "_run").orderBy(seq_col)
    lagged = runs.withColumn("prev", F.lag(value_col).over(run)).withColumn("_at", F.row_number().over(run))
    ends = runs.groupBy(id_col, "_run").agg(F.max_by(value_col, seq_col).alias("_end"))
    before = ends.select(
        id_col, "_run", F.lit(1).alias("_at"),
        F.lag("_end").over(Window.partitionBy(id_col).orderBy("_run")).alias("_before"),
    )
    long = lagged.join(before, [id_col, "_run", "_at"], "left")
    return short.unionByName(long.select(*columns, F.coalesce("prev", "_before").alias("prev")))
