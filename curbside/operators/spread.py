"""Joins that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.session import stage

# Rows of one key that a single task may take.
KEY_ROWS = 32_768


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The keys with more than ``limit`` rows as ``keys, _fan``, ``_fan`` being the pieces to cut them into.

    At most ``rows / limit`` keys can qualify. ``None`` if there are none.
    """
    return hot_counts(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, limit)


def hot_counts(counts: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """``hot_keys`` of rows that are already counted per key in ``_n``."""
    fan = F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_fan")
    hot = stage(counts.where(F.col("_n") > limit).select(*keys, fan), "hot")
    return None if hot.isEmpty() else hot


def _with_fan(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(hot, keys, "left").withColumn("_fan", F.coalesce("_fan", F.lit(1)))


def _piece(spread_by: list[str]) -> Column:
    # with the number of the task, copies of one row that different tasks read go to different pieces
    return F.pmod(F.xxhash64(*spread_by, F.spark_partition_id()), F.col("_fan")).cast("int")


def _copies() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
    limit: int = KEY_ROWS, keep_piece: bool = False, check: bool = True,
) -> DataFrame:
    """Equi-join with a bounded number of rows per key on the right and any number on the left.

    The rows of a hot left key are cut into pieces by a hash of ``spread_by`` and the few right rows of that key are
    copied to every piece. With ``keep_piece`` the piece number stays in the result as ``_piece``. ``check=False`` says
    that the left side as a whole has no more than ``limit`` rows.
    """
    hot = hot_keys(left, keys, limit) if check else None
    if hot is None:
        joined = left.join(right, keys, how)
        return joined.withColumn("_piece", F.lit(0)) if keep_piece else joined
    left = _with_fan(left, hot, keys).withColumn("_piece", _piece(spread_by)).drop("_fan")
    right = _with_fan(right, hot, keys).withColumn("_piece", _copies()).drop("_fan")
    joined = left.join(right, [*keys, "_piece"], how)
    return joined if keep_piece else joined.drop("_piece")


def fragment_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_by: list[str], right_by: list[str],
    hot_left: DataFrame | None, hot_right: DataFrame | None,
) -> DataFrame:
    """Inner equi-join in which both sides of a key may be large.

    Each side of a hot key is cut into pieces and copied to the pieces of the other side, so that every pair of pieces
    meets in exactly one task. ``hot_left`` and ``hot_right`` are the ``hot_keys`` of the sides.
    """
    keys_out = list(keys)
    if hot_left is not None:
        left = _with_fan(left, hot_left, keys).withColumn("_lp", _piece(left_by)).drop("_fan")
        right = _with_fan(right, hot_left, keys).withColumn("_lp", _copies()).drop("_fan")
        keys_out.append("_lp")
    if hot_right is not None:
        right = _with_fan(right, hot_right, keys).withColumn("_rp", _piece(right_by)).drop("_fan")
        left = _with_fan(left, hot_right, keys).withColumn("_rp", _copies()).drop("_fan")
        keys_out.append("_rp")
    return left.join(right, keys_out, "inner").drop("_lp", "_rp")
