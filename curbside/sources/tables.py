"""Taxi and client tables derived from the event and order tables of a data folder.

Coordinates come from integer arithmetic, so every engine computes the same bits. They spread a little wider than the
default grid, which makes overflow, truncation and row-wrap cases occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.operators.state import latest

# fixed values: the multipliers spread the keys of a table over the extent
PING_STEPS = (7919, 104729)
REQUEST_STEPS = (15485863, 32452843)
TAXI_STEPS = (7919, 104729)
CLIENT_STEPS = (15485863, 32452843)


def _spread(key: Column, steps: tuple[int, int]) -> tuple[Column, Column]:
    lon = (F.lit(-7405000) + (key * steps[0]) % 33000).cast("double") / F.lit(100000.0)
    lat = (F.lit(4058000) + (key * steps[1]) % 27000).cast("double") / F.lit(100000.0)
    return lon.alias("lon"), lat.alias("lat")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taxi_id, seq, lon, lat``: one position report per event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("taxi_id"), F.col("event_id").alias("seq"), *_spread(F.col("event_id"), PING_STEPS)
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``client_id, seq, lon, lat``: one request per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("seq"),
        *_spread(F.col("o_orderkey"), REQUEST_STEPS),
    )


def taxis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taxi_id, lon, lat``: the last report of each taxi."""
    return latest(pings(spark, sf_dir), "taxi_id")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``client_id, lon, lat``: the last request of each client."""
    return latest(requests(spark, sf_dir), "client_id")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taxi_id, lon, lat``: a larger fleet, one taxi per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("taxi_id"), *_spread(F.col("o_orderkey"), TAXI_STEPS)
    )


def riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``client_id, lon, lat``: one client per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), *_spread(F.col("c_custkey"), CLIENT_STEPS)
    )


def crowded_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fleet`` with a third of the taxis within 0.0001 degrees and a third on five spots."""
    key, third = F.col("taxi_id"), F.col("taxi_id") % 3
    lon = _near(third, F.lit(-73.9), key * TAXI_STEPS[0]).when(third == 1, F.lit(-73.85) + (key % 5).cast("double") / F.lit(1000.0))
    lat = _near(third, F.lit(40.7), key * TAXI_STEPS[1]).when(third == 1, F.lit(40.65))
    return fleet(spark, sf_dir).select("taxi_id", lon.otherwise(F.col("lon")).alias("lon"), lat.otherwise(F.col("lat")).alias("lat"))


def crowded_riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``riders`` with a third of the clients within 0.0001 degrees and a third far from any taxi."""
    key, third = F.col("client_id"), F.col("client_id") % 3
    lon = _near(third, F.lit(-73.9), key * CLIENT_STEPS[0]).when(third == 1, F.lit(10.0) + (key % 7).cast("double"))
    lat = _near(third, F.lit(40.7), key * CLIENT_STEPS[1]).when(third == 1, F.lit(50.0))
    return riders(spark, sf_dir).select("client_id", lon.otherwise(F.col("lon")).alias("lon"), lat.otherwise(F.col("lat")).alias("lat"))


def _near(third: Column, corner: Column, key: Column) -> Column:
    return F.when(third == 0, corner + (key % 1000).cast("double") / F.lit(1e7))
