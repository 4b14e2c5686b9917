"""Current tables of both feeds as one streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAXI, CLIENT = "taxi", "client"


def tagged(taxis: DataFrame, clients: DataFrame) -> DataFrame:
    """Both decoded feeds as ``kind, id, seq, lon, lat``. One stream keeps one state and one batch for both."""
    parts = [
        df.select(F.lit(kind).alias("kind"), F.col(id_col).alias("id"), "seq", "lon", "lat")
        for df, kind, id_col in ((taxis, TAXI, "taxi_id"), (clients, CLIENT, "client_id"))
    ]
    return parts[0].unionByName(parts[1])


def current_table(rows: DataFrame) -> DataFrame:
    """Last position per ``kind, id``; late or repeated messages change nothing."""
    return rows.groupBy("kind", "id").agg(
        F.max_by("lon", "seq").alias("lon"), F.max_by("lat", "seq").alias("lat"), F.max("seq").alias("seq")
    )


def split(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients and taxis of a current table."""
    clients = current.where(F.col("kind") == CLIENT).select(F.col("id").alias("client_id"), "lon", "lat")
    taxis = current.where(F.col("kind") == TAXI).select(F.col("id").alias("taxi_id"), "lon", "lat")
    return clients, taxis
