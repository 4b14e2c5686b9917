"""Reading the corpus tables, and sizes of shuffles."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text being empty. Other columns of the input play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with plain column names, for operators that carry all columns whatever they are called."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def numbered_name(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def split_count(df: DataFrame) -> int:
    """How many tasks read ``df``: follows its size and the session's ``maxPartitionBytes``."""
    return max(1, df.rdd.getNumPartitions())


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows that go to a Python worker at once, for workers that several operators share: it spares memory
    for some more CPU time."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    import curbside

    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = os.path.dirname(os.path.abspath(curbside.__file__))
        place = os.path.join(tempfile.mkdtemp(prefix="curbside-"), "curbside.zip")
        with zipfile.ZipFile(place, "w") as archive:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(top)))
        context.addPyFile(place)
    return spark


_shipped: set[str] = set()
