"""Message feeds: newline-delimited JSON from a folder, or Kafka. All of them can be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All messages of a folder as rows of one ``value`` column."""
    return spark.read.text(path)


def stream_feed(
    spark: SparkSession, path: str, *, max_files: int = 1000, latest_first: bool = False, max_age: str = "36500d"
) -> DataFrame:
    """The messages of a growing folder as a stream; ``max_files`` bounds one micro-batch.

    Files are read however old they are. Spark's own default passes over files more than a week older than the newest
    one; ``max_age`` sets such a limit, and with it the number of file names that the stream has to remember.
    """
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .option("latestFirst", str(latest_first).lower())
        .option("maxFileAge", max_age)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def kafka_feed(spark: SparkSession, servers: str, topic: str, *, max_offsets: int = 10_000_000, **options) -> DataFrame:
    """The text messages of a Kafka topic as ``value, seq`` with the offset as order.

    The topic must be keyed by the id, so that all messages of one id share a partition and its offsets order them.
    Records that are no UTF-8 text are left out. Needs the Kafka connector on the class path.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for key, value in {"maxOffsetsPerTrigger": max_offsets, **options}.items():
        reader = reader.option(key, value)
    return kafka_messages(reader.load())


def kafka_messages(records: DataFrame) -> DataFrame:
    """``value, seq`` of Kafka records (binary ``value``, ``offset``) that are UTF-8 text."""
    return records.where(F.is_valid_utf8("value")).select(
        F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))
