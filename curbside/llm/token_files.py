"""Token ids of whole documents in binary files: a wavelet matrix per shard, in ascending order of ``doc_id``."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.tables import read, split_count, texts
from curbside.llm.tokens import encoder, slices, vocabulary
from curbside.llm.wavelet import WaveletMatrix, dump
from curbside.session import new_folder, stage

END = 0
#: Tokens after which a shard is closed. A document is never divided, so a longer one has a shard of its own size.
SHARD = 1 << 20
BITS = 16

MANIFEST = "shard string, documents long, tokens long"


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) and write shards to ``folder``; returns the manifest, a row per shard.

    A null text is empty and gives the end id alone. Rows with equal ``doc_id`` all stay, next to each other; those
    without a ``doc_id`` come first. Shards are named in ascending order. ``folder`` is on a file system that pyarrow
    opens (local or shared folder, hdfs, s3); a repeated task writes the same file again under a name of its own and
    moves it into place. No rows, no files.
    """
    rows = texts(docs)
    count = split_count(rows)
    ordered = rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode, number = TaskContext.get(), encoder(path).encode, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            name = f"{context.partitionId():09d}-{number:09d}.wvm"
            lengths = np.concatenate(sizes)
            _write(folder, name, dump(np.concatenate(ids), names, lengths, BITS), context.taskAttemptId())
            done = pa.RecordBatch.from_pydict({"shard": [name], "documents": [len(names)], "tokens": [int(lengths.sum())]})
            number += 1
            for part in (ids, names, sizes):
                part.clear()
            return done

        held = 0
        for batch in batches:
            for part in slices(batch, "text", 4 * shard):
                found, counts = encode(part.column("text"))
                at = np.cumsum(counts)
                ids.append(np.insert(found, at, end))
                names += part.column("doc_id").to_pylist()
                sizes.append(counts + 1)
                held += len(ids[-1])
                if held >= shard:
                    yield close()
                    held = 0
        if names:
            yield close()

    return stage(ordered.mapInArrow(write, MANIFEST), "shards")


def _write(folder: str, name: str, data: bytes, attempt: int) -> None:
    from pyarrow.fs import FileSystem

    store, place = FileSystem.from_uri(folder)
    store.create_dir(place)
    own = f"{place}/_{name}.{attempt}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{place}/{name}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the shards of ``folder`` hold: a row per document with its place in the shard and its ids' crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                matrix = WaveletMatrix(content.as_buffer().to_pybytes())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.sizes)
                starts = ends - matrix.sizes
                yield pa.RecordBatch.from_pydict({
                    "shard": [path.as_py().rsplit("/", 1)[-1]] * len(ends),
                    "doc_id": pa.array(matrix.doc_ids, pa.int64()),
                    "start": starts,
                    "n_tokens": matrix.sizes,
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64()),
                })

    return files.mapInArrow(decode, "shard string, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the shards in ``folder`` with their start among all ids: ids of the shards before, plus the place."""
    runs = manifest.select("shard", "tokens").repartitionByRange("shard").withColumn("run", F.spark_partition_id())
    runs = stage(runs, "shards")
    earlier = Window.unboundedPreceding, -1
    # one row per task of the range partitioning
    totals = runs.groupBy("run").agg(F.sum("tokens").alias("total"))
    totals = totals.select("run", F.coalesce(F.sum("total").over(Window.orderBy("run").rowsBetween(*earlier)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("run").orderBy("shard").rowsBetween(*earlier)), F.lit(0))
    shards = runs.join(totals, "run").select("shard", (F.col("first") + inside).alias("before"))
    return read_token_files(spark, folder).join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(read(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return token_index(spark, folder, manifest)
