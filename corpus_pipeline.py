"""From raw documents to packed sequences: the stages of the training-data pipeline, each one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm import decontaminate, langid, packing, secrets, shingle_join, tokens
from curbside.llm.tables import numbered, numbered_name, read, ship, small_batches
from curbside.session import stage


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or in no language the network can tell, go."""
    small_batches(ship(spark))
    return langid.accepted(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of every group the document with the smallest id stays, once if its row is repeated.

    Rows without an id can't be told apart and stay.
    """
    small_batches(ship(spark))
    groups = shingle_join.group(docs.select("doc_id", "text"))
    rest = stage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = shingle_join.among(docs, rest, "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go. Rows without an id stay."""
    found = decontaminate.leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = stage(found.select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return shingle_join.among(docs, ids, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret becomes ``[secret]``; ``n_chars`` follows. No document goes."""
    ratios = secrets.train(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    rows = numbered(docs).select(F.struct("*").alias("row"))
    old = F.col("row").getField(numbered_name(docs, "text"))
    found = secrets.with_secrets(rows.select("row", F.coalesce(old, F.lit("")).alias("text")), ratios)
    clean = found.select("row", F.when(old.isNotNull(), secrets.redact(F.col("text"), F.col("_spans"), values=True)).alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("clean").eqNullSafe(old), F.col("row").getField(numbered_name(docs, "n_chars"))).otherwise(length)
    columns = (changed.get(c, F.col("row").getField(numbered_name(docs, c))) for c in docs.columns)
    return clean.select(*columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every kept document in sequences of 4096 tokens.

    The workers have served other stages before, so this one holds less than ``op4`` does.
    """
    small_batches(ship(spark))
    pieces = stage(packing.cut_pieces(docs, tokens.vocabulary("word_bpe_49k.json"), memory=200_000, slice_bytes=4 << 20), "pieces")
    return packing.pack(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The first stage learns a network and the last one uses a tokenizer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back before the next one."""
    docs = read(small_batches(ship(spark)), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
