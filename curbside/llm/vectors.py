"""Nearest vectors by multi-index hashing over learned binary codes.

Codes: the sample's principal axes, turned so that the signs lose little (iterative quantisation), 64 bits. A code is
split into four substrings of 16 bits, each with an index from its value to the vectors that have it. If two codes
differ in at most ``r`` bits, some substring differs in at most ``r / 4``, so probing all values that near to the
query's finds every code within the radius. Those found are ranked by their cosine in double precision.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.tables import read
from curbside.session import stage

BITS, PARTS, PART_BITS = 64, 4, 16
#: Bounds of what the codes and the radius are learned from.
SAMPLE, SAMPLE_QUERIES = 10_000, 300
#: Share of a sample query's true neighbours that the radius must hold. The full table's are nearer than the sample's.
RECALL = 0.985
#: Vectors that share an index, and queries that meet it in one task.
BLOCK, QUERY_BLOCK = 8192, 4096

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (unit(vectors) - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, k: int, rounds: int = 30, seed: int = 3) -> Coder:
    """Rotations and radius from a sample of vectors. With fewer than 64 dimensions several rotations are stacked."""
    rng = np.random.default_rng(seed)
    points = unit(sample)
    mean = points.mean(axis=0)
    centred = points - mean
    dims = centred.shape[1]
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = np.concatenate([axes, np.zeros((max(0, min(dims, BITS) - len(axes)), dims))])[:BITS].T
    turns = []
    for _ in range(math.ceil(BITS / axes.shape[1])):
        low = centred @ axes
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        turns.append(axes @ turn)
    coder = Coder(mean, np.concatenate(turns, axis=1)[:, :BITS], 0)
    chosen = rng.permutation(len(points))[:SAMPLE_QUERIES]
    codes, distances = coder.codes(sample), []
    for q in chosen:
        near = points @ points[q]
        near[q] = -2
        best = np.argsort(-near)[:k]
        distances.append(np.bitwise_count(codes[best] ^ codes[q]))
    distances = np.concatenate(distances) if distances else np.zeros(1)
    coder.radius = int(np.quantile(distances, RECALL, method="higher")) if distances.size else 0
    return coder


@functools.cache
def masks(reach: int) -> np.ndarray:
    """All 16-bit values with at most ``reach`` ones."""
    values = np.arange(1 << PART_BITS, dtype=np.uint16)
    return values[np.bitwise_count(values) <= reach]


class Index:
    """Vectors of a block: for each substring, the rows in order of its value and where each value begins."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.codes = ids, vectors, coder.codes(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.parts = self.codes.view("<u2").reshape(-1, PARTS)
        self.rows = [np.argsort(self.parts[:, p], kind="stable") for p in range(PARTS)]
        self.begins = [
            np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, p], minlength=1 << PART_BITS))]) for p in range(PARTS)
        ]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of all codes that differ from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.ids), bool)
        reach, rest = divmod(radius, PARTS)
        for p, value in enumerate(np.array([code], "<u8").view("<u2")):
            own = reach if p <= rest else reach - 1  # pigeonhole: reach + 1 in each of the others exceeds the radius
            if own < 0:
                continue
            probes = masks(own) ^ value
            start, end = self.begins[p][probes], self.begins[p][probes.astype(np.int64) + 1]
            held = end > start
            start, size = start[held], (end - start)[held]
            at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            found[self.rows[p][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.uint64, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` nearest within the radius; it widens until there are ``k`` or no more rows."""
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(np.unique(self.ids[rows])) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + PARTS)
        scores = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.sqrt((query * query).sum()))
        order = np.lexsort((self.ids[rows], -scores))
        _, first = np.unique(self.ids[rows][order], return_index=True)  # a repeated row counts once
        order = order[np.sort(first)][:k]
        return self.ids[rows][order], scores[order]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` as doubles of the rows that take part.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    those that haven't the most frequent number of dimensions (of equally frequent ones, the smallest).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "dims").first()
    return rows.where(F.size("embedding") == (first["dims"] if first else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest of every row of ``vectors`` that ``is_query`` picks, among all rows with another ``vec_id``.

    Blocks of vectors meet blocks of queries; each meeting is a task with an index of its own, and hands on at most
    ``k`` rows per query. Nothing is returned for an empty table.
    """
    rows = stage(usable(vectors), "vectors")
    spark, total = rows.sparkSession, rows.count()
    queries = rows.where(is_query)
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30))
    sample = rows.where(hashed < min(1.0, SAMPLE / total) * (1 << 30)).orderBy("vec_id").select("embedding").toArrow()
    if not sample.num_rows:
        sample = rows.limit(SAMPLE).select("embedding").toArrow()
    coder = learn(matrix(sample["embedding"]), k)
    blocks, query_blocks = math.ceil(total / BLOCK), math.ceil(asked / QUERY_BLOCK)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            index = Index(left["vec_id"].to_numpy(), matrix(left["embedding"]), coder)
            asking = matrix(right["embedding"])
            for query_id, query, code in zip(right["vec_id"].to_pylist(), asking, coder.codes(asking)):
                ids, scores = index.nearest(query_id, query, code, k, coder.radius)
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table(out, schema=pa.schema([("query_id", "int64"), ("vec_id", "int64"), ("score", "float64")]))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own, place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    left = rows.select("*", own.alias("block"), numbers(query_blocks).alias("asking"))
    right = queries.select("*", numbers(blocks).alias("block"), place.alias("asking"))
    met = left.groupBy("block", "asking").cogroup(right.groupBy("block", "asking")).applyInArrow(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
