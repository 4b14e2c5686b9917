"""Links between documents whose sets of five-word shingles have a Jaccard similarity of 75 % or more, and their groups.

Vertical partitioning. All shingles have one global order, rare ones first: shingles are hashed to 64 bits, the hash's
top bits name a bucket, and buckets are ranked by how many shingles all documents have in them. Pivots cut this order
into fragments of equal mass, so every set falls into segments. For a candidate pair the shared shingles of each
fragment are counted separately, in tasks that hold single segments only, and the counts are summed per pair.

Candidates. Two sets that are similar enough share a shingle early in both: at the first shared one, what is left of
either set must still be able to reach the overlap needed. Only these prefixes meet, by shingle. In a first round each
member of a shingle's list meets one centre, so a group of n copies costs n pairs. Links so found join components. In
the second round members that aren't in the list's largest component meet all members of other components. Pairs within
a component can't change it, so nothing is lost, and a group of copies never becomes all its pairs. Shingles shared
within the prefixes are the first overlap that is counted; most other pairs can't reach the similarity any more then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.components import components
from curbside.llm.tables import read
from curbside.llm.tokens import slices
from curbside.session import stage

WORDS = 5
PERCENT = 75
BUCKET_BITS = 20
CHUNK = 1 << 14
FRAGMENTS = 6
#: Bytes of text that are cut into shingles at a time.
SLICE = 4 << 20
#: Rows of ids up to which they are broadcast (16 MB); more are joined by a shuffle.
FEW_IDS = 1_000_000

# Fixed odd multipliers, one for each place in a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer than five words are one shingle."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(trimmed)
    coded = lists.flatten().dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
    words = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k:len(words) - WORDS + 1 + k] * MIX[k]
    rolled = finish(rolled)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_pylist()
    out = []
    for start, end, none in zip(bounds[:-1], bounds[1:], empty):
        if none:
            out.append(np.zeros(0, np.uint64))
        elif end - start < WORDS:
            own = words[start:end]
            out.append(finish((own * MIX[:len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))))
        else:
            own = np.sort(rolled[start:end - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def needed(a: Column, b: Column) -> Column:
    """Least number of shared shingles for a link between sets of ``a`` and ``b``."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


SUMMARY = "doc_id long, n int, sign_a long, sign_b long, chunk int, counts binary"


def summarise(docs: DataFrame) -> DataFrame:
    """Per document the size of its set and a 128-bit signature of it; per task the counts of shingles by bucket."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingles(part.column("text"))
                signs = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]).reshape(-1, 2)
                for own in sets:
                    np.add.at(counts, (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
                yield rows(part.column("doc_id"), [len(s) for s in sets], signs[:, 0], signs[:, 1], [None] * len(sets), [None] * len(sets))
        at = np.arange(0, len(counts), CHUNK)
        yield rows([None] * len(at), [None] * len(at), [None] * len(at), [None] * len(at), at // CHUNK, [counts[k:k + CHUNK].tobytes() for k in at])

    def rows(*columns) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)],
            names=[c.split()[0] for c in SUMMARY.split(", ")])

    return docs.mapInArrow(apply, SUMMARY)


def global_order(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every bucket, rare ones first, and the pivots between fragments. Both have a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(sums, pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    parts = summary.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in parts.collect():
        counts[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] += np.frombuffer(bytes(row["counts"]), np.int64)
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    mass = np.cumsum(counts[order])
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)
    return ranks, cuts.astype(np.uint64) << np.uint64(64 - BUCKET_BITS)


def ordered(own: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set's shingles as numbers that sort by the global order: the bucket replaced by its rank."""
    low = np.uint64(64 - BUCKET_BITS)
    return np.sort((ranks[(own >> low).astype(np.int64)].astype(np.uint64) << low) | (own & np.uint64((1 << int(low)) - 1)))


def prefixes(docs: DataFrame, ranks) -> DataFrame:
    """(key, node, n, pos): the shingles among which the first one shared with a similar set must be."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys, sizes = [np.zeros(0, np.uint64)], []
                sets = shingles(part.column("text"))
                for own in sets:
                    n = len(own)
                    p = n - -(-PERCENT * n // 100) + 1 if n else 0
                    keys.append(ordered(own, ranks.value)[:p])
                    sizes.append(p)
                sizes = np.array(sizes)
                row = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), part.column("doc_id").take(pa.array(row)),
                    pa.array(np.array([len(s) for s in sets], np.int32)[row]),
                    pa.array((np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)),
                ], names=["key", "node", "n", "pos"])

    return docs.mapInArrow(apply, "key long, node long, n int, pos int")


def segments(docs: DataFrame, ranks, pivots: np.ndarray) -> DataFrame:
    """(node, fragment, segment): the sets cut by the global order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = {"node": [], "fragment": [], "segment": []}
                for node, own in zip(part.column("doc_id").to_pylist(), shingles(part.column("text"))):
                    for f, segment in enumerate(np.split(own := ordered(own, ranks.value), np.searchsorted(own, pivots))):
                        if len(segment):
                            out["node"].append(node)
                            out["fragment"].append(f)
                            out["segment"].append(segment.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()), pa.array(out["fragment"], pa.int32()), pa.array(out["segment"], pa.list_(pa.int64()))], names=list(out))

    return docs.mapInArrow(apply, "node long, fragment int, segment array<long>")


def among(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is (or, ``left_anti``, isn't) in ``ids``, a written table."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", how)


def reaches(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether two sets can be similar if the shingles at these places are the first they share."""
    return F.least(n_a - pos_a, n_b - pos_b) >= needed(n_a, n_b)


def prefix_size(n: Column) -> Column:
    return n - F.ceil(n * PERCENT / 100) + 1


def promising(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs that can still be links once the shingles shared in both prefixes are counted, the first partial overlap.

    Up to the last shingle of the prefix that ends first all shared shingles are known; of what comes after, no more
    than the rest of that set can be shared.
    """
    pairs = stage(pairs.distinct(), "pairs")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "nodes")
    keys = among(lists.select(F.col("node").alias("doc_id"), "key"), ids)
    met = pairs.join(keys.withColumnRenamed("doc_id", "a"), "a").join(keys.withColumnRenamed("doc_id", "b"), ["b", "key"])
    counted = met.groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("shared"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    most = F.col("shared") + F.greatest(n_a - prefix_size(n_a), n_b - prefix_size(n_b))
    return counted.where(most >= needed(n_a, n_b)).drop("shared")


def verified(pairs: DataFrame, docs: DataFrame, ranks, pivots: np.ndarray) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that are links: overlaps are counted by fragment and summed per pair.

    Segments are cut once per document and go to the pairs it is in; the two of a pair and fragment meet in a shuffle.
    """
    pairs = stage(pairs, "promising")
    sides = stage(pairs.select("*", F.explode(F.array("a", "b")).alias("node")), "sides")
    ids = stage(sides.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    parts = segments(among(docs, ids), ranks, pivots)
    dealt = parts.join(F.broadcast(sides) if sides.count() <= FEW_IDS else sides, "node")
    met = dealt.groupBy("a", "n_a", "b", "n_b", "fragment").agg(F.collect_list("segment").alias("two")).where(F.size("two") == 2)
    counted = met.select("a", "n_a", "b", "n_b", F.size(F.array_intersect(F.get("two", F.lit(0)), F.get("two", F.lit(1)))).alias("shared"))
    total = counted.groupBy("a", "n_a", "b", "n_b").agg(F.sum("shared").alias("shared"))
    return stage(total.where(100 * F.col("shared") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"), "links")


def group(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of all documents (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` that links reach. Documents without words have an empty set and are
    alone. Rows that repeat a ``doc_id`` are one document, with the longest of its texts (of equally long ones the
    greatest); rows without a ``doc_id`` can't be linked and have a null ``component_id``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        longest = F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text")
        rows = rows.where("doc_id is null").unionByName(rows.where("doc_id is not null").groupBy("doc_id").agg(longest))
    summary = stage(summarise(rows), "summary")
    order, pivots = global_order(summary)
    ranks = spark.sparkContext.broadcast(order)

    sized = summary.where("chunk is null").drop("chunk", "counts")
    named = sized.where("doc_id is not null")
    # written, so that the join below is one of two shuffles, of which a large group of copies can be split
    firsts = stage(named.where("n > 0").groupBy("sign_a", "sign_b").agg(F.min("doc_id").alias("node")), "firsts")
    placed = stage(named.join(firsts, ["sign_a", "sign_b"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "placed")
    copies = stage(placed.where("doc_id <> node").select("doc_id"), "copies")
    unique = among(rows.where("doc_id is not null"), copies, "left_anti")

    by_key = Window.partitionBy("key").orderBy("pos", "node")
    lists = prefixes(unique, ranks).select(
        "*", *(F.first(c).over(by_key).alias(f"first_{c}") for c in ("node", "n", "pos")), F.lead("node").over(by_key).alias("next"),
    ).where((F.col("first_node") != F.col("node")) | F.col("next").isNotNull()).drop("next")
    shared = stage(lists, "lists")
    n, pos = F.col("n"), F.col("pos")
    star = shared.where((F.col("first_node") != F.col("node")) & reaches(F.col("first_n"), F.col("first_pos"), n, pos)).select(
        F.col("first_node").alias("a"), F.col("first_n").alias("n_a"), F.col("node").alias("b"), F.col("n").alias("n_b"))
    links = verified(promising(star, shared), unique, ranks, pivots)
    roots = stage(components(links), "roots")

    labelled = shared.select("key", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_key, of_both = Window.partitionBy("key"), Window.partitionBy("key", "root")
    counted = labelled.repartition("key").withColumn("members", F.count("*").over(of_both))  # one shuffle for all windows
    told = counted.select(
        "*", F.first("root").over(of_key.orderBy(F.desc("members"), "root")).alias("main"),
        F.min("root").over(of_key).alias("least"), F.max("root").over(of_key).alias("most"))
    open_lists = stage(told.where("least <> most").select("key", "node", "n", "pos", "root", "main"), "open")
    right = open_lists.select("key", F.col("main").alias("main_b"), *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root")))
    met = open_lists.where("root <> main").join(right, "key").where(
        (F.col("root") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("node") < F.col("node_b")))
        & reaches(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b")))
    swap = F.col("node") > F.col("node_b")
    pairs = met.select(*(F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (
        ("node_b", "node", "a"), ("n_b", "n", "n_a"), ("node", "node_b", "b"), ("n", "n_b", "n_b"))))
    more = verified(promising(pairs, shared), unique, ranks, pivots)
    final = stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    out = placed.join(final, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    return out.unionByName(sized.where("doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "documents"))


#: The same rows in SQL: all pairs of documents that share a shingle, and the smallest document that links reach.
ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s
  from words),
items as (select doc_id, len(s) n, unnest(s) k from sets),
together as (
  select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c
  from items a join items b on a.k = b.k and a.doc_id < b.doc_id group by all),
links as (select a, b from together where 100 * c >= 75 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select doc_id, cast(len(s) as bigint) n_shingles,
  least(doc_id, coalesce((select min(b) from reach r where r.a = sets.doc_id), doc_id)) component_id
from sets
"""
