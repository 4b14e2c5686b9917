"""Benchmark passages in whole texts, in DataFrame functions only: SimHash of item-sized windows.

Words are runs of letters and digits in lower case, shingles five words in a row. A window is worth a fingerprint only if
it shares a shingle with an item, so windows of an item's size are laid where a shared shingle puts the item's first
word. The 64 bits of a fingerprint are cut into seven blocks. If two fingerprints differ in at most 20 bits, they differ
in at most two bits in some block (seven blocks with three each would make 21), so an index of the items' blocks with all
changes of up to two bits finds every item within the radius. What is found is decided by the exact similarity of the
two bags of shingles, each weighted with its number of occurrences: sum of minima to sum of maxima, 75 % or more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import read
from curbside.session import stage

WORDS = 5
PERCENT = 75
RADIUS = 20
#: Bits of the blocks, lowest first: 64 in all, with RADIUS < 3 x 7.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
FLIPS = RADIUS // len(BLOCKS)
#: Rows of a benchmark's shingles up to which they are broadcast (about 64 MB); a larger benchmark is joined by a shuffle.
FEW = 1_000_000


def with_words(rows: DataFrame, keep: list[str]) -> DataFrame:
    split = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return rows.select(*keep, F.filter(split, lambda word: word != "").alias("words"))


def shingled(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with ``grams``: for each number of words in ``sizes`` the hashes of all runs of so many words."""

    def grams(size: int) -> Column:
        last = F.size("words") - size
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(size))))
        return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))

    return rows.select("*", *(grams(size).alias(f"grams_{size}") for size in sizes))


def gram_size(words: Column) -> Column:
    """Words of a shingle of an item: five, or all of a shorter item."""
    return F.least(F.size(words), F.lit(WORDS))


def bag(sizes: list[int], start: Column, end: Column, size: Column) -> Column:
    """Shingles of the words from ``start`` to ``end``, for the column of the number of words in ``size``."""
    out = None
    for k in sizes:
        own = F.slice(F.col(f"grams_{k}"), start + 1, F.greatest(end - start - k + 1, F.lit(0)))
        out = F.when(size == k, own) if out is None else out.when(size == k, own)
    return out


def fingerprint(shingles: Column) -> Column:
    """SimHash: each bit is set if more shingles of the bag have it set than not."""
    bits = F.array(*(F.lit(b) for b in range(64)))
    votes = F.aggregate(
        shingles, F.array_repeat(F.lit(0), 64),
        lambda sums, h: F.zip_with(sums, bits, lambda s, b: s + F.when(h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0, 1).otherwise(-1)),
    )
    masks = F.array(*(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("bigint") for b in range(64)))
    return F.aggregate(F.zip_with(votes, masks, lambda v, m: F.when(v > 0, m).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(m))


def blocks(code: Column, flips: int) -> Column:
    """(block, value) of every block, with all values that differ in at most ``flips`` bits."""
    out, low = [], 0
    for number, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        changes = [sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(width), n)]
        out.append(F.transform(F.array(*(F.lit(c).cast("bigint") for c in changes)), _changed(value, number)))
        low += width
    return F.concat(*out)


def _changed(value: Column, number: int):
    return lambda change: F.struct(F.lit(number).alias("block"), value.bitwiseXOR(change).alias("value"))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""

    def times(values: Column, one: Column) -> Column:
        return F.size(F.filter(values, lambda x: x == one))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, h: total + F.least(times(a, h), times(b, h)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, hamming, similarity): the most similar window of each document and item, if similar.

    ``start`` counts words; of equally similar windows the first is given. Rows without ``doc_id`` or ``item_id`` are
    given with that null. Items and texts without words match nothing; repeated rows add nothing.
    """
    spark = docs.sparkSession
    items = with_words(benchmark, [F.col("item_id").cast("long").alias("item_id")]).where(F.size("words") > 0)
    items = items.withColumn("n_words", F.size("words")).withColumn("size", gram_size(F.col("words")))
    sizes = sorted(row["size"] for row in items.select("size").distinct().collect())  # at most five numbers
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, start int, hamming int, similarity double")
    bags = shingled(items, sizes).select("item_id", "n_words", "size", bag(sizes, F.lit(0), F.col("n_words"), F.col("size")).alias("item_bag"))
    bags = stage(bags.select("*", fingerprint(F.col("item_bag")).alias("item_code")).distinct(), "items")

    texts = with_words(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    hashed = shingled(texts, sizes)
    seen = hashed.select("doc_id", F.size("words").alias("doc_words"), F.explode(F.array(*(F.struct(F.lit(k).alias("size"), F.col(f"grams_{k}").alias("grams")) for k in sizes))).alias("g"))
    seen = seen.select("doc_id", "doc_words", F.col("g.size").alias("size"), F.posexplode("g.grams").alias("pos", "gram"))
    anchors = stage(bags.select("n_words", "size", F.posexplode("item_bag").alias("offset", "gram")).distinct(), "anchors")
    anchors = F.broadcast(anchors) if anchors.count() <= FEW else anchors
    start = F.col("pos") - F.col("offset")
    laid = seen.join(anchors, ["gram", "size"]).select(
        "doc_id", "n_words", "size", F.greatest(start, F.lit(0)).alias("start"), F.least(start + F.col("n_words"), F.col("doc_words")).alias("end"))
    windows = stage(laid.distinct(), "windows")

    ids = stage(windows.select("doc_id").distinct(), "ids")
    near = F.broadcast(ids) if ids.count() <= FEW else ids
    found = shingled(texts.alias("t").join(near.alias("i"), F.expr("t.doc_id <=> i.doc_id"), "left_semi"), sizes)
    told = found.alias("d").join(windows.alias("w"), F.expr("d.doc_id <=> w.doc_id")).select(
        "w.doc_id", "w.n_words", "w.size", "w.start", *(F.col(f"d.grams_{k}").alias(f"grams_{k}") for k in sizes), F.col("w.end").alias("end"))
    cut = told.select("doc_id", "n_words", "size", "start", bag(sizes, F.col("start"), F.col("end"), F.col("size")).alias("bag")).where(F.size("bag") > 0)
    coded = stage(cut.select("*", fingerprint(F.col("bag")).alias("code")), "coded")

    index = bags.select("n_words", "item_id", "item_bag", "item_code", F.explode(blocks(F.col("item_code"), FLIPS)).alias("b")).select("n_words", "item_id", "item_code", "b.block", "b.value")
    probes = coded.select("doc_id", "n_words", "start", "code", F.explode(blocks(F.col("code"), 0)).alias("b")).select("doc_id", "n_words", "start", "code", "b.block", "b.value")
    near = probes.join(index, ["n_words", "block", "value"]).withColumn("hamming", F.bit_count(F.col("code").bitwiseXOR(F.col("item_code")))).where(F.col("hamming") <= RADIUS)
    pairs = near.select("doc_id", "n_words", "start", "code", "item_id", "hamming").distinct()
    full = pairs.alias("p").join(coded.alias("c"), F.expr("p.doc_id <=> c.doc_id and p.n_words = c.n_words and p.start = c.start and p.code = c.code")).select("p.*", "c.bag")
    full = full.alias("f").join(bags.alias("b"), F.expr("f.item_id <=> b.item_id and f.n_words = b.n_words")).select("f.*", "b.item_bag")
    scored = full.withColumn("both", shared(F.col("bag"), F.col("item_bag"))).withColumn("all", F.size("bag") + F.size("item_bag") - F.col("both"))
    close = scored.where(100 * F.col("both") >= PERCENT * F.col("all")).withColumn("similarity", F.col("both") / F.col("all"))
    best = F.max(F.struct("similarity", -F.col("start"), -F.col("hamming")))
    return close.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.col2")).alias("start"), (-F.col("best.col3")).alias("hamming"), F.col("best.similarity").alias("similarity"))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' distance is left out, as SQL has no such hash; everything else is returned."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hamming")


#: The same rows by comparing the bags of all windows that share a shingle with an item. It leaves out the fingerprints.
ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
bg as (select item_id, len(w) n, unnest(range(len(w) - 4)) q, w from b where len(w) >= 5),
bs as (select item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') g from bg),
dg as (select doc_id, len(w) m, unnest(range(len(w) - 4)) p, w from d where len(w) >= 5),
ds as materialized (select doc_id, m, p, array_to_string(w[p + 1:p + 5], ' ') g from dg where array_to_string(w[p + 1:p + 5], ' ') in (select g from bs)),
wins as (
  select distinct doc_id, bs.item_id, n, greatest(p - q, 0) s, least(p - q + n, m) e from ds join bs using (g)),
wbag as (select doc_id, item_id, s, e, g, count(*) c from wins join ds using (doc_id) where p >= s and p + 5 <= e group by all),
ibag as (select item_id, g, count(*) c from bs group by all),
inter as (
  select doc_id, item_id, s, sum(least(wbag.c, ibag.c)) i, any_value(e - s - 4) wn
  from wbag join ibag using (item_id, g) group by doc_id, item_id, s, e),
scored as (
  select doc_id, item_id, s, i, wn + (select len(w) - 4 from b where b.item_id = inter.item_id) - i u from inter)
select doc_id, item_id,
  cast(arg_max(s, i / u - s / 1e12) as integer) as start, max(cast(i as double) / cast(u as double)) similarity
from scored where 100 * i >= 75 * u group by doc_id, item_id
"""
