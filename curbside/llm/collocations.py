"""Phrase collocations by direct-address tiling.

Words become numbers in the order of their frequency, so that frequent words have small numbers and the pairs of
neighbours that occur most lie close to the origin of the table of all pairs. The table is cut into square tiles: full
tiles are counted by direct address, with a dense ``bincount``, all other pairs by sorting them (coordinates with
counts). Pairs that are frequent enough are numbered by frequency again, and the same counting of neighbours, now of
overlapping pairs, gives the phrases of three words, and with those the phrases of four.

Texts are cut into slices with a bounded number of words. A slice has a dictionary of its own, and what is looked up in
shuffled tables is an entry of such a dictionary, not an occurrence; neither the vocabulary nor any table of phrases is
ever held in one place. Slices overlap by three words, which count in one of them.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.tables import read
from curbside.llm.tokens import slices as runs
from curbside.operators.spread import KEY_ROWS, fragment_join, hot_counts
from curbside.session import stage

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, SHARE = 2_000_000, 80
UNKNOWN = "und"


@dataclass(frozen=True)
class Sizes:
    """What bounds the work of one step; no result depends on it."""

    #: Words, and bytes of distinct words, of a slice; bytes that are cut into words at once.
    words: int = 400_000
    word_bytes: int = 32 << 20
    chunk: int = 1 << 20
    #: Side of a tile, tiles from the origin that may be dense each way, and a dense tile has a pair for each so many places.
    tile: int = 512
    head: int = 4
    fill: int = 8
    #: Words of the corpus for each bucket of pairs.
    bucket_pairs: int = 1 << 20
    #: Rows of one key that a task may take.
    key_rows: int = KEY_ROWS


BREAK = b"\n"
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
_TABLE[9] = 32
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_byte] = 10

SLICES = pa.schema([
    ("slice", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("tail", pa.int32()), ("n", pa.int64()),
    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])
SLICES_DDL = "slice long, lang string, ids binary, tail int, n long, words array<string>, counts array<long>"
LEVEL = pa.schema([("slice", pa.int64()), ("ids", pa.binary()), ("tail", pa.int32()), ("bucket", pa.int32()), ("pairs", pa.binary())])
LEVEL_DDL = "slice long, ids binary, tail int, bucket int, pairs binary"
OFTEN = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("id", pa.int64()), ("f", pa.int64()), ("slice", pa.int64()), ("pairs", pa.binary())])
OFTEN_DDL = "i long, j long, id long, f long, slice long, pairs binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers from -1 on, of one length, in as many bytes each as the largest needs, compressed."""
    head, parts = [], []
    for column in columns:
        size = next(s for s in (1, 2, 4, 8) if column.max(initial=0) < 1 << (8 * s - 1))
        head.append(size)
        parts.append(column.astype(f"<i{size}").tobytes())
    return bytes(head) + len(columns[0]).to_bytes(4, "little") + pa.compress(b"".join(parts), "zstd", asbytes=True)


def unpack(raw: bytes, columns: int = 1) -> list[np.ndarray]:
    sizes, count = list(raw[:columns]), int.from_bytes(raw[columns:columns + 4], "little")
    data, at, out = pa.decompress(raw[columns + 4:], count * sum(sizes), "zstd", asbytes=True), 0, []
    for size in sizes:
        out.append(np.frombuffer(data, f"<i{size}", count, at).astype(np.int64))
        at += count * size
    return out


def pack_pairs(i: np.ndarray, j: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs in order of ``i``, and what belongs to them; ``i`` as steps, which are small."""
    return pack(np.diff(i, prepend=0), j, *more)


def unpack_pairs(raw: bytes) -> list[np.ndarray]:
    steps, j, more = unpack(raw, 3)
    return [np.cumsum(steps), j, more]


def bucket_of(i: np.ndarray, j: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Slice:
    """Words of one language in order, as numbers of an own dictionary; number 0 is a break."""

    def __init__(self, seed: list[bytes] = ()):
        self.index: dict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.parts, self.size, self.bytes = [], 0, 0
        self.add([BREAK, *seed])

    def add(self, words: list[bytes]) -> None:
        known = len(self.index)
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.bytes += sum(map(len, itertools.islice(self.index, known, None)))

    def full(self, sizes: Sizes) -> bool:
        return self.size >= sizes.words or self.bytes >= sizes.word_bytes

    def row(self, number: int, lang: str, tail: int) -> tuple[dict, list[bytes]]:
        """The slice as a row, its last ``tail`` words being counted in the next one, and these words."""
        self.index.default_factory = None  # a reference to the dictionary itself, which would outlive the slice
        ids, words = np.concatenate(self.parts), list(self.index)
        tail = min(tail, len(ids) - 1)
        counts = np.bincount(ids[:len(ids) - tail], minlength=len(words))
        counts[0] = 0
        row = {"slice": number, "lang": lang, "ids": pack(ids), "tail": tail, "n": int(counts.sum()),
               "words": [w.decode() for w in words], "counts": counts}
        return row, [words[k] for k in ids[len(ids) - tail:]]


def chunks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end where a word does."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            cut = max(data.rfind(b" ", at + 1, end), data.rfind(BREAK, at + 1, end))
            if cut < 0:
                later = [p for p in (data.find(b" ", end), data.find(BREAK, end)) if p >= 0]
                cut = min(later, default=len(data))
            end = cut
        yield data[at:end]
        at = end


def cut(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """All texts as slices of one language each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_slices: dict[str, Slice] = {}

        def close(lang: str, tail: int) -> pa.RecordBatch:
            nonlocal number
            row, rest = open_slices.pop(lang).row(number, lang, tail)
            number += 1
            if tail:
                open_slices[lang] = Slice(rest)
            return pa.RecordBatch.from_pylist([row], schema=SLICES)

        for batch in batches:
            for part in runs(batch, "text", 4 << 20):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    own = part.column("text").filter(pc.equal(langs, lang)).cast(pa.large_binary()).to_pylist()
                    data = BREAK.join([text.translate(_TABLE) for text in own]) + BREAK
                    for chunk in chunks(data, sizes.chunk):
                        words = list(filter(None, chunk.replace(BREAK, b" \n ").split(b" ")))
                        open_slices.setdefault(lang, None)
                        open_slices[lang] = open_slices[lang] or Slice()
                        open_slices[lang].add(words)
                        if open_slices[lang].full(sizes):
                            yield close(lang, LONGEST - 1)
                while sum(s.size for s in open_slices.values()) > 2 * sizes.words or sum(s.bytes for s in open_slices.values()) > 2 * sizes.word_bytes:
                    yield close(max(open_slices, key=lambda lang: open_slices[lang].size + open_slices[lang].bytes), 0)
        for lang in list(open_slices):
            yield close(lang, 0)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(apply, SLICES_DDL)


def tile_counts(i: np.ndarray, j: np.ndarray, sizes: Sizes = Sizes()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs: full tiles near the origin by direct address, the others sorted."""
    side, head = sizes.tile, sizes.head
    parts, rest = [], np.ones(len(i), bool)
    near = np.flatnonzero((i < head * side) & (j < head * side))
    tiles = i[near] // side * head + j[near] // side
    for tile in np.flatnonzero(np.bincount(tiles, minlength=head * head) * sizes.fill >= side * side):
        own = near[tiles == tile]
        rest[own] = False
        counts = np.bincount(i[own] % side * side + j[own] % side, minlength=side * side)
        places = np.flatnonzero(counts)
        parts.append((tile // head * side + places // side, tile % head * side + places % side, counts[places]))
    i, j = i[rest], j[rest]
    if len(i):
        if max(i.max(), j.max()) < 1 << 31:
            keys = np.sort(i << 32 | j)
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            i, j = keys[begins] >> 32, keys[begins] & 0xFFFFFFFF
        else:
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            keys, i, j = i, i[begins], j[begins]
        parts.append((i, j, np.diff(np.append(begins, len(keys)))))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(column) for column in zip(*parts))


def counted(number: int, ids: np.ndarray, tail: int, keep: bool, buckets: int, sizes: Sizes) -> pa.Table:
    """A slice's row (with ``keep``) and its pairs of neighbours with counts, by bucket. -1 is what takes no part.

    Pairs that begin in the tail are listed without being counted: phrases that begin before it may hold them.
    """
    gone = ids < 0
    gone[len(ids) - tail:] = False
    idle = np.zeros(len(ids), bool)
    idle[1:] = gone[1:] & gone[:-1]
    ids = ids[~idle]
    valid = (ids[:-1] >= 0) & (ids[1:] >= 0)
    own = np.arange(len(valid)) < len(ids) - tail
    i, j, n = tile_counts(ids[:-1][valid & own], ids[1:][valid & own], sizes)
    late = np.flatnonzero(valid & ~own)
    i, j, n = (np.concatenate(c) for c in ((i, ids[late]), (j, ids[late + 1]), (n, np.zeros(len(late), np.int64))))
    bucket = bucket_of(i, j, buckets)
    order = np.lexsort((i, bucket))
    i, j, n, bucket = i[order], j[order], n[order], bucket[order]
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(begins[1:], len(bucket))
    rows = [(number, None, None, int(bucket[a]), pack_pairs(i[a:b], j[a:b], n[a:b])) for a, b in zip(begins, ends)]
    if keep and rows:
        rows.append((number, pack(ids), tail, None, None))
    return pa.table([pa.array([row[k] for row in rows], f.type) for k, f in enumerate(LEVEL)], schema=LEVEL)


def frequent(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """``OFTEN``: the frequent pairs of a bucket with their numbers, and for each slice those that it has.

    Numbers go by frequency: the most frequent pairs of all buckets come first, then the next ones.
    """
    bucket, slices = table["bucket"][0].as_py(), table["slice"].to_numpy()
    i, j, n, owner = [], [], [], []
    for k, raw in enumerate(table["pairs"].to_pylist()):
        for column, part in zip((i, j, n), unpack_pairs(raw)):
            column.append(part)
        owner.append(np.full(len(i[-1]), k))
    i, j, n, owner = (np.concatenate(c) for c in (i, j, n, owner))
    order = np.lexsort((owner, j, i))
    i, j, n, owner = i[order], j[order], n[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    f = np.add.reduceat(n, begins)
    often = np.flatnonzero(f >= least)
    place = np.lexsort((j[begins[often]], i[begins[often]], -f[often]))
    numbers = np.full(len(begins), -1)
    numbers[often[place]] = np.arange(len(often)) * buckets + bucket
    each = np.repeat(numbers, np.diff(np.append(begins, len(i))))
    kept = np.flatnonzero(each >= 0)
    kept = kept[np.lexsort((i[kept], owner[kept]))]
    cuts = np.flatnonzero(np.diff(owner[kept], prepend=-1))
    rows = [(slices[owner[kept[a]]], pack_pairs(i[kept[a:b]], j[kept[a:b]], each[kept[a:b]])) for a, b in zip(cuts, np.append(cuts[1:], len(kept)))]
    pairs = pa.table([pa.array(c, pa.int64()) for c in (i[begins[often]], j[begins[often]], numbers[often], f[often])], names=["i", "j", "id", "f"])
    lists = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "pairs"])
    return pa.concat_tables([pairs, lists], promote_options="default").select(OFTEN.names)


def numbered_words(left: pa.Table, right: pa.Table, buckets: int, sizes: Sizes) -> pa.Table:
    """A slice with the numbers of its frequent words."""
    if not left.num_rows:
        return LEVEL.empty_table()
    ids = unpack(left["ids"][0].as_py())[0]
    table = np.full(int(ids.max(initial=0)) + 1, -1, np.int64)
    table[right["place"].to_numpy()] = right["id"].to_numpy()
    return counted(left["slice"][0].as_py(), table[ids], left["tail"][0].as_py(), True, buckets, sizes)


def numbered_pairs(left: pa.Table, right: pa.Table, keep: bool, buckets: int, sizes: Sizes) -> pa.Table:
    """A slice one level up: at each place the number of the frequent pair that begins there."""
    if not left.num_rows or not right.num_rows:
        return LEVEL.empty_table()
    ids, tail = unpack(left["ids"][0].as_py())[0], left["tail"][0].as_py()
    i, j, numbers = (np.concatenate(c) for c in zip(*map(unpack_pairs, right["pairs"].to_pylist())))
    distinct, at = np.unique(ids, return_inverse=True)
    keys = np.searchsorted(distinct, i) * len(distinct) + np.searchsorted(distinct, j)
    order = np.argsort(keys)
    keys, numbers = keys[order], numbers[order]
    asked = at[:-1] * len(distinct) + at[1:]
    found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    up = np.where(keys[found] == asked, numbers[found], -1)
    return counted(left["slice"][0].as_py(), up, max(tail - 1, 0), keep, buckets, sizes)


def numbered_pairs_of(keep: bool, buckets: int, sizes: Sizes) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: numbered_pairs(left, right, keep, buckets, sizes)


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``id``, their place in the order of falling ``f``, ties by ``order``. Sorted over all tasks."""
    sorted_rows = rows.orderBy(F.desc("f"), *order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(sorted_rows, label).withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per task of the sort, so their number has that bound
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").withColumn("id", F.col("_before") + F.col("_row")).drop("_part", "_row", "_at", "_before")


def next_level(slices: DataFrame, entries: DataFrame, apply, label: str) -> DataFrame:
    """Bring each slice and its entries together; one slice is one group, of bounded size."""
    return stage(slices.groupBy("slice").cogroup(entries.groupBy("owner")).applyInArrow(apply, LEVEL_DDL), label)


def phrases(docs: DataFrame, least: int = LEAST, sizes: Sizes = Sizes()) -> tuple[list[DataFrame], DataFrame]:
    """Words, pairs, phrases of three and of four words with at least ``least`` occurrences, and words per language.

    Each has ``id, lang, phrase, last, f, heads, tails``: the last word, and the frequencies of the first one, two, ...
    words and of the last ..., two, one. Phrases also have ``i, j``, the ids of what is left without the last or first word.
    """
    slices = stage(cut(docs, sizes), "slices")
    totals = slices.groupBy("lang").agg(F.sum("n").alias("n"))
    entries = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "e"))
    entries = entries.select("slice", "lang", "place", F.col("e.words").alias("word"), F.col("e.counts").alias("n")).where("place > 0")
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.count("*").alias("_n")).where(F.col("f") >= least)
    words = ranked(words, ["lang", "word"], "words")
    known = fragment_join(entries.select("slice", "lang", "word", "place"), words.select("lang", "word", "id"), ["lang", "word"],
                          ["slice"], [], hot_counts(words.select("lang", "word", "_n"), ["lang", "word"], sizes.key_rows), None)
    # a bucket holds about so many pairs of all slices, however many words there are
    buckets = max(8, -(-(totals.agg(F.sum("n")).first()[0] or 0) // sizes.bucket_pairs))
    level = next_level(slices.select("slice", "ids", "tail"), known.select(F.col("slice").alias("owner"), "place", "id"),
                       lambda left, right: numbered_words(left, right, buckets, sizes), "pairs")
    one = F.array("f")
    found = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("heads"), one.alias("tails"))]
    for length in range(2, LONGEST + 1):
        pairs = level.where("pairs is not null").select("slice", "bucket", "pairs").groupBy("bucket")
        often = stage(pairs.applyInArrow(lambda table: frequent(table, least, buckets), OFTEN_DDL), f"often{length}")
        found.append(_spelled(often.where("id is not null").select("i", "j", "id", "f"), found[-1], length))
        if length < LONGEST:
            known = often.where("slice is not null").select(F.col("slice").alias("owner"), "pairs")
            payload = level.where("ids is not null").select("slice", "ids", "tail")
            level = next_level(payload, known, numbered_pairs_of(length + 1 < LONGEST, buckets, sizes), f"phrases{length}")
    return found, totals


def _spelled(often: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """Phrases put together from what they are without their last and without their first word."""
    first = parts.select(F.col("id").alias("i"), "lang", F.col("phrase").alias("_phrase"), F.col("heads").alias("_heads"))
    second = parts.select(F.col("id").alias("j"), "last", F.col("tails").alias("_tails"))
    both = often.join(first, "i").join(second, "j")
    return stage(both.select(
        "id", "i", "j", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f",
        F.concat("_heads", F.array("f")).alias("heads"), F.concat(F.array("f"), "_tails").alias("tails"),
    ), f"spelled{length}")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two to four words of each language.

    A phrase has at least ``least`` occurrences inside pieces of texts, overlapping ones included. Its score is that of
    its worst cut. Phrases that mostly occur inside one longer one are left out. Of equal scores the more frequent
    phrase comes first, then the smaller by bytes. A null ``lang`` is ``und``, a null text is empty; repeated rows count
    each; ids and other columns play no part; an empty table gives no rows.
    """
    found, totals = phrases(docs, least, sizes)
    whole = "decimal(20,0)"
    kept = []
    for length in range(2, LONGEST + 1):
        rows = found[length - 1]
        if length < LONGEST:
            # a longer phrase around this one holds one that is a single word longer, which is as frequent at least
            longer = found[length].select(F.explode(F.array_distinct(F.array("i", "j"))).alias("id"), F.col("f").alias("_f"))
            rows = rows.join(longer.groupBy("id").agg(F.max("_f").alias("_longer")), "id", "left")
            share = F.col("_longer").cast(whole) * 100 >= F.col("f").cast(whole) * SHARE
            rows = rows.where(~F.coalesce(share, F.lit(False)))
        cuts = [F.struct(
            F.expr(f"cast(f as {whole}) * {SCALE} div (cast(heads[{k - 1}] as {whole}) + cast(tails[{k}] as {whole}))").alias("score"),
            F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{k}]").alias("r"),
        ) for k in range(1, length)]
        kept.append(rows.select("lang", "phrase", F.col("f").alias("a"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")))
    every = reduce(DataFrame.unionByName, kept).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def _joined(length: int) -> str:
    return " || ' ' || ".join(f"w{k}" for k in range(1, length + 1))


ORACLE = rf"""
with docs as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, row_number() over () as p, piece from (
  select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from docs)),
lists as (select lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
words as (select lang, p, unnest(ws) as w1, generate_subscripts(ws, 1) as pos from lists),
starts as (
  select lang, w1, lead(w1, 1) over (partition by p order by pos) as w2, lead(w1, 2) over (partition by p order by pos) as w3,
    lead(w1, 3) over (partition by p order by pos) as w4 from words),
f1 as (select lang, w1, count(*) as f from starts group by all),
f2 as (select lang, w1, w2, count(*) as f from starts where w2 is not null group by all having count(*) >= {LEAST}),
f3 as (select lang, w1, w2, w3, count(*) as f from starts where w3 is not null group by all having count(*) >= {LEAST}),
f4 as (select lang, w1, w2, w3, w4, count(*) as f from starts where w4 is not null group by all having count(*) >= {LEAST}),
cuts as (
  select c.lang, {_joined(2).replace("w", "c.w")} as phrase, 2 as length, c.f as a, 1 as k, l.f as l, r.f as r
    from f2 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f1 r on r.lang = c.lang and r.w1 = c.w2
  union all select c.lang, {_joined(3).replace("w", "c.w")}, 3, c.f, 1, l.f, r.f
    from f3 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all select c.lang, {_joined(3).replace("w", "c.w")}, 3, c.f, 2, l.f, r.f
    from f3 c join f2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join f1 r on r.lang = c.lang and r.w1 = c.w3
  union all select c.lang, {_joined(4).replace("w", "c.w")}, 4, c.f, 1, l.f, r.f
    from f4 c join f1 l on l.lang = c.lang and l.w1 = c.w1
    join f3 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3 and r.w3 = c.w4
  union all select c.lang, {_joined(4).replace("w", "c.w")}, 4, c.f, 2, l.f, r.f
    from f4 c join f2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2
    join f2 r on r.lang = c.lang and r.w1 = c.w3 and r.w2 = c.w4
  union all select c.lang, {_joined(4).replace("w", "c.w")}, 4, c.f, 3, l.f, r.f
    from f4 c join f3 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 and l.w3 = c.w3
    join f1 r on r.lang = c.lang and r.w1 = c.w4),
scored as (select *, cast({SCALE} * cast(a as hugeint) // (l + r) as bigint) as score from cuts),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, w1 || ' ' || w2 as phrase, f from f3 union all select lang, w2 || ' ' || w3, f from f3
  union all select lang, w1 || ' ' || w2, f from f4 union all select lang, w2 || ' ' || w3, f from f4
  union all select lang, w3 || ' ' || w4, f from f4
  union all select lang, w1 || ' ' || w2 || ' ' || w3, f from f4 union all select lang, w2 || ' ' || w3 || ' ' || w4, f from f4),
longer as (select lang, phrase, max(f) as f from inside group by all),
kept as (
  select w.* from worst w left join longer o on o.lang = w.lang and o.phrase = w.phrase
  where o.f is null or 100 * cast(o.f as hugeint) < {SHARE} * cast(w.a as hugeint)),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept),
totals as (select lang, cast(sum(f) as bigint) as n from f1 group by lang)
select p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score from placed p join totals t on t.lang = p.lang where rank <= {TOP}
"""
