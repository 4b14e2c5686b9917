"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import read, texts
from curbside.llm.tokens import MEMORY, SLICE, encoder, slices, vocabulary
from curbside.session import stage

END = 1
SIZE = 4096
#: Pieces that are packed together. A group leaves about one sequence partly empty, some thousandths of a per cent.
GROUP = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, path: str, end: int = END, size: int = SIZE, memory: int = MEMORY, slice_bytes: int = SLICE
) -> DataFrame:
    """A row per piece of at most ``size`` ids of every document, the id ``end`` behind its last one.

    ``memory`` and ``slice_bytes`` bound what a worker holds (see ``tokens``).

    A null or empty text gives one piece with the end id. Repeated rows are cut one by one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, memory).encode
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                ids, counts = encode(part.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // size)
                row = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * size
                length = np.minimum(counts[row] - start, size)
                at = (np.cumsum(counts) - counts)[row] + start
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": number.astype(np.int32), "start": start, "length": length,
                    "ids_crc32": pa.array([zlib.crc32(ids[a:a + n]) for a, n in zip(at, length)], pa.int64()),
                })

    return texts(docs).mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Number of the bin of every length, and its offset there.

    A bin is filled greedily, always with the longest piece that fits. If room is left, the smallest piece of the bin
    gives way to the two unpacked pieces that fill the gap it leaves most tightly, if these take more than it did.
    Ties go to the longer of the two pieces. Only counts by length matter, so a bin costs some steps of big-integer
    arithmetic.
    """
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1).tolist()
    there = sum(1 << int(n) for n in np.unique(lengths))  # bit n: a piece of length n is left

    def longest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(n: int) -> None:
        nonlocal there
        counts[n] -= 1
        if not counts[n]:
            there &= ~(1 << n)

    def put_back(n: int) -> None:
        nonlocal there
        counts[n] += 1
        there |= 1 << n

    bins: list[list[int]] = []
    while there:
        gap, own = size, []
        while gap and (n := longest(gap)) > 0:
            take(n)
            own.append(n)
            gap -= n
        if gap and there:
            least = own[-1]
            room, best, pair = gap + least, least, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best:  # the longer of the two is a
                counts[a] -= 1
                other = min(a, room - a)
                b = longest(other)
                if b == a and not counts[a]:
                    b = longest(a - 1)
                counts[a] += 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                own.pop()
                put_back(least)
                for n in pair:
                    take(n)
                own += pair
        bins.append(own)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    next_row = np.searchsorted(lengths[order], np.arange(size + 2)).tolist()
    for k, own in enumerate(bins):
        at = 0
        for n in own:
            row = order[next_row[n]]
            next_row[n] += 1
            number[row], offset[row] = k, at
            at += n
    return number, offset


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Each of the groups that a hash deals out is packed by itself."""
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        number, offset = best_two_fit(rows["length"].to_numpy(), size)
        return rows.drop(columns="_group").assign(sequence_id=key[0] * (1 << 32) + number, offset=offset)

    return dealt.groupBy("_group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(cut_pieces(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")), "pieces"))
