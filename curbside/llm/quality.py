"""Quality of whole texts by a generalised additive model with pairwise interactions.

A text becomes a few numbers (shares of kinds of bytes, words and lines), each number a bin. The model is a lookup table
per number and one per pair of numbers, learned by boosting: in turn every number gets a shallow tree on the gradients
of the logistic loss, added to its table with a small weight, so that no number is served first; then pairs, the ones
that explain most of what is left, get trees with cuts in both directions. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.langid import held_out
from curbside.llm.tables import read
from curbside.llm.tokens import slices

#: Bound of the training data: about so many labelled documents, chosen by a hash of their id.
SAMPLE = 20_000
BINS, COARSE = 64, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 40, 8
RATE, LEAST, DEPTH = 0.15, 10, 2
LIMIT = 0.7
#: Bytes of text whose features are computed at once.
SLICE = 2 << 20

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "symbols", "spaces", "beyond_ascii",
    "loud_words", "symbol_words", "lone_marks", "same_as_before", "distinct", "line_words", "same_lines", "ends_of_sentences",
)

_KIND = np.zeros(256, np.uint8)
SPACE, UPPER, LOWER, DIGIT, MARK, SYMBOL, BEYOND = range(1, 8)
_KIND[list(b" \t\n\v\f\r")] = SPACE
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, BEYOND
_KIND[list(b".,;:?'\"()-")] = MARK
_KIND[[b for b in range(33, 127) if _KIND[b] == 0]] = SYMBOL
_MIX = np.random.default_rng(11).integers(1, 1 << 62, (64, 256), dtype=np.uint64) | np.uint64(1)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; an empty run is 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts + sizes] - total[starts]


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for every whole text; a null text is empty. Words are runs without white space."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    kind = _KIND[flat]
    shares = np.stack([_sums(kind == k, starts, sizes) for k in range(8)], axis=1) / np.maximum(sizes, 1)[:, None]

    # words: where they begin and end; a text's first byte begins one as well
    solid = kind != SPACE
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[(sizes > 0)]
    first[edge] = solid[edge]
    begins = np.flatnonzero(first)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    stops = np.flatnonzero(ends) + 1
    lengths = stops - begins
    doc = np.searchsorted(starts + sizes, begins, side="right")
    words = np.bincount(doc, minlength=len(sizes)).astype(np.int64)
    word_starts = np.cumsum(words) - words
    place = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat)))) if len(begins) and begins[0] == 0 else _places(begins, len(flat))
    mixed = np.where(solid, _MIX[place & 63, flat] * (place.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    codes = np.add.reduceat(mixed, begins) if len(begins) else np.zeros(0, np.uint64)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((codes, doc))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=len(sizes))
    upper, lower = (_sums(kind == k, begins, lengths) for k in (UPPER, LOWER))
    symbol = _sums(kind == SYMBOL, begins, lengths)
    letters = upper + lower + _sums(kind == BEYOND, begins, lengths) + _sums(kind == DIGIT, begins, lengths)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, doc, lengths)
    sentence = np.isin(flat[stops - 1], list(b".!?")) if len(stops) else np.zeros(0, bool)

    def of_words(values: np.ndarray) -> np.ndarray:
        return _sums(values, word_starts, words) / np.maximum(words, 1)

    # lines, and how many are the same as another one of the text
    breaks = flat == 10
    lines = _sums(breaks, starts, sizes) + 1
    line = np.searchsorted(np.flatnonzero(breaks), begins) if len(begins) else np.zeros(0, np.int64)
    begin = np.ones(len(line), bool)
    begin[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(begin)
    rank = (np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    line_codes = np.add.reduceat(codes * (rank * np.uint64(2) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    line_docs = doc[at]
    order = np.lexsort((line_codes, line_docs))
    again = np.zeros(len(order), bool)
    again[1:] = (line_codes[order][1:] == line_codes[order][:-1]) & (line_docs[order][1:] == line_docs[order][:-1])
    same_lines = np.bincount(line_docs[order][again], minlength=len(sizes)) / lines

    return np.stack([
        np.log1p(sizes), np.log1p(words), of_words(lengths), np.log1p(longest), shares[:, UPPER], shares[:, DIGIT], shares[:, MARK],
        shares[:, SYMBOL], shares[:, SPACE], shares[:, BEYOND], of_words((upper > 1) & (lower == 0)), of_words((symbol > 0) & (letters > 0)),
        of_words(letters == 0), of_words(same), distinct / np.maximum(words, 1), words / lines, same_lines, of_words(sentence),
    ], axis=1)


def _places(begins: np.ndarray, size: int) -> np.ndarray:
    """How far each byte is from the beginning of its word; before the first word, from the beginning."""
    start = np.zeros(size, np.int64)
    start[begins] = np.diff(np.concatenate([[0], begins]))
    return np.arange(size) - np.cumsum(start)


@dataclass
class Model:
    """Cuts between the bins of every feature, coarser ones for pairs, and a table of log-odds for each."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for column, cuts, table in zip(x.T, self.cuts, self.tables):
            total += table[np.searchsorted(cuts, column, side="right")]
        wide = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[wide[a], wide[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Answer of a shallow tree for every bin, from sums of gradients, curvatures and rows by bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
        gains = np.where((left_n >= LEAST) & (right_n >= LEAST), _gain(left_g, left_h) + _gain(right_g, right_h), -1.0)
        best = int(gains.argmax())
        if gains[best] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:best + 1] = tree(g[:best + 1], h[:best + 1], n[:best + 1], depth - 1)
            out[best + 1:] = tree(g[best + 1:], h[best + 1:], n[best + 1:], depth - 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree with one cut of the first feature and one of the second on each side: answers by bin, and the gain."""
    best, answer = 0.0, np.full(g.shape, -g.sum() / (h.sum() + 1.0))
    for axis in (0, 1):
        gt, ht, nt = (m if axis == 0 else m.T for m in (g, h, n))
        for cut in range(1, gt.shape[0]):
            gain, out = 0.0, np.zeros(gt.shape)
            for rows in (slice(0, cut), slice(cut, None)):
                side = [m[rows].sum(axis=0) for m in (gt, ht, nt)]
                values = tree(*side, depth=1)
                out[rows] = values
                gain += float(-(side[0] * values + (side[1] + 0.0) * values * values / 2).sum())
            if gain > best + 1e-12:
                best, answer = gain, out if axis == 0 else out.T
    return answer, best


def learn(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting; ``y`` is 0 to 1. The same rows give the same model."""
    count = x.shape[1]
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    coarse = [np.unique(np.quantile(column, np.linspace(0, 1, COARSE + 1)[1:-1])) for column in x.T]
    bins = [np.searchsorted(c, column, side="right") for c, column in zip(cuts, x.T)]
    wide = [np.searchsorted(c, column, side="right") for c, column in zip(coarse, x.T)]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(cuts, coarse, float(np.log(mean / (1 - mean))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    total = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    for _ in range(rounds):
        for f in range(count):
            g, h = slopes()
            step = RATE * tree(*(np.bincount(bins[f], w, len(rows[f])) for w in (g, h)), rows[f])
            model.tables[f] += step
            total += step[bins[f]]

    shapes = [(len(a) + 1, len(b) + 1) for a in coarse for b in coarse]
    cells = {(a, b): wide[a] * shapes[a * count + b][1] + wide[b] for a in range(count) for b in range(a + 1, count)}

    def grids(pair: tuple[int, int], *weights: np.ndarray) -> list[np.ndarray]:
        shape = shapes[pair[0] * count + pair[1]]
        return [np.bincount(cells[pair], w, shape[0] * shape[1]).reshape(shape) for w in weights]

    g, h = slopes()
    ones = np.ones(len(x))
    gains = {pair: pair_tree(*grids(pair, g, h, ones))[1] for pair in cells}
    model.pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:pairs]
    model.pair_tables = [np.zeros(shapes[a * count + b]) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for pair, table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * pair_tree(*grids(pair, g, h, ones))[0]
            table += step
            total += step.ravel()[cells[pair]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from about ``sample`` labelled documents that aren't held out; None without any.

    Several labels of a document count with their mean. Of several rows of one ``doc_id`` the one with the smallest
    features is learned from. Null ids and null labels are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    own = own.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    total = own.count()
    if not total:
        return None
    # the bound holds for what is broadcast and collected, whatever the number of labels
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["doc_id", "x"])

    described = rows.mapInArrow(describe, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    found = described.join(chosen, "doc_id").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return None
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return learn(x, found["quality"].to_numpy().clip(0, 1))


def rate(docs: DataFrame, model: Model | None, keep: list[str], limit: float = LIMIT) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1, higher: better) and ``predicted`` of every row of ``docs``.

    ``predicted`` is 1 from ``limit`` on. A null text counts as empty and is scored like any other; repeated rows get
    the same score each; null ids stay. Without a model every score is 0.5. An empty table gives no rows.
    """
    rows = docs.select(*keep, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                scores = model.scores(features(part.column("text"))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(scores), pa.array((scores >= limit).astype(np.int32))],
                    names=[*keep, "score", "predicted"])

    return rows.mapInArrow(apply, rows.select(*keep).schema.add("score", "double").add("predicted", "integer"))


def op11_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rate(rows, train(docs, read(spark, sf_dir, "labels")), ["doc_id", "held_out"])
