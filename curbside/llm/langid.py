"""Language of whole texts by a byte-level convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import numbered, numbered_name, read
from curbside.llm.tokens import slices

WINDOW = 256
EMBED = 6
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bound of the training data: about so many documents of each language, and windows of each document.
SAMPLE = 300
WINDOWS = 4
EPOCHS = 10
BLOCK = 64
UNKNOWN = "und"


@dataclass
class Network:
    """Embedding of bytes, filters of several widths over them, the largest answer of each in a window, softmax.

    All filters have the room of the widest one; the rows that a narrow one doesn't see stay zero.
    """

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        wide = max(WIDTHS)
        return np.concatenate(
            [np.repeat((np.arange(wide * EMBED) < width * EMBED)[:, None], FILTERS, axis=1) for width in WIDTHS], axis=1
        ).astype(np.float32)

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        hidden = len(WIDTHS) * FILTERS
        return cls(
            languages, normal(256, EMBED, scale=0.5), normal(max(WIDTHS) * EMBED, hidden, scale=0.3) * cls.mask(),
            np.zeros(hidden, np.float32), normal(hidden, len(languages), scale=0.2), np.zeros(len(languages), np.float32),
        )

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For every position, the embeddings of the bytes that the widest filter sees there."""
        seen = self.embed.take(windows, axis=0)
        shape = (len(seen), seen.shape[1] - max(WIDTHS) + 1, max(WIDTHS) * EMBED)
        return np.lib.stride_tricks.as_strided(seen, shape, seen.strides, writeable=False).copy()

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Probability of every language for each window (a row of ``WINDOW`` bytes)."""
        parts = [np.zeros((0, len(self.languages)), np.float32)]
        for at in range(0, len(windows), BLOCK):
            columns = self.columns(windows[at:at + BLOCK])
            answers = self.filters.T @ columns.reshape(-1, columns.shape[2]).T  # a row per filter, for a fast maximum
            largest = answers.reshape(len(answers), *columns.shape[:2]).max(axis=2).T + self.bias
            parts.append(softmax(np.maximum(largest, 0) @ self.out + self.out_bias))
        return np.concatenate(parts)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, targets: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train with Adam on cross entropy. The largest answer of a filter passes its gradient to one place per window."""
    rng = np.random.default_rng(seed)
    net, mask = Network.fresh(languages, rng), Network.mask()
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    wide, step = max(WIDTHS), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BLOCK)):
            x, y = windows[batch], targets[batch]
            columns = net.columns(x)
            answers = columns @ net.filters
            where = answers.argmax(axis=1)
            rows = np.arange(len(x))[:, None]
            largest = answers[rows, where, np.arange(answers.shape[2])] + net.bias
            hidden = np.maximum(largest, 0)
            wrong = softmax(hidden @ net.out + net.out_bias)
            wrong[np.arange(len(x)), y] -= 1
            wrong /= len(x)
            back = (wrong @ net.out.T) * (largest > 0)
            seen = columns[rows, where]
            to_embed = np.zeros_like(net.embed)
            bytes_seen = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(wide)]
            np.add.at(to_embed, bytes_seen, (back[:, :, None] * net.filters.T).reshape(*back.shape, wide, EMBED))
            gradients = [to_embed, np.einsum("nf,nfc->cf", back, seen) * mask, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for w, g, (first, second) in zip(weights, gradients, moments):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                w -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as rows of ``WINDOW`` bytes, the rest of the last one zero: rows, rows per text, bytes per row."""
    raw = [text.encode().lower() for text in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = -(-sizes // WINDOW)
    flat = np.zeros(counts.sum() * WINDOW, np.uint8)
    used = np.full(counts.sum(), WINDOW, np.int64)
    row = 0
    for r, count in zip(raw, counts.tolist()):
        flat[row * WINDOW:row * WINDOW + len(r)] = np.frombuffer(r, np.uint8)
        row += count
        if count:
            used[row - 1] = len(r) - (count - 1) * WINDOW
    return flat.reshape(-1, WINDOW), counts, used


def held_out() -> Column:
    """Documents whose labels are never learned from. A null ``doc_id`` isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on about ``sample`` labelled documents of each language, chosen by a hash of their id.

    Learns only from ``text`` and non-null ``lang`` of documents that have an id, letters and aren't held out; None
    without any.
    """
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text")
    )
    counts = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n)))), F.col("lang"))
    chosen = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)) & F.col("text").rlike(r"\p{L}"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"lang": [], "doc_id": [], "window": []}
            for lang, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "text"))):
                rows, counts, _ = cut_windows([text])
                for k in np.random.default_rng(abs(doc_id)).permutation(len(rows))[:WINDOWS]:
                    out["lang"].append(lang)
                    out["doc_id"].append(doc_id)
                    out["window"].append(rows[k].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", "string"), ("doc_id", "int64"), ("window", "binary")]))

    rows = sorted(tuple(r) for r in chosen.mapInArrow(cut, "lang string, doc_id long, window binary").collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _, _ in rows})
    windows = np.frombuffer(b"".join(bytes(w) for _, _, w in rows), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([languages.index(lang) for lang, _, _ in rows]), languages)


def classify(texts: pa.Array, net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the mean over all its windows, weighted by their bytes.

    ``und`` with score 0 for a null text, a text without letters, or where nothing could be learned. Of languages with
    equal scores the first by name is taken.
    """
    texts = pc.fill_null(texts, "")
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = np.flatnonzero(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)) if net else []
    if len(known):
        windows, counts, used = cut_windows(texts.take(pa.array(known)).to_pylist())
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(net.probabilities(windows).astype(np.float64) * used[:, None], starts)
        mean = total / np.add.reduceat(used, starts)[:, None]
        for k, best in zip(known, mean.argmax(axis=1)):
            names[k] = net.languages[best]
        scores[known] = np.clip(mean.max(axis=1), 0, 1)
    return names, scores


def predict(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row of ``docs``."""
    rows = docs.select(*keep, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                names, scores = classify(part.column("text"), net)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"]
                )

    return rows.mapInArrow(apply, rows.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


def accepted(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` in a language: neither ``und`` nor as uncertain as a guess. Without a network all rows stay."""
    if net is None:
        return docs
    rows, text = numbered(docs), numbered_name(docs, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                names, scores = classify(part.column(text), net)
                yield part.filter(pa.array([name != UNKNOWN and score >= least for name, score in zip(names, scores)]))

    return rows.mapInArrow(apply, rows.schema).toDF(*docs.columns)


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, train(docs), ["doc_id", "held_out"])
