"""Token ids of whole texts, with the merges of every distinct chunk of text computed once.

Both vocabularies used here cut a text before the merges, always between a character and white space after it and always
between a letter and punctuation after it. Texts are cut at those places only, so the ids of the chunks, put
one after another, are the ids of the text. Chunks repeat, so Arrow's dictionary encoding finds the distinct ones of
some megabytes of text, and the library merges those that the worker hasn't met before.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x1f"
#: By vocabulary, a character that is never merged with its neighbours and has an id of its own.
SEPARATORS = {"byte_bpe_50k.json": "\x00", "word_bpe_49k.json": "²"}
#: Texts with white space after white space, or with what Python or RE2 and the library may class differently, aren't cut.
DOUBTFUL = r"[\s\v\x{85}\x{180e}\p{Z}][\s\v\x{85}\x{180e}\p{Z}]|[\x1c-\x1f]|<\|"
LETTER_STOP = r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([!-/:-@\[-`{-~])"
#: Bytes of text that are cut at a time, and distinct chunks that a worker remembers. They bound memory, not the result:
#: callers whose workers serve other operators as well pass less.
SLICE = 12 << 20
MEMORY = 1_000_000


class Encoder:
    """One per worker and vocabulary file."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = SEPARATORS[os.path.basename(path)]
        [self.separator_id] = self._library([self.separator])[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Merge new chunks, put into one text with separators between them."""
        # an apostrophe or a separator at the rim of a chunk would be taken together with the separator
        alone = [chunk for chunk in chunks if chunk[0] == "'" or self.separator in chunk]
        if alone:
            chunks = [chunk for chunk in chunks if chunk[0] != "'" and self.separator not in chunk]
        ids, ends, count = [self.flat], [], len(self.flat)
        for at in range(0, len(chunks), 4000):
            text = self.separator.join(chunks[at:at + 4000]) + self.separator
            found = np.array(self._library([text])[0], np.int32)
            bounds = found == self.separator_id
            own = np.flatnonzero(bounds)
            ends.append(own - np.arange(len(own)) + count)
            ids.append(found[~bounds])
            count += len(ids[-1])
        for found in self._library(alone):
            ids.append(np.array(found, np.int32))
            count += len(found)
            ends.append([count])
        self.known.update(zip(chunks + alone, range(len(self.known), len(self.known) + len(chunks) + len(alone))))
        edges = np.concatenate([[len(self.flat)], *ends]).astype(np.int32)
        self.starts = np.concatenate([self.starts, edges[:-1]])
        self.lengths = np.concatenate([self.lengths, np.diff(edges)])
        self.flat = np.concatenate(ids)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(texts, " ", MARK + " ")
        marked = pc.replace_substring(marked, "\n", MARK + "\n")
        marked = pc.replace_substring_regex(marked, LETTER_STOP, "\\1" + MARK + "\\2")
        lists = pc.split_pattern(marked, MARK)
        coded = lists.flatten().dictionary_encode()
        if len(self.known) > self.memory:
            self._forget()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if new := [chunk for chunk in distinct if chunk not in self.known]:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
        at = index[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        place = np.repeat((self.starts[at] - before[:-1]).astype(np.int32), lengths)
        place += np.arange(before[-1], dtype=np.int32)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return self.flat[place], np.diff(before[bounds])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts without nulls, one text after another, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        doubtful = pc.match_substring_regex(texts, DOUBTFUL).to_numpy(zero_copy_only=False)
        if not doubtful.any():
            return self._cut(texts)
        counts, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)] * len(texts)
        ids, counts[~doubtful] = self._cut(texts.filter(pa.array(~doubtful)))
        for row, own in zip(np.flatnonzero(~doubtful), np.split(ids, np.cumsum(counts[~doubtful])[:-1])):
            parts[row] = own
        for row in np.flatnonzero(doubtful):
            parts[row] = np.array(self._library([texts[row].as_py()])[0], np.int32)
            counts[row] = len(parts[row])
        return np.concatenate(parts), counts


@functools.cache
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The encoder of this worker, kept between batches and tasks."""
    return Encoder(path, memory)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE):
    """Cut a batch into runs of rows with about ``size`` bytes of text in ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype(np.int64)) // size
    for start, end in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))([0, *(np.flatnonzero(np.diff(run)) + 1), len(run)])):
        if end > start:
            yield batch.slice(start, end - start)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file. It is installed on every machine and only its path travels."""
    import public_tokenizers

    return public_tokenizers.path(name)
