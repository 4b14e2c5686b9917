"""Wavelet matrix of a sequence of token ids: one bit-plane per bit, highest first, with rank and select.

File: ``WVM1``, length of the header, header (JSON), then the sections it lists, each zstd-compressed: ``docs`` and
``nulls`` (ids of the documents), ``sizes`` (their tokens), and for every plane its bits and the ones per block of 512.
Plane ``l`` holds bit ``bits - 1 - l`` of all ids in the order of that plane; zeros go first in the next one.
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512


def planes_of(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bits of every plane and how many zeros each has."""
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for shift in range(bits - 1, -1, -1):
        mask = (now & now.dtype.type(1 << shift)) != 0
        planes.append(np.packbits(mask, bitorder="little"))
        low = np.flatnonzero(~mask)  # several times faster than an index of booleans
        zeros.append(len(low))
        if shift:
            now = np.concatenate([now.take(low), now.take(np.flatnonzero(mask))])
    return planes, zeros


def dump(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, bits: int) -> bytes:
    """The file of a shard: all ids of its documents one after another."""
    planes, zeros = planes_of(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sections = [press(known.tobytes()), press(np.array([d is None for d in doc_ids], "u1").tobytes()), press(sizes.astype("<u4").tobytes())]
    for plane in planes:
        ones = np.bitwise_count(np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)]).view(np.uint64))
        sections += [press(plane.tobytes()), press(ones.reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint16).astype("<u2").tobytes())]
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections])


class WaveletMatrix:
    """A shard read from its file. Positions count from 0; ``rank(token, i)`` counts before position ``i``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = int.from_bytes(data[4:8], "little")
        header = json.loads(data[8:8 + size])
        self.n, self.bits, self.zeros = header["n"], header["bits"], header["zeros"]
        at, sections = 8 + size, []
        for length in header["sections"]:
            sections.append(zstandard.ZstdDecompressor().decompress(data[at:at + length]))
            at += length
        nulls = np.frombuffer(sections[1], "u1")
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(sections[0], "<i8"), nulls)]
        self.sizes = np.frombuffer(sections[2], "<u4").astype(np.int64)
        self.planes = [np.frombuffer(s, np.uint8) for s in sections[3::2]]
        self.ones = [np.concatenate([[0], np.cumsum(np.frombuffer(s, "<u2"), dtype=np.int64)]) for s in sections[4::2]]

    def _ones_before(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``: the block's entry in the directory plus the bits in the block."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8:(i + 7) // 8]
        count = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            count -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.ones[level][block]) + count

    def _next(self, level: int, bit: int, i: int) -> int:
        ones = self._ones_before(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8] >> (i % 8)) & 1
            token = token * 2 + bit
            i = self._next(level, bit, i)
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before position ``i`` stand after the last plane."""
        start, end = 0, min(i, self.n)
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            start, end = self._next(level, bit, start), self._next(level, bit, end)
        return start, end

    def rank(self, token: int, i: int) -> int:
        start, end = self._range(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of one (or zero) number ``k`` of a plane: a search in the directory, then in one block."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK - self.ones[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        """All positions of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens in order, plane by plane from the lowest."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            mask = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~mask)] = now[:self.zeros[level]]
            back[np.flatnonzero(mask)] = now[self.zeros[level]:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now
