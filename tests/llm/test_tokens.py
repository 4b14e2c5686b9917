"""Ids by chunks are the library's ids, files round-trip, and packing is gapless and tight."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from curbside.llm import packing, token_files
from curbside.llm.tokens import SEPARATORS, Encoder, vocabulary
from curbside.llm.wavelet import WaveletMatrix, dump
from curbside.session import new_folder

PARTS = ["a", " ", "\n", ".", ",", "é", "3", "'s", "\t", "  ", "!", "(", "<|endoftext|>", "word", "Ⅷ", "²", "\x1f", "　", "_", "-", "Σ", "İ", "\x00", "don't"]


@pytest.mark.parametrize("name", SEPARATORS)
def test_ids_are_the_librarys(name, tables):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    texts += [row.text for row in tables("documents").select("text").collect()]
    encoder = Encoder(vocabulary(name))
    ids, counts = encoder.encode(pa.array(texts))
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == wanted
    assert encoder.encode(pa.array([], pa.string()))[0].size == 0


def test_a_full_memory_changes_nothing():
    encoder = Encoder(vocabulary("byte_bpe_50k.json"), memory=3)
    for text in ("one two three four", "five six one two", "one seven"):
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 50257
    matrix = WaveletMatrix(dump(ids, [7, None], np.array([n // 2, n - n // 2]), 16))
    assert (matrix.decode() == ids).all() and matrix.doc_ids == [7, None]
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert matrix.access(i) == ids[i]
    for token in [*set(ids[:15].tolist()), 50000, 70000]:
        assert matrix.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert [matrix.rank(token, i) for i in (0, n // 3, n)] == [(ids[:i] == token).sum() for i in (0, n // 3, n)]
        assert matrix.count(token) == (ids == token).sum()
    with pytest.raises(IndexError):
        matrix.access(n)
    with pytest.raises(IndexError):
        matrix.select(0, n + 1)


def test_files_round_trip(spark, edges):
    folder, path = new_folder(spark, "tokens"), vocabulary("byte_bpe_50k.json")
    manifest = token_files.write_token_files(edges.repartition(3), "file://" + folder.removeprefix("file:"), path, shard=1000)
    found = token_files.token_index(spark, folder, manifest).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in edges.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    encoder, at = Encoder(path).tokenizer, 0
    assert manifest.count() > 1 and [r.doc_id for r in found] == [doc for doc, _ in rows]
    for row, (_, text) in zip(found, rows):
        ids = np.array(encoder.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents_no_files(spark, no_docs, tmp_path):
    import os

    from curbside.llm.token_files import op5_token_files

    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_token_files(spark, str(tmp_path)).count() == 0
    assert os.path.exists(tmp_path / "documents.parquet")


def checked(rows, size):
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].values == np.cumsum(own["length"].values) - own["length"].values).all() and own["length"].sum() <= size


def test_packing(spark, edges, no_docs):
    path = vocabulary("word_bpe_49k.json")
    pieces = packing.cut_pieces(edges, path, size=512)
    rows = packing.pack(pieces, size=512, group=20).toPandas()
    checked(rows, 512)
    encoder = Encoder(path).tokenizer
    wanted = Counter()
    for row in edges.collect():
        ids = np.array(encoder.encode(row.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512]
            wanted[row.doc_id, k // 512, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == wanted
    assert packing.pack(packing.cut_pieces(no_docs, path)).count() == 0


def test_two_fit_replaces_the_smallest():
    # greedy takes 6 + 3 of 10; without the 3, the gap of 4 is filled by 2 + 2
    number, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert number.tolist() == [0, 1, 0, 0] and sorted(offset[[0, 2, 3]].tolist()) == [0, 6, 8]


def test_few_sequences():
    lengths = np.random.default_rng(5).integers(1, 4097, 20_000)
    number, _ = packing.best_two_fit(lengths)
    assert np.bincount(number, lengths).max() <= 4096
    big = (lengths > 2048).sum()  # no two of these share a sequence
    assert number.max() + 1 <= 1.003 * max(big, lengths.sum() / 4096)
    number, _ = packing.best_two_fit(np.random.default_rng(6).integers(1, 900, 20_000))
    assert number.max() + 1 <= 1.002 * np.random.default_rng(6).integers(1, 900, 20_000).sum() / 4096 + 1
