"""Collocations against plain counting of all phrases."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                f[lang].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept, longer = [], Counter()
        for q, b in often.items():
            for size in range(2, len(q)):
                for k in range(len(q) - size + 1):
                    longer[q[k:k + size]] = max(longer[q[k:k + size]], b)
        for p, a in often.items():
            if p in longer and 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p[:k], p[k:]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, own[left], own[right], n[lang], -score))
    return sorted(out)


def got(found):
    assert found.columns == COLUMNS and all(t == "bigint" for c, t in found.dtypes if c not in ("lang", "phrase"))
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def small(tables):
    return tables("documents").cache()


def test_against_brute_force(spark, small):
    rows = [(r.lang, r.text) for r in small.collect()]
    wanted = brute(rows, 3, 300)
    assert len(wanted) > 300 and {len(r[2].split(" ")) for r in wanted} == {2, 3, 4}
    assert got(C.collocations(small, least=3, top=300)) == wanted
    # many short slices, small tiles, hot entries
    sizes = C.Sizes(words=700, chunk=300, tile=8, fill=64, key_rows=3, bucket_pairs=500)
    assert C.cut(small, sizes).count() > 20
    assert got(C.collocations(small.repartition(3), least=3, top=300, sizes=sizes)) == wanted


def test_cut_keeps_every_word(spark):
    """One text of one piece, cut into slices that overlap by three words."""
    words = [f"w{k % 7}" for k in range(5000)] + ["x" * 2000, "tail"]
    docs = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string")
    sizes = C.Sizes(words=100, chunk=150)
    rows = C.cut(docs, sizes).orderBy("slice").collect()
    assert len(rows) > 20 and sum(r.n for r in rows) == len(words)
    assert got(C.collocations(docs, least=2, top=50, sizes=sizes)) == brute([("en", " ".join(words))], 2, 50)


def test_tiles_against_counter():
    sizes = C.Sizes(tile=8, fill=16)
    rng = np.random.default_rng(3)
    for high in (5, 40, 1 << 20, 1 << 40):
        i, j = ((rng.random(3000) ** 3 * high).astype(np.int64) for _ in range(2))
        found = C.tile_counts(i, j, sizes)
        assert Counter(zip(i.tolist(), j.tolist())) == {(a, b): n for a, b, n in zip(*(c.tolist() for c in found))}
    assert [len(c) for c in C.tile_counts(i[:0], j[:0])] == [0, 0, 0]


def test_edges(spark, edges, no_docs):
    rows = [(r.lang, r.text) for r in edges.collect()]
    assert got(C.collocations(edges, least=2)) == brute(rows, 2, 2000)
    assert got(C.collocations(no_docs)) == []
    odd = [(None, "A b!c d\tA  b"), ("und", "a b. A B"), ("fr", "\xa0nbsp été\x85été é\x1cé été x"), ("", "a b a b"), ("fr", "\xa0nbsp été\x85été"), ("x", None), ("y", "...")]
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert got(C.collocations(docs, least=1)) == brute(odd, 1, 2000)


def test_big_counts(spark):
    """Products beyond 64 bits are exact."""
    a = 9_000_000_000_000_000_000
    found = spark.range(1).select(F.lit(a).alias("f"), F.array(F.lit(a)).alias("heads"), F.array(F.lit(a), F.lit(a - 1)).alias("tails"))
    whole = "decimal(20,0)"
    score = found.select(F.expr(f"cast(f as {whole}) * {C.SCALE} div (cast(heads[0] as {whole}) + cast(tails[1] as {whole}))").alias("s")).first().s
    assert score == C.SCALE * a // (a + a - 1)


def test_sql(spark):
    """The registered SQL gives the query's rows on the smallest table."""
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    relation = connection.execute(C.ORACLE)
    names = [c[0] for c in relation.description]
    wanted = sorted(tuple(dict(zip(names, row))[c] for c in COLUMNS) for row in relation.fetchall())
    assert wanted and got(C.op12_collocations(spark, folder)) == wanted
