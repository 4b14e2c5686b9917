"""The additive model: features and tables against plain loops, and held-out labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbside.llm import quality

TEXTS = ["", None, " \n\t ", "Plain words, in a row.", "LOUD!! VERY!! LOUD!!", "a a a b b", "x" * 5000, "one | two |\nüber$$$ 12\none | two |",
         "same line here\nsame line here\nsame line here", "\x0b tail ", "trailing\n", "ends", "starts", "ΑΒΓ δ"]


def plain(text):
    """Some of the features by loops over words and lines."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = raw.split(b"\n")
    bodies = [tuple(line.split()) for line in lines if line.split()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    n = max(len(words), 1)
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": sum(map(len, words)) / n,
        "longest_word": np.log1p(max(map(len, words), default=0)), "digits": sum(48 <= b < 58 for b in raw) / max(len(raw), 1),
        "beyond_ascii": sum(b >= 128 for b in raw) / max(len(raw), 1), "same_as_before": same / n, "distinct": len(set(words)) / n,
        "line_words": len(words) / len(lines), "same_lines": (len(bodies) - len(set(bodies))) / len(lines),
        "ends_of_sentences": sum(w[-1:] in (b".", b"!", b"?") for w in words) / n,
        "upper": sum(65 <= b < 91 for b in raw) / max(len(raw), 1),
    }


def test_features_against_loops(spark, tables):
    texts = TEXTS + [r.text for r in tables("documents").limit(150).collect()]
    for sliced in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
        found = quality.features(sliced)
        assert found.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(found).all()
        for row, text in zip(found, texts):
            for name, value in plain(text).items():
                assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-12), (name, text)
    one_by_one = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(one_by_one, quality.features(pa.array(texts)), atol=1e-12)


def test_tree_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h, n = rng.standard_normal(9) * 5, rng.random(9) * 4, rng.integers(5, 40, 9)
        found = quality.tree(g, h, n, depth=1)
        best, wanted = quality._gain(g.sum(), h.sum()), np.full(9, -g.sum() / (h.sum() + 1))
        for cut in range(1, 9):
            sides = [(g[:cut].sum(), h[:cut].sum()), (g[cut:].sum(), h[cut:].sum())]
            gain = sum(quality._gain(*s) for s in sides)
            if min(n[:cut].sum(), n[cut:].sum()) >= quality.LEAST and gain > best + 1e-9:
                best, wanted = gain, np.array([-sides[k >= cut][0] / (sides[k >= cut][1] + 1) for k in range(9)])
        assert np.allclose(found, wanted)


def test_learns_interactions():
    """Neither number alone tells the label; the pair does. The tables add up to the model's log-odds."""
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.learn(x[:3000], y[:3000], rounds=10, pair_rounds=30, pairs=2)
    alone = quality.learn(x[:3000], y[:3000], rounds=10, pair_rounds=0, pairs=0)
    assert model.pairs[0] == (0, 1)
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93 > 0.65 > ((alone.scores(x[3000:]) > 0.5) == y[3000:]).mean()
    row = x[3000]
    total = model.base + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, row))
    total += sum(t[tuple(np.searchsorted(model.coarse[f], row[f], side="right") for f in pair)] for pair, t in zip(model.pairs, model.pair_tables))
    assert model.log_odds(x[3000:3001])[0] == pytest.approx(total)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.op11_additive_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    better = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) > 50 and better > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_edges(spark, edges, no_docs, tables):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 13)] + [(None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    model = quality.train(edges, labels)
    found = quality.rate(edges, model, ["doc_id"]).collect()
    assert len(found) == edges.count() and all(0 <= r.score <= 1 for r in found)
    twins = [r.score for r in found if r.doc_id == 11]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert quality.rate(no_docs, model, ["doc_id"]).collect() == []
    assert quality.train(no_docs, labels) is None and quality.train(edges, labels.limit(0)) is None
    assert {r.score for r in quality.rate(edges, None, ["doc_id"]).collect()} == {0.5}
    assert quality.train(edges.withColumn("text", F.lit(None).cast("string")), labels) is not None
