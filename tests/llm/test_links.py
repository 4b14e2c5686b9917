"""Links, leaks, neighbours, conversations and the pipeline against brute force and edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.llm import chat, decontaminate, shingle_join, vectors
from curbside.llm.components import components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def groups_of(docs):
    """doc_id -> (size, smallest id in reach), all pairs compared."""
    sets = {d: sets_of(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in docs}


def corpus():
    """Copies in chains (each near its neighbours only), a large group, shared passages, exact copies."""
    rnd = random.Random(11)

    def words(n):
        return [f"w{rnd.randrange(5000)}" for _ in range(n)]

    docs, passage = [], words(40)
    for _ in range(25):
        text = words(60)
        for _ in range(rnd.choice([1, 1, 2, 6])):
            docs.append(list(text))
            for _ in range(rnd.choice([0, 1, 2])):
                text[rnd.randrange(len(text))] = f"v{rnd.randrange(10**6)}"
    big = words(80)
    for _ in range(60):
        own = list(big)
        for _ in range(rnd.randrange(5)):
            own[rnd.randrange(80)] = f"u{rnd.randrange(10**6)}"
        docs.append(own)
    docs += [words(30) + passage + words(30) for _ in range(12)] + [passage + words(4) for _ in range(5)]
    return {k: " ".join(own) for k, own in enumerate(docs)} | {1000: "", 1001: None, 1002: "a b", 1003: "A  b", 1004: docs[0] and " ".join(docs[0]).upper()}


def test_groups_against_all_pairs(spark):
    docs = corpus()
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.group(rows).collect()}
    assert found == groups_of(docs)


def test_group_edges(edges, no_docs, spark):
    rows = shingle_join.group(edges).collect()
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    docs = {r.doc_id: r.text for r in edges.collect() if r.doc_id is not None}
    assert named == groups_of(docs) and named[2] == (3, 1) and named[7][1] == 6 and named[9][1] == 8
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None].count((2, None)) == 1 and sum(r.doc_id is None for r in rows) == 2
    assert shingle_join.group(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g h"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert sorted(tuple(r) for r in shingle_join.group(twice).collect()) == [(1, 4, 1), (2, 4, 1)]


def test_shingles_are_whole_and_distinct():
    import pyarrow as pa

    texts = ["a b c d e f", "  a  b\tc\x0bd e f ", "", " ", "x", "a b c d e a b c d e a b c d e", "É É É É É K"]
    found = shingle_join.shingles(pa.array(texts))
    assert [len(s) for s in found] == [len(sets_of(t)) for t in texts] and (found[0] == found[1]).all()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)]
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(root[n] == r for n, r in found.items()) and set(found) == {n for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree near the river"


def test_leaks(spark, edges, no_docs):
    words = ITEM.split()
    one_changed = " ".join(words[:1] + ["red"] + words[2:])
    longer = " ".join(words[:10] + ["very"] + words[10:])
    half = " ".join(words[:9]) + " and then something else happened to all of them that day indeed"
    docs = spark.createDataFrame([
        (1, f"Before it. {ITEM.upper()}!! After it, more."), (2, one_changed), (3, f"intro {longer} outro"), (4, half), (5, ITEM), (5, ITEM),
        (6, None), (7, ""), (None, ITEM), (8, "say alpha beta gamma now"), (9, f"{ITEM} and {ITEM}"), (10, " ".join(words[1:])),
    ], "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("start", F.lit(1))
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "Alpha, beta: gamma"), (3, None), (4, ""), (5, "entirely different words are in this one item here")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 1), (None, 1), (8, 2), (9, 1), (10, 1)}
    assert found[1, 1] == (2, 1.0) and found[9, 1] == (0, 1.0) and found[2, 1][1] == pytest.approx((len(words) - 4 - 2) / (len(words) - 4 + 2))
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(edges, items).count() == 0


def test_all_fingerprints_within_the_radius(spark):
    """Some block of two fingerprints within the radius differs in two bits at most, and then the index has both."""
    rnd = random.Random(2)
    rows = []
    for _ in range(200):
        code = rnd.getrandbits(64)
        other = code
        for b in rnd.sample(range(64), decontaminate.RADIUS):
            other ^= 1 << b
        rows.append(tuple(x - (1 << 64) * (x >> 63) for x in (code, other)))
    frame = spark.createDataFrame(rows, "a long, b long")
    met = frame.select(F.size(F.array_intersect(decontaminate.blocks(F.col("a"), 0), decontaminate.blocks(F.col("b"), decontaminate.FLIPS))).alias("n"))
    assert met.where("n = 0").count() == 0 and sum(decontaminate.BLOCKS) == 64


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    bags = [[int(x) for x in rng.integers(-2**63, 2**63, n)] for n in (1, 2, 7, 40)]
    for bag, row in zip(bags, spark.createDataFrame([(b,) for b in bags], "bag array<long>").select("bag", decontaminate.fingerprint(F.col("bag")).alias("code")).collect()):
        wanted = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bag) > len(bag))
        assert row.code == wanted - (1 << 64) * (wanted >> 63)


def nearest_of(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        score = {i: float((v * ok[q]).sum() / (np.sqrt((v * v).sum()) * np.sqrt((ok[q] * ok[q]).sum()))) for i, v in ok.items() if i != q}
        out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def test_recall(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in tables("embeddings").collect()]
    wanted = nearest_of(rows)
    found = {}
    for r in vectors.op10_multi_index(spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(wanted) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(wanted[q])) for q in wanted) >= 0.9 * 5 * len(wanted)


def test_vector_edges(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (100, [0.0, 0.0]), (150, None), (200, [float("nan"), 1.0]), (250, [None, 1.0]), (None, [1.0, 1.0]),
            (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 2.0]), (4, [-1.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [float("inf"), 0.0]), (7, [4.0, 4.0]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit("x"), "asking": F.lit("y"), "score": F.lit("z")})
    found = {}
    for r in vectors.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [1, 2, 3, 7, 50], 50: [3, 7, 0, 1, 2]}
    assert vectors.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((600, 24))
    coder = vectors.learn(points, 5)
    index = vectors.Index(np.arange(600), points, coder)
    for radius in (0, 1, 3, 6, 17, 26):
        for code in index.codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(index.codes ^ code) <= radius).tolist()


def cheapest(roles):
    """All ways, turn by turn, with up to three empty turns before each."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for p, cost in best.items():
            for q in range(1, chat.STATES):
                change = 0 if chat.ROLES[q] == role else chat.RELABEL
                ways = [chat.MERGE + change] if p == q else []
                for empty in itertools.chain.from_iterable(itertools.product(range(1, chat.STATES), repeat=n) for n in range(4)):
                    path = (p, *empty, q)
                    if all(chat.ROLES[b] in chat.FOLLOWS[chat.ROLES[a]] for a, b in itertools.pairwise(path)):
                        ways.append(len(empty) * chat.INSERT + change)
                if ways:
                    after[q] = min(after.get(q, 10**9), cost + min(ways))
        best = after
    return min(cost + {1: 2, 2: 1, 3: 0}[p] * chat.INSERT for p, cost in best.items())


@pytest.mark.parametrize("run", [256, 2])
def test_repair_costs_the_least(spark, run):
    rnd = random.Random(3)
    rows, talks = [], {}
    for c in range(40):
        talks[c] = [rnd.choice(["system", "user", "assistant", " USER", "tool", None]) for _ in range(rnd.choice([1, 2, 3, 9, 30]))]
        rows += [(c, 5 * k if c % 2 else k, role, f"x{k}") for k, role in enumerate(talks[c])]
    rows += [*rows[:20], (None, None, None, None)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"run": F.lit("a"), "at": F.lit("b"), "first": F.lit("c")})
    found = chat.repair(frame, run).toPandas()
    for c, roles in talks.items():
        own = found[found.conv_id == c].sort_values(["turn", "piece"])
        assert own.cost.sum() == cheapest([r.strip().lower() if r else None for r in roles])
        heads = [h for h in re.findall(r"<\|(\w+)\|>", "".join(own.rendered)) if h != "end"]
        assert all(b in chat.FOLLOWS[a] for a, b in itertools.pairwise(["start", *heads])) and heads[-1] == chat.LAST
        assert sum(own.action != "insert") == len(roles)
        assert [t for t in re.split(r"<\|\w+\|>|\n", "".join(own.rendered)) if t] == [f"x{k}" for k in range(len(roles))]
    assert found[found.conv_id.isna()].rendered.str.cat() == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.repair(frame.limit(0)).count() == 0


def test_legal_conversations_stay(spark, tables):
    found = chat.repair(tables("conversations"))
    assert found.where("action in ('merge', 'relabel')").count() == 0
    assert found.where("action = 'keep'").count() == tables("conversations").count()


def test_pipeline_stages(spark, edges, tables, tmp_path):
    import corpus_pipeline as pipeline
    from curbside.session import stage

    columns = tables("documents").columns
    item = tables("benchmark").first().text
    extra = spark.createDataFrame([(10**6, f"In the end {item} was all they said", "en", "s", 0), (10**6 + 1, "the end token = \"0123456789abcdef0123456789abcdef\" of the story", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 0)], tables("documents").schema)
    docs = tables("documents").unionByName(extra).unionByName(edges.select(*(F.col(c) if c != "doc_id" else (F.col(c) + 2 * 10**6).alias(c) for c in columns)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tables("benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps, seen = dict(pipeline.STAGES), {}
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in pipeline.STAGES[:-1]:
        now = stage(step(spark, now, str(tmp_path)), "step")
        assert now.columns == columns and now.dtypes == docs.dtypes
        seen[name] = {r.doc_id: r for r in now.collect()}
    before = {r.doc_id: r for r in docs.collect()}
    first, second, third, fourth = seen.values()
    gone = set(before) - set(first)
    assert gone == {d for d, r in before.items() if d is not None and not re.search(r"[^\W\d_]", r.text or "")} >= {10**6 + 2}
    groups = groups_of({d: r.text for d, r in first.items() if d is not None})
    assert set(second) - {None} == {root for _, root in groups.values()}
    leaked = set(second) - set(third)
    wanted = decontaminate.leaks(docs.select("doc_id", "text"), tables("benchmark")).select("doc_id").distinct()
    assert 10**6 in leaked and leaked == {r.doc_id for r in wanted.collect()} & set(second)
    # the value alone is a secret: what it is called stays, and so do both quotes, where the whole match has just the first
    assert set(fourth) == set(third) and fourth[10**6 + 1].text == 'the end token = "[secret]" of the story' and fourth[10**6 + 1].n_chars == len(fourth[10**6 + 1].text)
    changed = {d for d in fourth if fourth[d].text != third[d].text}
    assert all("[secret]" in fourth[d].text for d in changed) and 0 < len(changed) < 0.1 * len(fourth)
    packed = steps["best-fit packing"](spark, now, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna().astype(int)) == set(fourth) - {None}
    none = [step(spark, docs.limit(0), str(tmp_path)).count() for _, step in pipeline.STAGES]
    assert none == [0] * 5
