import random

import pytest
from pyspark.sql import functions as F

from curbside.functions import Grid, decode_clients, decode_taxis
from curbside.functions import decode as D
from curbside.operators import cell_deltas, cell_members, latest, transitions
from curbside.plans import match
from curbside.sources import stream_feed
from curbside.streaming import all_batches, follow_cells, last_batch, print_batches
from curbside.streaming import jobs
from curbside.streaming.movement import last_cells
from curbside.streaming.sinks import finished_batches

GRID = Grid()


def positions(rng, n, ids, first_seq=0):
    return [(rng.randrange(ids), first_seq + i, rng.uniform(-74.05, -73.72), rng.uniform(40.58, 40.85))
            for i in range(n)]


def add_file(spark, folder, rows, name, fields):
    key = list(fields.values())[0]
    df = spark.createDataFrame(rows, f"{key} long, seq long, lon double, lat double")
    D.encode(df, fields).unionByName(spark.createDataFrame([("not json",)], "value string")).coalesce(1).write.text(
        f"{folder}/{name}")


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("taxis", "clients", "out", "log")}


def batches(rng, count=3, n=80, ids=12):
    return [positions(rng, n, ids, i * n) for i in range(count)]


def feed(spark, folders, kind, parts, fields, start=0):
    for i, rows in enumerate(parts):
        add_file(spark, folders[kind], rows, f"part{start + i}", fields)


def taxi_stream(spark, folders):
    return decode_taxis(stream_feed(spark, folders["taxis"], max_files=1))


def client_stream(spark, folders):
    return decode_clients(stream_feed(spark, folders["clients"], max_files=1))


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def table(spark, parts, key):
    return spark.createDataFrame([r for p in parts for r in p], f"{key} long, seq long, lon double, lat double")


def got(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("method", ["all", "parts", "cells"])
def test_matching_with_a_restart(spark, folders, method):
    rng = random.Random(1)
    taxis, clients, handed_on = batches(rng, 2), batches(rng, 2, 30), []

    def run():
        finish(jobs.start_matching(taxi_stream(spark, folders), client_stream(spark, folders), folders["out"],
                                   folders["log"], method=method, trigger=None,
                                   then=lambda found, batch: handed_on.append((batch, found.count()))))
        return last_batch(spark, folders["out"] + "/matches")

    def expected(n):
        current = (latest(table(spark, p[:n], key), key) for p, key in ((clients, "client_id"), (taxis, "taxi_id")))
        return match(*current, method=method)

    feed(spark, folders, "taxis", taxis[:1], D.TAXI_FIELDS)
    feed(spark, folders, "clients", clients[:1], D.CLIENT_FIELDS)
    first = run()
    assert got(first) == got(expected(1).select(first.columns))
    feed(spark, folders, "taxis", taxis[1:], D.TAXI_FIELDS, 1)
    feed(spark, folders, "clients", clients[1:], D.CLIENT_FIELDS, 1)
    second = run()
    assert got(second) == got(expected(2).select(second.columns))
    assert handed_on[-1][1] == second.count() and [b for b, _ in handed_on] == list(range(len(handed_on)))


def test_latest_with_copies_in_any_order(spark, folders):
    rng = random.Random(2)
    parts = batches(rng)
    feed(spark, folders, "taxis", [parts[2], parts[0], parts[1], parts[0]], D.TAXI_FIELDS)
    finish(jobs.start_latest(taxi_stream(spark, folders), "taxi_id", folders["out"], folders["log"], trigger=None))
    found = last_batch(spark, folders["out"]).select("taxi_id", "lon", "lat")
    assert got(found) == got(latest(table(spark, parts, "taxi_id"), "taxi_id"))


@pytest.mark.parametrize("deltas", [False, True])
def test_transitions_with_a_restart_and_copies(spark, folders, deltas):
    rng = random.Random(3)
    parts = batches(rng)

    def run():
        finish(jobs.start_transitions(taxi_stream(spark, folders), GRID, folders["out"], folders["log"], deltas=deltas,
                                      trigger=None))

    feed(spark, folders, "taxis", parts[:1], D.TAXI_FIELDS)
    run()
    # the second delivery repeats the first one
    feed(spark, folders, "taxis", [parts[0], parts[1], parts[1] + parts[2]], D.TAXI_FIELDS, 1)
    run()
    batch = (cell_deltas if deltas else transitions)(table(spark, parts, "taxi_id"), GRID)
    assert got(all_batches(spark, folders["out"]).select(batch.columns)) == got(batch)


def test_cell_members(spark, folders):
    rng = random.Random(4)
    parts = batches(rng)
    feed(spark, folders, "taxis", parts, D.TAXI_FIELDS)
    finish(jobs.start_cell_members(taxi_stream(spark, folders), GRID, folders["out"], folders["log"], trigger=None))
    found = last_batch(spark, folders["out"]).select("cell", "taxi_id")
    assert got(found) == got(cell_members(table(spark, parts, "taxi_id"), GRID))


@pytest.mark.parametrize("limit", [20, 10**6])
def test_one_taxi_with_most_pings_and_late_ones(spark, tmp_path, limit):
    """Late pings change nothing and are reported; a taxi with most pings is cut into pieces; a batch may run again."""
    rng = random.Random(6)
    parts = [[(0 if rng.random() < 0.4 else t, s, x, y) for t, s, x, y in part] for part in batches(rng, 3, 100, 9)]
    out = str(tmp_path / "out")
    run = follow_cells(GRID, out, limit=limit)
    run(table(spark, parts[:1], "taxi_id"), 0)
    run(table(spark, parts[1:2], "taxi_id"), 1)
    run(table(spark, parts[1:2], "taxi_id"), 1)
    early = [(t, -1 - k, -73.9, 40.7) for k, (t, _, _, _) in enumerate(parts[0][:5])]
    run(table(spark, [parts[2], early], "taxi_id"), 2)
    assert got(all_batches(spark, out).select("taxi_id", "seq", "prev", "cell")) == got(transitions(table(spark, parts, "taxi_id"), GRID))
    assert got(all_batches(spark, out + "/_late").select("taxi_id", "seq")) == got(spark.createDataFrame([r[:2] for r in early], "taxi_id long, seq long"))
    last = last_cells(out).as_of(spark, 2)
    assert got(last.select("cell", "taxi_id")) == got(cell_members(table(spark, parts, "taxi_id"), GRID))


def test_files_older_than_a_week_are_read(spark, folders):
    import os
    import time

    now = time.time()
    for i, age in enumerate((0, 9 * 86400, 0)):
        add_file(spark, folders["taxis"], [(i + 1, i, -73.9, 40.7)], f"part{i}", D.TAXI_FIELDS)
        for top, _, names in os.walk(f"{folders['taxis']}/part{i}"):
            for name in names:
                os.utime(f"{top}/{name}", (now - age + i, now - age + i))
        finish(jobs.start_latest(taxi_stream(spark, folders), "taxi_id", folders["out"], folders["log"], trigger=None))
    assert sorted(r.taxi_id for r in last_batch(spark, folders["out"]).collect()) == [1, 2, 3]


def test_only_the_newest_batches_stay(spark, tmp_path):
    from curbside.streaming import write_batches

    out = str(tmp_path / "out")
    write = write_batches(out, keep=2)
    for n in range(4):
        write(spark.range(n + 1), n)
    assert finished_batches(spark, out) == [2, 3]


def test_a_feed_has_as_many_files_in_every_slice(spark, monkeypatch):
    import os

    from curbside.plans import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 40)
    rows = spark.createDataFrame([(k % 7, k, 0.5, 0.5) for k in range(300)], "taxi_id long, seq long, lon double, lat double")
    folder, files = queries.write_feed(rows, D.TAXI_FIELDS)
    path = folder.removeprefix("file:")
    sizes = [sum(n.startswith("part-") for _, _, names in os.walk(f"{path}/slice={i}") for n in names) for i in range(3)]
    assert files == 3 and sizes == [3, 3, 3]


def test_kafka_records(spark):
    from curbside.sources.feeds import kafka_messages

    records = spark.createDataFrame([(b'{"taxiId":1,"lon":2,"lat":3}', 7), (b"\xff\xfe", 8), (None, 9)], "value binary, offset long")
    found = D.decode(kafka_messages(records), D.TAXI_FIELDS, seq_field=None, keep=["seq"]).collect()
    assert [tuple(r) for r in found] == [(1, 2.0, 3.0, 7)]


def test_decoding_needs_its_setting(spark):
    rows = spark.createDataFrame([("{}",)], "value string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError, match="allowDuplicateKeys"):
            D.decode_taxis(rows)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def test_a_repeated_batch_replaces_its_folder(spark, tmp_path):
    from curbside.streaming import write_batches

    out = str(tmp_path / "out")
    write = write_batches(out)
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    write(spark.range(7), 1)
    assert all_batches(spark, out).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 5), (1, 7)]
    assert last_batch(spark, out).count() == 7


def test_timed_trigger_and_printing(spark, folders, capsys):
    rng = random.Random(5)
    feed(spark, folders, "taxis", batches(rng, 1), D.TAXI_FIELDS)
    current = taxi_stream(spark, folders).groupBy("taxi_id").agg(F.max("seq").alias("seq"))
    query = jobs._start(current, print_batches(3), folders["log"], "complete", "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert "batch 0" in capsys.readouterr().out


def test_scratch_tables_of_a_batch_go_away(spark, tmp_path):
    import os

    from curbside.session import scratch_scope, stage

    with scratch_scope(spark):
        kept = stage(spark.range(3), "probe")
        path = kept.inputFiles()[0].replace("file://", "")
        assert kept.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_repeated_batch_is_replaced_at_once(spark, tmp_path):
    """A run that ended before its manifest shows nothing; a repeated batch is never missing."""
    import os

    from curbside.streaming import commit
    from curbside.streaming.sinks import MANIFESTS

    out = str(tmp_path / "out")
    first = commit(spark.range(3), out, 0)
    spark.range(9).write.parquet(f"{out}/batch_id=1/run=lost")
    assert finished_batches(spark, out) == [0] and all_batches(spark, out).count() == 3
    before = last_batch(spark, out)
    second = commit(spark.range(5), out, 0)
    assert first != second and before.count() == 3 and last_batch(spark, out).count() == 5
    assert not [n for n in os.listdir(f"{out}/{MANIFESTS}") if n.startswith(".0-")]


def ledger_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, seq long, value string")


def test_ledger(spark, tmp_path):
    """What is written follows the changes; every earlier state can be read until it is too old; batches may repeat."""
    from curbside.streaming import Ledger

    rng = random.Random(8)
    ledger = Ledger(str(tmp_path / "ledger"), "id long, seq long, value string", ("id",), every=3)
    now, states = {}, []
    assert ledger.as_of(spark, 5).collect() == []
    for n in range(8):
        rows = [(k, n * 10 - (3 if k == 2 else 0), f"{n}") for k in rng.sample(range(9), 3)]
        for run in range(2 if n in (3, 4) else 1):
            ledger.append(ledger_rows(spark, rows), n)
            assert sorted(tuple(r) for r in ledger.changed(spark, n).collect()) == sorted(rows)
        for k, seq, value in rows:
            if k not in now or seq >= now[k][0]:
                now[k] = (seq, value)
        states.append(sorted((k, *v) for k, v in now.items()))
        for back in (n, max(0, n - 1)):
            assert sorted(tuple(r) for r in ledger.as_of(spark, back).collect()) == states[back]
    some = spark.createDataFrame([(1,), (99,)], "id long")
    assert [r.id for r in ledger.as_of(spark, 7, some).collect()] == [k for k in now if k == 1]
    assert len(finished_batches(spark, ledger.path + "/changes")) <= 6 and len(finished_batches(spark, ledger.path + "/base")) <= 2


@pytest.mark.parametrize("k, every", [(4, 10), (2, 2)])
def test_incremental_matching(spark, tmp_path, k, every):
    """After every micro-batch the lists are those of a new search; also with late messages, ties and a repeated batch."""
    from brute import knn, same
    from curbside.streaming import current_matches, follow_matches

    rng, out, changed = random.Random(9), str(tmp_path / "out"), []
    run = follow_matches(out, k=k, every=every, then=lambda rows, n: changed.append(rows.select("client_id").distinct().count()))
    now = {"taxi": {}, "client": {}}
    for n in range(6):
        rows = []
        if n == 1:  # clients before there are enough taxis
            rows += [("taxi", 500, 1000, 0.5, 0.5)]
        taxis = range(40) if n == 2 else rng.sample(range(45), 3) if n > 2 else []
        rows += [("taxi", t, 2000 * n + t, rng.randint(0, 9) / 4, rng.randint(0, 9) / 4) for t in taxis]
        clients = range(25) if n == 0 else rng.sample(range(30), 2)
        rows += [("client", c, 2000 * n + c, rng.uniform(0, 2.5), rng.randint(0, 9) / 4) for c in clients]
        rows += [("taxi", 7, -5, 99.0, 99.0), rows[0]]
        if n == 4:
            rows.append(("client", 600, 1, float("inf"), 1.0))
        for kind, key, seq, x, y in rows:
            if key not in now[kind] or seq > now[kind][key][0]:
                now[kind][key] = (seq, x, y)
        frame = spark.createDataFrame(rows, "kind string, id long, seq long, lon double, lat double")
        for _ in range(2 if n in (2, 3) else 1):
            run(frame, n)
            found = [tuple(r) for r in current_matches(spark, out).collect()]
            assert same(found, knn(*([(i, x, y) for i, (_, x, y) in now[kind].items()] for kind in ("client", "taxi")), k))
    assert max(changed[-2:]) < 25


def test_incremental_matching_with_a_restart(spark, folders):
    from curbside.streaming import current_matches, start_incremental

    rng = random.Random(10)
    taxis, clients = batches(rng, 3), batches(rng, 3, 30)
    for n in range(3):
        feed(spark, folders, "taxis", taxis[n:n + 1], D.TAXI_FIELDS, n)
        feed(spark, folders, "clients", clients[n:n + 1], D.CLIENT_FIELDS, n)
        finish(start_incremental(taxi_stream(spark, folders), client_stream(spark, folders), folders["out"], folders["log"]))
        current = (latest(table(spark, p[:n + 1], key), key) for p, key in ((clients, "client_id"), (taxis, "taxi_id")))
        expected = match(*current)
        assert got(current_matches(spark, folders["out"]).select(expected.columns)) == got(expected)


def test_circles(spark):
    """Circles of very different sizes against all pairs, the rim included."""
    from curbside.operators.radius import covered

    rng = random.Random(11)
    circles = [(i, rng.uniform(-2, 2), rng.randint(-4, 4) / 4, rng.choice([0.0, 0.25, 1e-9, 0.03, 2.5, 1e6])) for i in range(60)]
    circles += [(100, None, 0.0, 1.0), (101, 0.0, 0.0, float("inf")), (102, 0.0, float("nan"), 1.0), (103, 0.5, 0.5, None), (104, 1e300, 0.0, 1.0)]
    points = [(i, rng.uniform(-2, 2), rng.randint(-8, 8) / 4) for i in range(80)] + [(200, circles[0][1], circles[0][2]), (201, None, 1.0), (202, 1e300, 0.0)]
    c = spark.createDataFrame(circles, "client_id long, lon double, lat double, radius double")
    p = spark.createDataFrame(points, "taxi_id long, lon double, lat double")
    wanted = []
    for i, x, y, r in circles:
        for t, u, v in points:
            if None not in (x, y, r, u, v) and r < float("inf") and x == x and y == y:
                d = ((u - x) * (u - x) + (v - y) * (v - y)) ** 0.5
                wanted += [(i, t, d)] if d <= r else []
    for limit in (4096, 3):
        assert sorted(tuple(r) for r in covered(c, p, limit=limit).collect()) == sorted(wanted)
    assert covered(c.limit(0), p).count() == 0 and covered(c, p.limit(0)).count() == 0


def test_member_changes_with_a_restart(spark, folders):
    from curbside.streaming import fold_members

    rng = random.Random(12)
    parts = batches(rng, 4)
    for n in (0, 2):
        feed(spark, folders, "taxis", [parts[n], parts[0], parts[n + 1]], D.TAXI_FIELDS, 3 * n)
        finish(jobs.start_member_changes(taxi_stream(spark, folders), GRID, folders["out"], folders["log"], trigger=None, buckets=3))
        changes = all_batches(spark, folders["out"])
        assert got(fold_members(changes)) == got(cell_members(table(spark, parts[:n + 2], "taxi_id"), GRID))
    assert {r.op for r in changes.select("op").distinct().collect()} == {"in", "out"}
    assert changes.groupBy("batch_id", "cell", "taxi_id").count().where("count > 1").count() == 0


def test_files_that_grow(spark, tmp_path):
    """Appended lines arrive once, also after a restart; a line without its end waits; pieces cut no line."""
    from curbside.sources import growing_feed

    feed, out, log = (str(tmp_path / name) for name in ("feed", "out", "log"))
    (tmp_path / "feed" / "deep").mkdir(parents=True)
    one, two = tmp_path / "feed" / "one.log", tmp_path / "feed" / "deep" / "two.log"
    (tmp_path / "feed" / "_hidden").write_text("no\n")

    def seen():
        query = growing_feed(spark, feed, piece_bytes=7).writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
        finish(query.trigger(availableNow=True).start())
        return sorted(r.value for r in spark.read.parquet(out).collect())

    one.write_text("a\nlonger than a piece\nhalf")
    assert seen() == ["a", "longer than a piece"]
    with one.open("a") as file:
        file.write(" a line\n\n")
    two.write_text("\u00fcber\n" + "x" * 40 + "\n")
    assert seen() == ["", "a", "half a line", "longer than a piece", "x" * 40, "\u00fcber"]
    assert seen() == ["", "a", "half a line", "longer than a piece", "x" * 40, "\u00fcber"]


@pytest.mark.parametrize("depth, limit", [(1000, 10**6), (1000, 20), (5, 10**6)])
def test_late_pings_correct_what_was_told(spark, tmp_path, depth, limit):
    """Folded, the stream is the batch result with pings late over batches; beyond the history they are reported."""
    from curbside.streaming import correct_cells, fold_transitions
    from curbside.streaming.movement import history

    rng, out = random.Random(13), str(tmp_path / "out")
    parts = [[(0 if rng.random() < 0.4 else t, s, x, y) for t, s, x, y in part] for part in batches(rng, 3, 100, 9)]
    rows = [r for part in parts for r in part]
    order = sorted(rows, key=lambda r: r[1] + (90 if r[1] % 4 == 0 else 0))
    run = correct_cells(GRID, out, depth=depth, limit=limit, every=2)
    for n in range(3):
        told = order[100 * n:100 * (n + 1)]
        for _ in range(2 if n == 1 else 1):
            run(table(spark, [told, told[:5], order[:5]], "taxi_id"), n)
    late = {(r.taxi_id, r.seq) for r in all_batches(spark, out + "/_late").collect()}
    found = fold_transitions(all_batches(spark, out))
    if depth == 1000:
        assert not late and got(found) == got(transitions(table(spark, [rows], "taxi_id"), GRID))
        assert all_batches(spark, out).where("op = 'retract'").count() > 0
    else:
        assert late and max(len(r.pings) for r in history(out).as_of(spark, 2).collect()) == depth


def test_silent_ids_leave_and_come_back(spark, tmp_path):
    from brute import knn, same
    from curbside.streaming import current_matches, follow_matches

    rng, out, silent = random.Random(14), str(tmp_path / "out"), 100
    run, now = follow_matches(out, k=3, every=2, silent=silent), {"taxi": {}, "client": {}}
    left = []
    for n in range(7):
        ids = {0: range(20), 1: range(10), 2: range(8), 3: [], 4: range(5), 5: range(3, 12), 6: range(12)}[n]
        rows = [("taxi", t, 60 * n + t, rng.uniform(0, 1), rng.uniform(0, 1)) for t in ids]
        rows += [("client", c, 60 * n + c, rng.uniform(0, 1), rng.uniform(0, 1)) for c in ids if c % 2]
        for _ in range(2 if n in (2, 4) else 1):
            run(spark.createDataFrame(rows, "kind string, id long, seq long, lon double, lat double"), n)
        for kind, key, seq, x, y in rows:
            now[kind][key] = (seq, x, y)
        clock = max(v[0] for of in now.values() for v in of.values())
        clients, taxis = ([(i, x, y) for i, (s, x, y) in now[kind].items() if s > clock - silent] for kind in ("client", "taxi"))
        assert same([tuple(r) for r in current_matches(spark, out).collect()], knn(clients, taxis, 3))
        left.append(len(taxis))
    assert min(left) < 12 == left[-1]


def test_counts_per_cell_follow_the_stream(spark, tmp_path):
    """After every micro-batch, also a repeated one, the counts are those of the batch operator."""
    from curbside.operators import cell_stats
    from curbside.streaming import live_counts

    rng, out = random.Random(15), str(tmp_path / "out")
    parts = batches(rng, 3, 100, 9)
    run = follow_cells(GRID, out, counts=True)
    nobody = spark.createDataFrame([], "client_id long, lon double, lat double")
    for n, part in enumerate(parts):
        for _ in range(2 if n == 1 else 1):
            run(table(spark, [part], "taxi_id"), n)
        stats = {r.cell: (r.n_updates, r.n_held) for r in cell_stats(table(spark, parts[:n + 1], "taxi_id"), nobody, GRID).collect()}
        found = live_counts(spark, out).collect()
        assert len(found) == GRID.count and all((r.n_updates, r.n_held) == stats.get(r.cell, (0, 0)) for r in found)
    with pytest.raises(ValueError):
        follow_cells(Grid(0, 1, 1, 0, 50, 50), out, counts=True)
