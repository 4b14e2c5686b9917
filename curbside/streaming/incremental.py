"""Matching whose work per micro-batch follows what has changed.

Every client has a circle around it, as wide as its k-th taxi is away. A taxi that moves can only change the lists that it
is in, and those whose circles it comes into. The first, and clients that moved themselves, search again; the others take
the taxi into their list, which is as good as a search: no taxi that stayed where it was can be closer than those they
know. Positions and lists are ledgers, so a micro-batch writes what it changed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbside.operators.neighbours import nearest
from curbside.operators.radius import covered
from curbside.plans.matching import K
from curbside.session import scratch_scope, stage
from curbside.streaming.current import CLIENT, TAXI, current_table, tagged
from curbside.streaming.ledger import COMPACT, Ledger
from curbside.streaming.sinks import batch_path, commit, drop_before, finished_batches

BEST = "array<struct<dist:double,taxi_id:bigint>>"


def positions(out: str, every: int = COMPACT) -> Ledger:
    """Last position per taxi and client."""
    return Ledger(f"{out}/positions", "kind string, id long, seq long, lon double, lat double", ("kind", "id"), every=every)


def lists(out: str, every: int = COMPACT) -> Ledger:
    """Position and list per client; ``batch`` is the micro-batch that changed it last."""
    return Ledger(f"{out}/lists", f"client_id long, batch long, lon double, lat double, best {BEST}", ("client_id",), "batch", every)


def follow_matches(
    out: str, *, k: int = K, every: int = COMPACT, silent: int | None = None, then: Callable[[DataFrame, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for rows ``kind, id, seq, lon, lat`` (see ``tagged``).

    Late and repeated messages change nothing. ``then`` is handed the changed lists of each micro-batch. With ``silent`` a
    taxi or client leaves once the highest ``seq`` of all messages is so much above its own, and comes back with its next
    message above that.
    """
    where, known_lists = positions(out, every), lists(out, every)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            told = stage(current_table(batch), "told")
            known = where.as_of(spark, batch_id - 1, told).select("kind", "id", F.col("seq").alias("_seq"))
            fresh = told.join(known, ["kind", "id"], "left").where("_seq is null or seq > _seq")
            where.append(fresh.select("kind", "id", "seq", "lon", "lat"), batch_id)
            fresh, now = where.changed(spark, batch_id), where.as_of(spark, batch_id)
            gone = None
            if silent is not None:
                last, horizon = horizons(told, out, batch_id, silent)
                fresh, now, everyone = fresh.where(F.col("seq") > horizon), now.where(F.col("seq") > horizon), now
                gone = stage(everyone.where((F.col("seq") <= horizon) & (F.col("seq") > last)).select("kind", "id"), "gone")
            moved = fresh.where(F.col("kind") == TAXI).select(F.col("id").alias("taxi_id"), "lon", "lat")
            came = fresh.where(F.col("kind") == CLIENT).select(F.col("id").alias("client_id"), "lon", "lat")
            before = known_lists.as_of(spark, batch_id - 1).where("best is not null").join(came.select("client_id"), "client_id", "left_anti")
            left, missing = [], moved.select("taxi_id")
            if gone is not None:
                leaving = gone.where(F.col("kind") == CLIENT).select(F.col("id").alias("client_id"))
                left = [before.join(leaving, "client_id", "left_semi").select("client_id", "lon", "lat", F.lit(None).cast(BEST).alias("best"))]
                before = before.join(leaving, "client_id", "left_anti")
                missing = missing.unionByName(gone.where(F.col("kind") == TAXI).select(F.col("id").alias("taxi_id")))
            before = stage(before.select("client_id", "lon", "lat", "best"), "before")
            kth = F.try_element_at("best", F.lit(k))["dist"]
            full = F.coalesce(F.abs(kth) < F.lit(float("inf")), F.lit(False))
            # a moved taxi may be on many lists, so the small side is the distinct taxis
            lost = before.where(full).select("client_id", F.explode("best.taxi_id").alias("taxi_id")).join(missing, "taxi_id", "left_semi")
            lost = before.join(lost.select("client_id").distinct(), "client_id", "left_semi").where(full)
            if not moved.isEmpty():
                lost = lost.unionByName(before.where(~full))
            lost = lost.select("client_id", "lon", "lat")
            again = stage(came.unionByName(lost), "again")
            taxis = now.where(F.col("kind") == TAXI).select(F.col("id").alias("taxi_id"), "lon", "lat")
            found = nearest(again, taxis, k=k, keep_empty=True, copy_inputs=True)
            one = F.when(F.col("taxi_id").isNotNull(), F.struct("dist", "taxi_id"))
            found = found.groupBy("client_id").agg(F.sort_array(F.collect_list(one)).cast(BEST).alias("best"))
            found = again.join(found, "client_id")
            rest = before.join(again.select("client_id"), "client_id", "left_anti").where(full)
            hits = covered(rest.withColumn("radius", kth), moved)
            hits = hits.groupBy("client_id").agg(F.collect_list(F.struct("dist", "taxi_id")).alias("hits"))
            gained = rest.join(hits, "client_id").withColumn("best", F.slice(F.sort_array(F.concat("best", "hits")), 1, k)).drop("hits")
            changed = reduce(DataFrame.unionByName, [found, gained, *left])
            known_lists.append(changed.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)
        if then:
            then(matches_of(known_lists.changed(spark, batch_id)), batch_id)

    return run


def horizons(told: DataFrame, out: str, batch_id: int, silent: int) -> tuple[int, int]:
    """The ``seq`` up to which ids were silent after the micro-batch before, and are after this one."""
    spark, clock, never = told.sparkSession, f"{out}/clock", -(1 << 62)
    earlier = [n for n in finished_batches(spark, clock) if n < batch_id][-1:]
    last = spark.read.schema("seq long").parquet(batch_path(spark, clock, earlier[0])).first()[0] if earlier else never
    highest = max(last, told.agg(F.coalesce(F.max("seq"), F.lit(never))).first()[0])
    commit(spark.range(1).select(F.lit(highest).alias("seq")), clock, batch_id)
    drop_before(spark, clock, batch_id - 1)
    return max(never, last - silent), max(never, highest - silent)


def matches_of(rows: DataFrame) -> DataFrame:
    """``client_id, taxi_id, rk, dist`` of lists; a client without taxis has no row."""
    return rows.select("client_id", F.posexplode("best").alias("at", "hit")).select(
        "client_id", "hit.taxi_id", (F.col("at") + 1).alias("rk"), "hit.dist")


def current_matches(spark: SparkSession, out: str, batch_id: int | None = None) -> DataFrame:
    """The lists of all clients after the newest micro-batch, or after ``batch_id``."""
    if batch_id is None:
        batch_id = max(finished_batches(spark, f"{out}/lists/changes"), default=-1)
    return matches_of(lists(out).as_of(spark, batch_id))


def start_incremental(
    taxis: DataFrame, clients: DataFrame, out: str, checkpoint: str, *, k: int = K, every: int = COMPACT,
    silent: int | None = None, trigger: str | None = None, then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the lists of all clients up to date; see ``current_matches``. ``trigger`` as for the other jobs."""
    writer = tagged(taxis, clients).writeStream.foreachBatch(follow_matches(out, k=k, every=every, silent=silent, then=then))
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
