"""Every operator as a query over the tables of a data folder: ``f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.functions import decode as D
from curbside.functions.grid import Grid
from curbside.functions.plane import distance, normalize_lon
from curbside.operators import movement as M
from curbside.operators.neighbours import nearest
from curbside.operators.spread import skew_join
from curbside.operators.state import latest
from curbside.operators.radius import within
from curbside.plans.matching import match_all, match_cells, match_parts, merged_parts, part_lists
from curbside.session import new_folder, tune
from curbside.sources import tables as S
from curbside.sources.feeds import read_feed, stream_feed
from curbside.sources.tail import growing_feed
from curbside.streaming import jobs
from curbside.streaming.incremental import current_matches, start_incremental
from curbside.streaming.members import fold_members
from curbside.streaming.movement import fold_transitions, live_counts
from curbside.streaming.sinks import all_batches, last_batch

GRID = Grid()
MATCH = ["client_id", "taxi_id", "rk", "dist"]
CLOSE = 0.02  # radius of the range search
SLICES = 3  # micro-batches the streaming queries run through
FILE_ROWS = 1_000_000  # messages of a file
HISTORY = 10_000  # pings of a taxi among which a late one finds its place


# decoding

def decode_taxi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode_taxis(D.encode(S.pings(spark, sf_dir), D.TAXI_FIELDS))


def decode_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode_clients(D.encode(S.requests(spark, sf_dir), D.CLIENT_FIELDS))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All taxi messages; of every ten one is cut off in the middle and one lacks its id."""
    pings = S.pings(spark, sf_dir).withColumn("last", F.col("seq") % 10)
    message = F.to_json(F.struct(F.when(F.col("last") != 1, F.col("taxi_id")).alias("taxiId"), "lon", "lat", "seq"))
    return pings.select(F.when(F.col("last") == 0, F.substring(message, 1, 12)).otherwise(message).alias("value"))


def drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode_taxis(_damaged(spark, sf_dir))


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = D.rejects(_damaged(spark, sf_dir), D.TAXI_FIELDS)
    is_json = F.try_parse_json("value").isNotNull()
    return lost.groupBy(is_json.alias("is_json")).agg(F.count("*").alias("n"))


# state

def latest_taxi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.taxis(spark, sf_dir)


def latest_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clients(spark, sf_dir)


# projections

def distance_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each ping is from where its taxi ended up."""
    ends = S.taxis(spark, sf_dir).select("taxi_id", F.col("lon").alias("end_lon"), F.col("lat").alias("end_lat"))
    pairs = skew_join(S.pings(spark, sf_dir), ends, ["taxi_id"], ["seq"])
    dist = distance(F.col("lon"), F.col("lat"), F.col("end_lon"), F.col("end_lat"))
    return pairs.select("taxi_id", "seq", dist.alias("dist"))


def normalized_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = normalize_lon(F.col("lon") + F.lit(360.0))
    return S.pings(spark, sf_dir).select("seq", F.round(wrapped, 9).alias("lon"), "lat")


def grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_cell(S.pings(spark, sf_dir), GRID, compat=False).select("taxi_id", "seq", "cell")


def grid_cell_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_cell(S.pings(spark, sf_dir), GRID).select("taxi_id", "seq", "cell")


def grid_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of each cell and the mean distance of the pings in it to that centre."""
    pings = M.with_cell(S.pings(spark, sf_dir), GRID)
    centers = GRID.centers(spark).select("cell", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"))
    # one row per grid cell, a size fixed by the grid
    near = pings.join(F.broadcast(centers), "cell")
    dist = distance(F.col("center_lon"), F.col("center_lat"), F.col("lon"), F.col("lat"))
    return near.groupBy("cell", "center_lon", "center_lat").agg(
        F.count("*").alias("n"), F.min(dist).alias("closest"), F.max(dist).alias("farthest")
    )


# matching

def knn_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_all(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select(*MATCH)


def knn_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_parts(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select(*MATCH)


def knn_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_lists(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select("client_id", "part", "taxi_id", "rk")


def knn_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the parts of ``knn_partial``, merged to one list per client."""
    return merged_parts(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select(*MATCH)


def knn_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_cells(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select("cell", *MATCH)


def knn_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per client over all cells, the overflow cell included: the same as a search that ignores the cells."""
    return nearest(S.clients(spark, sf_dir), S.taxis(spark, sf_dir), max_distance=0.5).select(*MATCH)


def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(S.clients(spark, sf_dir), S.taxis(spark, sf_dir)).select(*MATCH)


def knn_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large case: one taxi per order, one client per customer."""
    return nearest(S.riders(spark, sf_dir), S.fleet(spark, sf_dir), copy_inputs=False).select(*MATCH)


def knn_fleet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large case by the strategy ``parts``."""
    return match_parts(S.riders(spark, sf_dir), S.fleet(spark, sf_dir), copy_inputs=False).select(*MATCH)


def knn_fleet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large case by the strategy ``cells``."""
    return match_cells(S.riders(spark, sf_dir), S.fleet(spark, sf_dir)).select("cell", *MATCH)


def knn_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most taxis in a small area or on few spots, clients there and far away."""
    return nearest(S.crowded_riders(spark, sf_dir), S.crowded_fleet(spark, sf_dir), copy_inputs=False).select(*MATCH)


def knn_within_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(S.crowded_riders(spark, sf_dir), S.crowded_fleet(spark, sf_dir), max_distance=CLOSE, copy_inputs=False).select(*MATCH)


def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(S.clients(spark, sf_dir), S.taxis(spark, sf_dir), CLOSE)


def knn_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(S.clients(spark, sf_dir), S.taxis(spark, sf_dir), max_distance=CLOSE).select(*MATCH)


# movement

def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(S.pings(spark, sf_dir), GRID)


def moved_taxis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.moved_taxis(S.pings(spark, sf_dir), GRID).select("taxi_id")


def moved_flag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pings = S.pings(spark, sf_dir)
    return M.with_moved_flag(pings, M.moved_taxis(pings, GRID)).select("taxi_id", "seq", "moved")


def cell_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_deltas(S.pings(spark, sf_dir), GRID)


def cell_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_members(S.pings(spark, sf_dir), GRID)


def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_stats(S.pings(spark, sf_dir), S.clients(spark, sf_dir), GRID)


# streaming: the tables as message files, worked off one slice per micro-batch

def write_feed(df: DataFrame, fields: dict[str, str], slices: int = SLICES, late: int | None = None) -> tuple[str, int]:
    """Write all rows as JSON message files, one folder per slice in the order of ``seq``: folder, files per slice.

    Every slice has the same number of files, as many as its rows ask for, so that a stream that takes so many files at
    a time works off a slice per micro-batch whatever the size. With ``late`` every so many messages come a slice late.
    """
    folder = new_folder(df.sparkSession, "feed")
    first, last = df.agg(F.min("seq"), F.max("seq")).first()
    width = (last - first) // slices + 1
    files = -(-width // FILE_ROWS)
    for i in range(slices):
        at = F.col("seq") if late is None else F.when(F.col("seq") % late == 0, F.least(F.col("seq") + width, F.lit(last))).otherwise(F.col("seq"))
        rows = df.where((at >= first + i * width) & (at < first + (i + 1) * width))
        # neighbouring seq go to different files, so none is empty unless seq has wide gaps
        dealt = rows.withColumn("file", F.pmod("seq", F.lit(files)))
        told = D.encode(dealt, fields, keep=["file"])
        told.repartition(files, "file").write.partitionBy("file").text(f"{folder}/slice={i}")
    return folder, files


def _stream(spark: SparkSession, rows: DataFrame, fields: dict[str, str], late: int | None = None) -> DataFrame:
    folder, files = write_feed(rows, fields, late=late)
    return stream_feed(spark, folder, max_files=files)


def _taxi_stream(spark: SparkSession, sf_dir: str, late: int | None = None) -> DataFrame:
    return D.decode_taxis(_stream(spark, S.pings(spark, sf_dir), D.TAXI_FIELDS, late))


def _client_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode_clients(_stream(spark, S.requests(spark, sf_dir), D.CLIENT_FIELDS))


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The streams of both feeds, taxis first."""
    return _taxi_stream(spark, sf_dir), _client_stream(spark, sf_dir)


def _finish(query) -> None:
    query.awaitTermination()


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "out")
    _finish(jobs.start_latest(_taxi_stream(spark, sf_dir), "taxi_id", out, new_folder(spark, "log"), trigger=None))
    return last_batch(spark, out).select("taxi_id", "lon", "lat")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what changed per micro-batch, folded to the current table."""
    out, log = new_folder(spark, "out"), new_folder(spark, "log")
    _finish(jobs.start_latest(_taxi_stream(spark, sf_dir), "taxi_id", out, log, changes_only=True, trigger=None))
    return latest(all_batches(spark, out), "taxi_id")


def stream_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "out")
    _finish(jobs.start_matching(*streams(spark, sf_dir), out, new_folder(spark, "log"), trigger=None))
    return last_batch(spark, f"{out}/matches").select(*MATCH)


def stream_knn_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists as kept up to date by circles, without matching all clients anew."""
    out = new_folder(spark, "out")
    _finish(start_incremental(*streams(spark, sf_dir), out, new_folder(spark, "log")))
    return current_matches(spark, out).select(*MATCH)


def stream_member_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who came into cells and left them, folded to the members of all cells."""
    out = new_folder(spark, "out")
    _finish(jobs.start_member_changes(_taxi_stream(spark, sf_dir), GRID, out, new_folder(spark, "log"), trigger=None))
    return fold_members(all_batches(spark, out))


def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "out")
    _finish(jobs.start_transitions(_taxi_stream(spark, sf_dir), GRID, out, new_folder(spark, "log"), trigger=None))
    return all_batches(spark, out).select("taxi_id", "seq", "prev", "cell")


def stream_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings and taxis per cell, as counted while the cell changes are written."""
    out, log = new_folder(spark, "out"), new_folder(spark, "log")
    _finish(jobs.start_transitions(_taxi_stream(spark, sf_dir), GRID, out, log, counts=True, trigger=None))
    return live_counts(spark, out).select("cell", "n_updates", "n_held")


def stream_late_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth ping comes a micro-batch late; what was told too early is taken back."""
    out, log = new_folder(spark, "out"), new_folder(spark, "log")
    _finish(jobs.start_transitions(_taxi_stream(spark, sf_dir, late=5), GRID, out, log, history=HISTORY, trigger=None))
    return fold_transitions(all_batches(spark, out))


def stream_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that grows while the stream is restarted, read by a source that remembers bytes, not files."""
    feed, out, log = (new_folder(spark, name) for name in ("feed", "out", "log"))
    folder, _ = write_feed(S.pings(spark, sf_dir), D.TAXI_FIELDS)
    for i in range(SLICES):
        read_feed(spark, f"{folder}/slice={i}").select("value").write.mode("append").text(feed)
        stream = D.decode_taxis(growing_feed(spark, feed))
        _finish(jobs.start_latest(stream, "taxi_id", out, log, trigger=None))
    return last_batch(spark, out).select("taxi_id", "lon", "lat")


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, log = new_folder(spark, "out"), new_folder(spark, "log")
    _finish(jobs.start_transitions(_taxi_stream(spark, sf_dir), GRID, out, log, deltas=True, trigger=None))
    return all_batches(spark, out).select("taxi_id", "seq", "op", "cell")


def stream_cell_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "out")
    _finish(jobs.start_cell_members(_taxi_stream(spark, sf_dir), GRID, out, new_folder(spark, "log"), trigger=None))
    return last_batch(spark, out).select("cell", "taxi_id")


def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the feed: message files read back and folded to the last position."""
    folder, _ = write_feed(S.pings(spark, sf_dir), D.TAXI_FIELDS)
    return latest(D.decode_taxis(read_feed(spark, f"{folder}/*/*")), "taxi_id")


QUERIES = {
    "decode_taxi": decode_taxi, "decode_client": decode_client, "drop_malformed": drop_malformed,
    "malformed": malformed, "decode_files": decode_files,
    "latest_taxi": latest_taxi, "latest_client": latest_client,
    "distance": distance_to_last, "normalize_lon": normalized_lon,
    "grid_cell": grid_cell, "grid_cell_compat": grid_cell_compat, "grid_centers": grid_centers,
    "knn_cross": knn_cross, "knn_broadcast": knn_broadcast, "knn_partial": knn_partial, "knn_merged": knn_merged,
    "knn_per_cell": knn_per_cell, "knn_global": knn_global, "knn_grid": knn_grid, "knn_fleet": knn_fleet,
    "knn_fleet_parts": knn_fleet_parts, "knn_fleet_cells": knn_fleet_cells,
    "knn_clustered": knn_clustered, "knn_within_clustered": knn_within_clustered,
    "radius_join": radius_join, "knn_within": knn_within,
    "transitions": transitions, "moved_taxis": moved_taxis, "moved_flag_join": moved_flag_join,
    "cell_deltas": cell_deltas, "cell_members": cell_members, "cell_stats": cell_stats,
    "stream_latest": stream_latest, "stream_changes": stream_changes, "stream_knn": stream_knn,
    "stream_transitions": stream_transitions,
    "stream_deltas": stream_deltas, "stream_cell_members": stream_cell_members,
    "stream_cell_counts": stream_cell_counts, "stream_late_transitions": stream_late_transitions, "stream_appended": stream_appended,
    "stream_knn_incremental": stream_knn_incremental, "stream_member_changes": stream_member_changes,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](tune(spark), sf_dir)
