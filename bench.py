"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

A batch query counts with the median of three runs after a warm-up, a streaming query with one run from its first
micro-batch to its last. Every run computes all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curbside.plans import queries as Q  # noqa: E402
from curbside.session import build_session, new_folder, scratch_scope  # noqa: E402
from curbside.streaming import start_matching  # noqa: E402

RUNS = 3


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    with scratch_scope(spark):
        Q.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def micro_batches(spark, sf_dir: str) -> dict:
    """Time per micro-batch and state size of the matching stream, to hold against its interval of two seconds."""
    with scratch_scope(spark):
        out, log = new_folder(spark, "out"), new_folder(spark, "log")
        query = start_matching(*Q.streams(spark, sf_dir), out, log, trigger=None)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p.numInputRows]
    return {
        "batches": len(progress),
        "seconds": round(statistics.median(p.durationMs["triggerExecution"] for p in progress) / 1000, 3),
        "rows": max(p.numInputRows for p in progress),
        "state_rows": max(p.stateOperators[0].numRowsTotal for p in progress),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or list(Q.QUERIES)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if name.startswith("stream"):
            seconds[name] = timed(spark, name, sf_dir)
        else:
            timed(spark, name, sf_dir)
            seconds[name] = statistics.median(timed(spark, name, sf_dir) for _ in range(RUNS))
    batches = micro_batches(spark, sf_dir) if "stream_knn" in names else None
    spark.stop()
    print(json.dumps({
        "metric": "total seconds, median of warm runs per query", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "shuffle_partitions": int(cpus),
        "micro_batches": batches,
    }))


if __name__ == "__main__":
    main()
