"""Benchmark: run every named analysis at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed end to end from the raw Parquet tables (mart build
included) into Spark's no-op sink, so the whole plan runs without collecting
rows. One warm-up pass over all queries is run first (JIT, file listing);
then ``BENCH_REPEATS`` (default 2) timed passes, reporting each query's best
time, which damps machine noise. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scenaria.plans.catalog import QUERIES  # noqa: E402
from scenaria.session import local_session  # noqa: E402


def run(spark, name, sf_dir) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    for n in names:
        run(spark, n, sf_dir)
    best = {n: float("inf") for n in names}
    for _ in range(repeats):
        for n in names:
            best[n] = min(best[n], run(spark, n, sf_dir))
    times = {n: round(t, 3) for n, t in best.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": f"sum_query_seconds_best_of_{repeats}",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus) if cpus.isdigit() else cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
