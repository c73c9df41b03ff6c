"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned fresh and fully executed into Spark's ``noop`` sink
(all rows computed, nothing collected). Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockspark.plans.catalog import load_all  # noqa: E402
from stockspark.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
                                 "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    queries = load_all()
    # warm the JVM (class loading, codegen caches) on a query outside the timed set
    queries["book_kpis"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, (fn, _sql) in queries.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
