"""Benchmark: every registered query at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8). Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed fully with the ``noop`` sink (all rows computed,
nothing collected). ``prepare`` is the one-time build of the application
table and the split; ``fit_preprocessing`` and ``fit_model`` are the
one-time fits shared by later queries, timed on their own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskframe.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    from riskframe.plans import context, queries as Q

    timings: dict[str, float] = {}
    t_all = time.time()

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        timings[name] = round(time.time() - t0, 3)
        return out

    ctx = timed("prepare", lambda: context.prepared(spark, sf_dir))
    timed("fit_preprocessing", lambda: Q._state(spark, sf_dir))
    timed("fit_model", lambda: Q._model(spark, sf_dir))
    for name, fn in Q.QUERIES.items():
        timed(name, lambda fn=fn: fn(spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(time.time() - t_all, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
