"""Every output of the dashboard over one application table, written as
Parquet: the batch job a user of the dashboard runs on their own data.

usage: spark-submit scripts/report.py SOURCE OUT_DIR [QUERY ...]

``SOURCE`` is an application CSV (``*.csv``), a Parquet table of
applications (``*.parquet``) or a folder of the TPC-H-style test tables
(see ``context.load_applications``). Each named query is written to
``OUT_DIR/<query>``. The ``lineitem_*`` workload queries read the test
tables and run only for a test-table folder.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from riskframe.plans.queries import QUERIES
from riskframe.session import ensure_checkpoint_dir

TEST_TABLE_QUERIES = ("lineitem_",)


def report_queries(source: str) -> list[str]:
    """The queries that apply to ``source``."""
    src = source.rstrip("/").lower()
    own_table = src.endswith(".csv") or src.endswith(".parquet")
    return [n for n in QUERIES if not (own_table and n.startswith(TEST_TABLE_QUERIES))]


def run_report(spark: SparkSession, source: str, out_dir: str, names: list[str] | None = None) -> list[str]:
    """Write each query's result under ``out_dir``; returns the written paths."""
    ensure_checkpoint_dir(spark)
    paths = []
    for name in names or report_queries(source):
        path = f"{out_dir.rstrip('/')}/{name}"
        QUERIES[name](spark, source).write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


def main(argv: list[str]) -> None:
    if len(argv) < 2:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("riskframe-report").getOrCreate()
    run_report(spark, argv[0], argv[1], argv[2:] or None)


if __name__ == "__main__":
    main(sys.argv[1:])
