"""The whole analysis on a user's own application table (CSV or Parquet)
gives the same results as on the table derived from the test tables."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from riskframe import schema as S
from riskframe.plans import context, report
from riskframe.plans.queries import QUERIES
from riskframe.session import ensure_checkpoint_dir
from riskframe.sources import csv

SAME = ["dataset_summary", "missing_profile", "split_counts", "rate_by_education", "gender_pivot",
        "rate_by_weekday", "correlation_pairs", "clip_fences", "impute_stats", "scale_stats",
        "roc_auc", "classification_report", "stratified_subsample", "employment_histogram"]


def _rows(df):
    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def own_tables(spark):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-own-{uuid.uuid4().hex}"
    apps = context.load_applications(spark, SMALL)
    csv.write_csv(apps, f"{base}/application_data.csv")
    apps.write.parquet(f"{base}/applications.parquet")
    return f"{base}/application_data.csv", f"{base}/applications.parquet"


@pytest.mark.parametrize("which", [0, 1])
def test_own_table_matches_test_tables(spark, own_tables, which):
    source = own_tables[which]
    for name in SAME:
        assert _rows(QUERIES[name](spark, source)) == _rows(QUERIES[name](spark, SMALL)), name


def test_parquet_nan_is_missing(spark, tmp_path):
    path = str(tmp_path / "nan.parquet")
    spark.createDataFrame([(1, 0, float("nan")), (2, 1, 2.0)], "SK_ID_CURR long, TARGET int, X double") \
        .write.parquet(path)
    df = context.load_applications(spark, path)
    assert df.where(F.col("X").isNull()).count() == 1


def test_report_writes_every_query(spark, own_tables, tmp_path):
    names = report.report_queries(own_tables[0])
    assert not [n for n in names if n.startswith("lineitem_")]
    assert set(report.report_queries(SMALL)) == set(QUERIES)
    out = str(tmp_path / "report")
    paths = report.run_report(spark, own_tables[0], out, ["rate_by_education", "applicant_scores"])
    assert spark.read.parquet(paths[0]).count() == 5
    assert spark.read.parquet(paths[1]).count() > 0


def test_hot_customer_split_join(spark, tmp_path):
    """A customer holding a third of all orders: the hot-key split join
    gives the same application rows as the plain join."""
    from riskframe.sources import applications as A

    src = SMALL
    out = str(tmp_path / "skewed")
    orders = spark.read.parquet(f"{src}/orders.parquet")
    hot_cust = orders.agg(F.min("o_custkey")).first()[0]
    (orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(hot_cust))
                       .otherwise(F.col("o_custkey")))
     .write.parquet(f"{out}/orders.parquet"))
    for t in ("customer", "nation", "lineitem"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    hot = A.hot_keys(spark.read.parquet(f"{out}/orders.parquet").select("o_custkey"), "o_custkey",
                     share=0.1, min_rows=1)
    assert hot == [hot_cust]
    split = A.applications(spark, out, hot_share=0.1, min_hot_rows=1)
    plain = A.applications(spark, out, min_hot_rows=10 ** 12)
    assert split.count() == plain.count() == orders.count()
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_whole_application_rows_are_not_shuffled(spark):
    """With customers too many to broadcast, only the join's narrow rows are
    shuffled: the result already lies by the key that the table is written by."""
    from riskframe.sources import applications as A

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = A.applications(spark, SMALL).repartition(parts, S.KEY)
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        moves = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert moves and not [x for x in moves if S.KEY in x]
        assert sum("o_orderkey" in x for x in moves) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_table_partitions_grow_with_its_rows(spark, monkeypatch):
    """Many orders: joins, sort and files have as many partitions as the rows
    need, whatever the session's shuffles have, with the same rows and no
    shuffle of the whole rows."""
    from riskframe.sources import applications as A

    orders = A.read_table(spark, SMALL, "orders").count()
    monkeypatch.setattr(A, "PARTITION_ROWS", orders // 50)
    monkeypatch.setattr(A, "LARGE_SIDE_ROWS", 0)
    parts = A.write_partitions(spark, orders)
    assert parts >= 50 > A.shuffle_partitions(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = A.applications(spark, SMALL, partitions=parts).repartition(parts, S.KEY)
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        moves = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert not [x for x in moves if S.KEY in x]
        assert all(any(k in x and f", {parts})" in x for x in moves) for k in ("o_custkey", "c_custkey", "o_orderkey", "l_orderkey"))
        assert rows.rdd.getNumPartitions() == parts
        plain = A.applications(spark, SMALL)
        assert rows.count() == plain.count() == orders
        assert rows.exceptAll(plain).count() == 0 and plain.exceptAll(rows).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_split_predicates_reach_the_scan(spark):
    """At every scale, train and test read the written table with
    the split's hash bound among the Parquet pushed filters."""
    context.reset()
    try:
        ctx = context.prepared(spark, SMALL)
        for df, op in ((ctx.train, "GreaterThanOrEqual(_split_h"), (ctx.test, "LessThanOrEqual(_split_h")):
            plan = df.select("AMT_CREDIT")._jdf.queryExecution().executedPlan().toString()
            pushed = [l for l in plan.split("\n") if "PushedFilters" in l]
            assert pushed and op in pushed[0]
    finally:
        context.reset()
