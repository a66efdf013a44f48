"""Reuse of the prepared table and the fitted model by later applications."""

import json
import os
import shutil
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SMALL
from riskframe.plans import context, store
from riskframe.plans import queries as Q

APPLICATION = """
import json, os, sys
sys.path.insert(0, {root!r})
from riskframe.session import local_session
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", {shared!r}).config(
    "spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
from riskframe.plans import queries as Q
from riskframe.plans.context import prepared
table = prepared(spark, {source!r}).base
model = Q._model(spark, {source!r})
print("RESULT " + json.dumps([table.inputFiles(), table.count(), model.facts(),
                              [list(r) for r in Q.svm_test_metrics(spark, {source!r}).collect()]]))
spark.stop()
"""


def _files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def _application(shared, source):
    code = APPLICATION.format(root=ROOT, shared=shared, source=source)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
                         env=os.environ | {"PYTHONPATH": ROOT})
    lines = [x for x in out.stdout.splitlines() if x.startswith("RESULT ")]
    assert lines, out.stderr[-3000:]
    return json.loads(lines[0].removeprefix("RESULT "))


def test_second_application_writes_nothing(tmp_path):
    shared = str(tmp_path / "shared")
    first = _application(shared, SMALL)
    kept = f"{shared}/riskframe-store"
    written = [(f, os.path.getsize(f)) for f in _files(kept)]
    assert sum("manifest-" in f for f, _ in written) == 2  # the table and the model
    second = _application(shared, SMALL)
    assert [(f, os.path.getsize(f)) for f in _files(kept)] == written
    assert second == first


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    for t in context.SOURCE_TABLES:
        path = f"{SMALL}/{t}.parquet"
        (shutil.copytree if os.path.isdir(path) else shutil.copy)(path, folder / f"{t}.parquet")
    return str(folder)


def test_changed_file_leads_to_another_entry(spark, source):
    before = context.table_key(spark, source)
    assert context.table_key(spark, source + "/") == before
    path = f"{source}/orders.parquet"
    at = path if os.path.isfile(path) else next(f for f in _files(path) if f.endswith(".parquet"))
    os.utime(at, (time.time() + 60, time.time() + 60))
    after = context.table_key(spark, source)
    assert after != before
    spark.read.parquet(path).limit(100).coalesce(1).write.parquet(f"{source}/fewer.parquet")
    os.replace(next(f for f in _files(f"{source}/fewer.parquet") if f.endswith(".parquet")), at)
    assert context.table_key(spark, source) not in (before, after)


def _table(spark, key, rows, builds):
    def build():
        builds.append(rows)
        return spark.range(rows)
    return store.keep_table(spark, key, build)


def _key(name):
    return store.entry_key("test", name, ["1", "1", "1", str(time.time_ns())], {})


def test_uncommitted_or_damaged_data_are_not_read(spark):
    builds, key = [], _key("a")
    assert _table(spark, key, 10, builds).count() == 10
    assert _table(spark, key, 20, builds).count() == 10 and builds == [10]
    root = store.store_root(spark).removeprefix("file:")
    # a lost writer leaves data without a manifest
    spark.range(30).write.parquet(f"{root}/{key}/data-lost")
    assert _table(spark, key, 20, builds).count() == 10
    # a file of the committed data is gone
    os.remove(next(f for f in _files(f"{root}/{key}") if f.endswith(".parquet") and "data-lost" not in f))
    assert _table(spark, key, 20, builds).count() == 20 and builds == [10, 20]


def test_failed_write_commits_nothing(spark):
    key = _key("b")
    with pytest.raises(Exception, match="too large"):
        store.keep_table(spark, key, lambda: spark.range(10).select(
            F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("too large")))))
    assert store.find(spark, key) is None
    builds = []
    assert _table(spark, key, 5, builds).count() == 5 and builds == [5]


def test_empty_table_is_kept(spark):
    builds, key = [], _key("e")
    assert _table(spark, key, 0, builds).count() == 0
    assert _table(spark, key, 0, builds).columns == ["id"] and builds == [0]


def test_clean_up_removes_what_is_unused(spark):
    builds, old, new = [], _key("c"), _key("d")
    _table(spark, old, 3, builds)
    _table(spark, new, 4, builds)
    root = store.store_root(spark).removeprefix("file:")
    spark.range(30).write.parquet(f"{root}/{old}/data-lost")
    long_ago = time.time() - 10_000
    for f in os.listdir(f"{root}/{old}"):
        os.utime(f"{root}/{old}/{f}", (long_ago, long_ago))
    # data as old as those of the other entry, but its manifest was used since
    for f in os.listdir(f"{root}/{new}"):
        os.utime(f"{root}/{new}/{f}", (long_ago, long_ago))
    _table(spark, new, 4, builds)
    removed = store.clean_up(spark, 5_000)
    assert {r.split("/")[0] for r in removed} == {old} and len(removed) == 3
    assert not os.path.exists(f"{root}/{old}")
    assert _table(spark, new, 4, builds).count() == 4 and builds == [3, 4]
    assert _table(spark, old, 3, builds).count() == 3 and builds == [3, 4, 3]


def test_missing_source(spark):
    with pytest.raises(FileNotFoundError):
        context.prepared(spark, "/root/testdata/none.parquet")


def test_loaded_model_reports_like_the_fitted_one(spark):
    fitted = Q._model(spark, SMALL)
    context.reset()
    loaded = Q._model(spark, SMALL)
    assert loaded is not fitted and loaded.facts() == fitted.facts()
    assert Q.svm_model_config(spark, SMALL).collect()
