"""Exact quantile search and exact-quota hash sampling against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.columns import hash_order
from riskframe.operators import quantiles, sampling

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _data(kind, n, rng):
    if kind == "normal":
        return [rng.gauss(0, 1) for _ in range(n)]
    if kind == "heavy":  # a third of all rows share one value, plus a wide tail
        return [7.0 if i % 3 == 0 else rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for i in range(n)]
    if kind == "spread":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "ints":
        return [float(rng.randint(-3, 3)) for _ in range(n)] + [-0.0, 0.0]
    raise ValueError(kind)


@pytest.mark.parametrize("kind", ["normal", "heavy", "spread", "ints"])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_match_numpy(spark, kind, accuracy, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(hash(kind) % 1000)
    xs = _data(kind, 3000, rng)
    df = spark.createDataFrame([(0 if i % 4 else 1, x) for i, x in enumerate(xs)] + [(1, None), (1, math.nan)], "g int, x double")

    def ranks_for(n):
        return {r for p in PROBS for r in quantiles.quantile_ranks(n, p)[:2]}

    sizes, stats = quantiles.order_statistics(df, ["x"], PROBS, by=["g"])
    for g in (0, 1):
        vals = np.array(sorted(x for i, x in enumerate(xs) if (0 if i % 4 else 1) == g))
        assert sizes[(g, 0)] == len(vals)
        for r in ranks_for(len(vals)):
            assert stats[(g, 0)][r] == vals[r]
    q = quantiles.exact_quantiles(df, ["x"], PROBS, by=["g"])
    for g in (0, 1):
        vals = np.array([x for i, x in enumerate(xs) if (0 if i % 4 else 1) == g])
        expect = np.percentile(vals, [p * 100 for p in PROBS])
        for p, e in zip(PROBS, expect):
            assert q[(g, "x")][p] == pytest.approx(e, rel=1e-12, abs=0)


def test_quantiles_of_infinities_and_null_groups(spark):
    inf = math.inf
    xs = {None: [-inf] * 3 + [1.0, 2.0, 3.0], "a": [-inf, 5.0, 6.0, inf], "b": [-inf] * 4, "c": [7.0]}
    df = spark.createDataFrame([(g, x) for g, v in xs.items() for x in [*v, None]], "g string, x double")
    q = quantiles.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], by=["g"])
    assert q == {(None, "x"): {0.0: -inf, 0.5: -inf, 1.0: 3.0}, ("a", "x"): {0.0: -inf, 0.5: 5.5, 1.0: inf},
                 ("b", "x"): {0.0: -inf, 0.5: -inf, 1.0: -inf}, ("c", "x"): {0.0: 7.0, 0.5: 7.0, 1.0: 7.0}}


def test_rank_outside_its_bracket_is_searched_again(spark, monkeypatch):
    """Brackets on the wrong side of their probability: the counts show it."""
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    monkeypatch.setattr(quantiles, "MARGIN", -0.4)
    calls = []
    real = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: calls.append(1) or real(*a))
    df = spark.range(1000).select((F.col("id") * 3 % 1000).cast("double").alias("x"))
    q = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5])
    assert q[("x",)] == {0.25: 249.75, 0.5: 499.5}
    assert len(calls) == 2


def test_only_wanted_order_statistics_reach_the_driver(spark, monkeypatch):
    """Two passes, and as many collected rows as ranks."""
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    got = []
    real = quantiles._selected
    monkeypatch.setattr(quantiles, "_selected", lambda *a: (got.append(real(*a)), got[-1])[1])
    counts = []
    real_counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: (counts.append(real_counted(*a)), counts[-1])[1])
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").cast("double").alias("x"))
    quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], by=["g"])
    assert len(counts) == 1 and got[0].count() <= 2 * 3 * 2
    assert counts[0].count() < 50_000 * 0.5  # all other values are counted by gap


def _brute_pick(rows, label_quota, salt):
    import hashlib
    by = {}
    for key, y in rows:
        h = int(hashlib.md5((salt + str(key)).encode()).hexdigest()[:8], 16)
        by.setdefault(y, []).append((h, key))
    picked = set()
    for y, lst in by.items():
        for _, key in sorted(lst)[:label_quota[y]]:
            picked.add(key)
    return picked


@pytest.mark.parametrize("n,pos_every", [(7, 3), (500, 11), (4000, 13)])
def test_stratified_split_matches_brute_force(spark, n, pos_every):
    rows = [(k * 7 + 3, int(k % pos_every == 0)) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, y int")
    out = sampling.stratified_split(df, "y", "key", "0.2", "salt-a:")
    got = {r.key for r in out.where("split = 'test'").collect()}
    counts = Counter(y for _, y in rows)
    total = -(-n // 5)
    quota = sampling.largest_remainder(dict(counts), total)
    assert len(got) == total
    assert got == _brute_pick(rows, quota, "salt-a:")


def test_tiny_strata_quotas():
    assert sampling.largest_remainder({0: 5, 1: 2}, 2) == {0: 1, 1: 1}
    assert sampling.largest_remainder({0: 92, 1: 8}, 20) == {0: 18, 1: 2}


def test_hash_ties_resolved_by_key(spark):
    # many keys, tiny quota: the boundary sits inside a hash bucket
    rows = [(k, 0) for k in range(20000)]
    df = spark.createDataFrame(rows, "key long, y int")
    col, quotas, _ = sampling.stratified_pick(df, "y", "key", "0.0003", "s:", round_up=True)
    got = {r.key for r in df.where(col).collect()}
    assert got == _brute_pick(rows, quotas, "s:")


def test_hash_order_is_python_md5(spark):
    import hashlib
    r = spark.range(1).select(hash_order(F.lit(12345), "abc:").alias("h")).first()
    assert r.h == int(hashlib.md5(b"abc:12345").hexdigest()[:8], 16)


def test_hash_sample_top_k(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    s = sampling.hash_sample(df, "key", 50, "x:")
    import hashlib
    expect = sorted(range(1000), key=lambda k: (int(hashlib.md5(f"x:{k}".encode()).hexdigest()[:8], 16), k))[:50]
    assert sorted(r.key for r in s.collect()) == sorted(expect)


@pytest.mark.parametrize("n", [500, 4000])
def test_stratified_split_with_stored_hash(spark, n):
    # the table may carry hash_order(key, salt) as a column, written once
    rows = [(k * 7 + 3, int(k % 11 == 0)) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, y int")
    stored = df.withColumn("h", hash_order("key", "salt-a:"))
    a = sampling.stratified_split(df, "y", "key", "0.2", "salt-a:")
    b = sampling.stratified_split(stored, "y", "key", "0.2", "salt-a:", hash_col="h")
    assert ({r.key for r in a.where("split = 'test'").collect()}
            == {r.key for r in b.where("split = 'test'").collect()})


def test_stored_order_with_heavy_ties(spark):
    # a stored order column with only 3 values: the boundary falls among
    # tied orders and is resolved by key
    rows = [(k, int(k % 4 == 0), k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, y int, h long")
    col, quotas, _ = sampling.stratified_pick(df, "y", "key", "0.3", "unused:", round_up=True,
                                              hash_col="h")
    got = {r.key for r in df.where(col).collect()}
    expect = set()
    for y in (0, 1):
        members = sorted((h, k) for k, yy, h in rows if yy == y)
        expect |= {k for _, k in members[:quotas[y]]}
    assert got == expect


def test_split_predicates_match_split_and_bounds(spark):
    rows = [(k * 3 + 1, int(k % 9 == 0)) for k in range(5000)]
    df = spark.createDataFrame(rows, "key long, y int").withColumn("h", hash_order("key", "s:"))
    test, train = sampling.split_predicates(df, "y", "key", "0.2", "s:", hash_col="h")
    split = sampling.stratified_split(df, "y", "key", "0.2", "s:", hash_col="h")
    assert ({r.key for r in df.where(test).collect()}
            == {r.key for r in split.where("split = 'test'").collect()})
    assert ({r.key for r in df.where(train).collect()}
            == {r.key for r in split.where("split = 'train'").collect()})
    assert sampling.hash_bounds({0: (5, 1), 1: (9, 2)}) == (9, 5)
    assert sampling.hash_bounds({0: "all", 1: None}) == (None, None)


def test_split_predicate_skips_row_groups(spark, tmp_path):
    """Files sorted by the stored hash order: the test predicate's hash bound
    lets the Parquet scan skip the training rows' row groups."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("parquet.block.size")
    conf.setInt("parquet.block.size", 64 * 1024)
    try:
        path = str(tmp_path / "t")
        (spark.range(200_000).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("y"))
         .withColumn("h", hash_order("key", "s:")).coalesce(1).sortWithinPartitions("h")
         .write.parquet(path))
    finally:
        if old is None:
            conf.unset("parquet.block.size")
        else:
            conf.set("parquet.block.size", old)
    df = spark.read.parquet(path)
    test, _ = sampling.split_predicates(df, "y", "key", "0.2", "s:", hash_col="h")
    sel = df.where(test).select("key")
    assert len(sel.collect()) == 40_000
    leaves = sel._jdf.queryExecution().executedPlan().collectLeaves()
    scanned = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
               if leaves.apply(i).metrics().contains("numOutputRows")]
    assert scanned and scanned[0] < 100_000


def test_hash_sample_edges(spark):
    df = spark.range(30).withColumnRenamed("id", "key")
    assert sampling.hash_sample(df, "key", 100, "x:").count() == 30
    assert sampling.hash_sample(df, "key", 0, "x:").count() == 0
    assert sampling.hash_sample(df.limit(0), "key", 5, "x:").count() == 0
