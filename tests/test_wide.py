"""Sparse one-hot encoding and principal components of wide features."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import MEDIUM
from riskframe.operators import features
from riskframe.operators.widepca import wide_pca
from riskframe.plans import queries as Q
from riskframe.plans.context import prepared


def _state(num, cats):
    return dict(num_cols=num, cat_cols=list(cats), factor=1.5, fences={}, medians={c: 0.0 for c in num},
                modes={c: v[0] for c, v in cats.items()}, categories=cats, means={}, stds={},
                onehot_means={c: [1 / len(v)] * len(v) for c, v in cats.items()})


def test_encoding_by_lookup(spark):
    st = _state(["x"], {"c": ["a", "b", "z"], "d": ["q"]})
    rows = [(1.5, "b", "q", "own"), (None, None, "other", "own"), (2.0, "new", None, "own")]
    df = spark.createDataFrame(rows, "x double, c string, d string, _numeric0 string")
    out = features.prepared_features(df, st)
    assert out.columns == [*df.columns, "features"]
    # a null takes the mode, an unseen category is all zeros
    assert [r.features.toArray().tolist() for r in out.collect()] == [[1.5, 0, 1, 0, 1], [0, 1, 0, 0, 0], [2, 0, 0, 0, 1]]
    assert {r._numeric0 for r in out.collect()} == {"own"}


def test_plan_does_not_grow_with_the_categories(spark):
    sizes, df = {}, spark.range(60_000).select(F.col("id").cast("double").alias("x"), F.format_string("c%06d", F.col("id") % 50_000).alias("c"))
    for n in (5, 50_000):
        out = features.prepared_features(df, _state(["x"], {"c": [f"c{i:06d}" for i in range(n)]}))
        sizes[n] = len(out._jdf.queryExecution().executedPlan().toString())
    assert sizes[50_000] < 1.1 * sizes[5]
    v = F.unwrap_udt("features")
    got = out.agg(F.sum(F.size(v["values"])).alias("held"), F.max(v["size"]).alias("size")).first()
    assert got.size == 50_001 and got.held <= 2 * 60_000  # two entries a row, not 50,001


def test_wide_components_match_the_exact_ones(spark):
    st = Q._state(spark, MEDIUM)
    x = features.prepared_features(prepared(spark, MEDIUM).train, st)
    d = len(features.feature_names(st))
    exact = Q._model(spark, MEDIUM)
    comps, ratios, mean = wide_pca(x, "features", d, 0.95, first=8)
    assert len(ratios) == exact.k
    assert np.allclose(ratios, exact.explained[:exact.k], atol=1e-6)
    assert np.allclose(mean, features.encoded_means(st), atol=1e-9)
    assert np.allclose(comps.T @ comps, np.eye(exact.k), atol=1e-8)


def test_twenty_thousand_columns(spark):
    """Three planted directions in 20,000 sparse columns."""
    r = np.random.default_rng(3)
    d, rows = 20_000, []
    for _ in range(400):
        at = sorted(r.choice(d - 3, 5, replace=False).tolist())
        rows.append((Vectors.sparse(d, [*at, d - 3, d - 2, d - 1], [*([0.01] * 5), *(r.normal(size=3) * [9, 6, 4])]),))
    df = spark.createDataFrame(rows, ["features"]).repartition(4)
    comps, ratios, _ = wide_pca(df, "features", d, 0.95)
    tail = np.array([v[0].toArray()[-3:] for v in rows])
    want = np.sort(np.linalg.eigvalsh(np.cov(tail.T)))[::-1]
    assert comps.shape == (d, 3) and np.allclose(ratios / ratios[0], want / want[0], rtol=1e-4)


def test_constant_rows_have_no_component(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 3, ["features"])
    assert wide_pca(df, "features", 2, 0.95)[1].size == 0
    assert wide_pca(df.limit(0), "features", 2, 0.95)[1].size == 0
