"""The model fit encodes each training row once, and its concurrent fits fit in memory."""

import json
from types import SimpleNamespace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.operators import features, model


def _rows(spark, n=400):
    rows = [(i, int(i % 5 == 0), None if i % 11 == 0 else float((i * 37) % 101) + 60.0 * (i % 5 == 0),
             None if i % 13 == 0 else f"c{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, f"{S.KEY} long, {S.LABEL} int, AMT_CREDIT double, NAME_HOUSING_TYPE string").repartition(3)


def test_packed_encoding_equals_the_sparse_one(spark):
    df = _rows(spark)
    st = features.fit_state(df)
    extra = spark.createDataFrame([(-1, 0, None, "unseen"), (-2, 1, float("nan"), None)], df.schema)
    for rows in (df.unionByName(extra), df.unionByName(extra).drop("AMT_CREDIT"), df.unionByName(extra).withColumn("features", F.lit(1))):
        one, other = (features.prepared_features(rows, st, packed=p) for p in (True, False))
        assert one.columns == other.columns
        both = [{r[S.KEY]: r.features.toArray().tolist() for r in x.collect()} for x in (one, other)]
        assert len(both[0]) == 402 and repr(both[0]) == repr(both[1])


def test_fit_encodes_a_row_once(spark, monkeypatch):
    """One count for each row that passes the encoder, over the whole fit."""
    seen = spark.sparkContext.accumulator(0)
    df = _rows(spark)
    st = features.fit_state(df)
    plain = model.prepared_features

    def counting(rows, *args, **kwargs):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return plain(rows.mapInArrow(count, rows.schema), *args, **kwargs)

    monkeypatch.setattr(model, "prepared_features", counting)
    m = model.fit_pipeline(df, state=st)
    # two more looks at a first row tell the width and the kind of vector
    assert 400 <= seen.value < 800
    monkeypatch.undo()
    # the solver's model is still one of all training rows
    points = model.training_points(m, df).collect()
    assert len(points) == 400 and sum(m.class_counts.values()) == 400
    margin = np.array([r.x for r in points]) @ m.pipeline.stages[3].coefficients.toArray() + m.pipeline.stages[3].intercept
    assert np.mean((margin > 0) == np.array([r.label for r in points])) > 0.5
    assert json.loads(json.dumps(m.info["fits_at_once"])) == 6


def _session(*executors):
    class Status:
        def values(self):
            return self

        def toList(self):
            return self

        def size(self):
            return len(executors)

        def apply(self, i):
            return SimpleNamespace(_1=lambda: executors[i])

    scala = SimpleNamespace(getExecutorMemoryStatus=Status)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: scala))
    return SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context))


def test_fits_at_once_share_the_memory():
    cluster = _session(600, 600, 600, 600)  # three executors and the driver
    assert [model.fits_at_once(cluster, b, 6) for b in (1, 150, 300, 900, 10 ** 9, 0)] == [6, 6, 3, 1, 1, 6]
    assert model.fits_at_once(_session(600), 100, 6) == 3
