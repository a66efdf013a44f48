"""Certificates: the gap bounds a brute-force optimum, broken fits are told."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.classification import LinearSVC

from conftest import SMALL
from riskframe import schema as S
from riskframe.operators import certify
from riskframe.plans import queries as Q
from riskframe.plans.context import prepared


def brute_optimum(x, y, w, C):
    """Subgradient descent on 1/2 |b|^2 + C sum w hinge: the best value seen."""
    b, c, best = np.zeros(x.shape[1]), 0.0, np.inf
    for step in range(1, 60_001):
        out = 1 - y * (x @ b + c)
        best = min(best, 0.5 * b @ b + C * w @ np.maximum(0, out))
        hit = np.where(out > 0, C * w * y, 0.0)
        rate = 0.5 / step ** 0.75
        b, c = b - rate * (b - hit @ x), c + rate * hit.sum()
    return best


def test_gap_bounds_the_optimum(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3))
    y = np.where(x @ [1.0, -0.5, 0.2] + r.normal(size=300) > 0.8, 1.0, -1.0)
    w = np.where(y > 0, 300 / (2 * (y > 0).sum()), 300 / (2 * (y < 0).sum()))
    df = spark.createDataFrame([(float(a > 0), float(b), list(map(float, c))) for a, b, c in zip(y, w, x)],
                               "label double, weight double, x array<double>").repartition(3)
    C = 0.05

    def gap_of(beta, shift):
        return certify.duality_gap(df.select("label", "weight", "x"), np.asarray(beta, float), shift, C)

    fit = LinearSVC(featuresCol="v", labelCol="label", weightCol="weight", regParam=1 / (C * 300), standardization=False,
                    maxIter=200, tol=1e-8).fit(df.withColumn("v", array_to_vector("x")))
    best = brute_optimum(x, y, w, C)
    good = gap_of(fit.coefficients.toArray(), fit.intercept)
    assert good["dual"] <= best * (1 + 1e-9) and good["primal"] >= good["dual"]
    assert good["primal"] == pytest.approx(best, rel=1e-3) and good["gap"] <= certify.GAP_BOUND
    for beta, shift in ((-fit.coefficients.toArray(), fit.intercept), (np.zeros(3), 3.0), (fit.coefficients.toArray(), 5.0)):
        bad = gap_of(beta, shift)
        assert bad["dual"] <= best * (1 + 1e-9) and bad["gap"] > certify.GAP_BOUND
    one = df.where("label = 1").select("label", "weight", "x")  # one class: only 0 is feasible
    assert certify.duality_gap(one, np.zeros(3), 2.0, C)["gap"] == 0.0
    assert certify.duality_gap(one, np.zeros(3), 0.0, C)["dual"] == 0.0
    assert certify.duality_gap(one.limit(0), np.ones(3), 0.0, C)["dual"] == 0.0


def test_platt_sums_tell_a_wrong_calibration(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=2000)
    t = 1 / (1 + np.exp(-(1.5 * m - 0.5)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, t)], "m double, t double")
    right, wrong = certify.platt_sums(df, 1.5, -0.5), certify.platt_sums(df, 1.4, -0.5)
    assert abs(right["moment"]) < 1e-9 and abs(right["probability_sum"] - right["target_sum"]) < 1e-9
    assert abs(wrong["moment"]) > certify.PLATT_BOUND * wrong["size"]


def test_component_certificate_tells_wrong_ratios(spark):
    m, train = Q._model(spark, SMALL), prepared(spark, SMALL).train
    good = certify.component_certificate(m.pipeline, m.explained, m.k, train, S.PCA_VARIANCE)
    assert good["orthonormal"] < 1e-10 and good["diagonal"] < 1e-10 and good["k"] == m.k
    swapped = [m.explained[1], m.explained[0], *m.explained[2:]]
    assert certify.component_certificate(m.pipeline, swapped, m.k, train, S.PCA_VARIANCE)["diagonal"] > certify.EIGEN_BOUND
