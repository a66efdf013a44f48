"""Certificates of the fitted model: conditions that hold only at the optimum,
checked in one pass each over the training rows instead of fitting again.

* Components (FE8, AGG25, AGG26, WIN1, WIN2): with V the fitted components and C
  the covariance of the encoded rows, V'V = I and V'CV diagonal prove that the
  columns of V are all eigenvectors and the diagonal the eigenvalues.
* Linear SVM (ML2, AGG27): every dual-feasible point bounds the optimum from
  below, so the distance of the fitted primal value to the best one found bounds
  what the fit can be off by, converged or not.
* Platt calibration (ML5): at the optimum the calibrated probabilities and
  the targets have the same sum and the same first moment in the margin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.comoments import co_moments

#: Half widths of the smoothed hinge's round part, in the order they are tried.
RAMPS = (0.2, 0.1, 0.05, 0.02)
#: Most passes over the rows in the search for a dual point.
PASSES = 60
#: Largest accepted (primal - dual) / primal of a fitted linear SVM.
GAP_BOUND = 1e-2
#: Largest accepted departure of V'V and V'CV / trace from their exact form.
EIGEN_BOUND = 1e-8
#: Largest accepted |sum of (target - probability) * x| / sum of |x|, x = 1 and the margin.
PLATT_BOUND = 1e-6


def component_certificate(pipeline: PipelineModel, ratios: list[float], k: int, train_raw: DataFrame,
                          variance: float) -> dict:
    """trace, sum of squared ratios, and the largest departures from an eigenbasis.
    One pass; the driver holds d x d numbers like the fit itself."""
    prep, pca = pipeline.stages[0], pipeline.stages[1]
    v = pca.pc.toArray()
    d = v.shape[1]
    projected = pca.transform(prep.transform(train_raw)).select(vector_to_array(pca.getOutputCol()).alias("a"))
    names = [f"c{i}" for i in range(d)]
    moments = co_moments(projected.select(*[F.col("a")[i].alias(n) for i, n in enumerate(names)]), names)
    cov = np.zeros((d, d))
    for r in moments.select("i", "j", (F.col("c") / F.col("n")).alias("v")).collect():  # d (d + 1) / 2 rows
        cov[r.i, r.j] = cov[r.j, r.i] = r.v
    trace = float(np.trace(cov))
    share = np.diag(cov) / (trace or 1.0)
    running = np.cumsum(share)
    needed = int((running <= variance).sum()) + 1
    return {"trace": trace, "squared_ratios": float(np.square(ratios).sum()),
            "orthonormal": float(np.abs(v.T @ v - np.eye(d)).max()),
            "diagonal": float(np.abs(cov / (trace or 1.0) - np.diag(np.asarray(ratios))).max()),
            "k": max(1, min(needed, d)), "fitted_k": k}


def smooth_sums(rows: DataFrame, C: float, theta: np.ndarray, ramp: float) -> np.ndarray:
    """Sums over rows of (label 0/1, weight, x), map-side combined, at the model
    theta = (coefficients, intercept): C times the weighted hinge and the
    smoothed hinge; for each class the multipliers' sum and their weighted sum of
    x; the smoothed hinge's second derivative. (k + 1)(k + 3) + 2 numbers."""
    size, k = 2 + 2 * len(theta) + len(theta) ** 2, len(theta) - 1

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2))
            z = np.column_stack([np.asarray(batch.column(2).flatten()).reshape(-1, k), np.ones(len(label))])
            loss = 1.0 - np.where(label > 0, 1.0, -1.0) * (z @ theta)
            inside = np.abs(loss) < ramp
            share = np.clip((loss + ramp) / (2.0 * ramp), 0.0, 1.0)
            total[0] += C * (weight @ np.maximum(0.0, loss))
            total[1] += C * (weight @ np.where(inside, (loss + ramp) ** 2 / (4.0 * ramp), np.maximum(0.0, loss)))
            multiplier = C * weight * share
            for c in (0, 1):  # the last entry of z is 1: the multipliers' own sum
                total[2 + c * (k + 1):2 + (c + 1) * (k + 1)] += (multiplier * (label == c)) @ z
            near = z[inside]
            total[2 + 2 * (k + 1):] += (near.T @ (near * (C * weight[inside] / (2.0 * ramp))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int64)), pa.array(total)],
                                         names=["slot", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r["slot"]] = r["value"]
    return out


def dual_value(zero: np.ndarray, one: np.ndarray) -> float:
    """Dual value of the multipliers whose sums of (x, 1) by class are given, made
    feasible: the larger class is scaled down to the other's sum, then both by the
    best factor of at most 1. Multipliers of 0 are feasible too, with value 0."""
    mass = min(zero[-1], one[-1])
    if mass <= 0:
        return 0.0
    u = one[:-1] * (mass / one[-1]) - zero[:-1] * (mass / zero[-1])
    square = float(u @ u)
    t = min(1.0, 2.0 * mass / square) if square > 0 else 1.0
    return max(0.0, float(2.0 * t * mass - 0.5 * t * t * square))


def duality_gap(train: DataFrame, coefficients: np.ndarray, intercept: float, C: float) -> dict:
    """Primal value, best dual value and relative gap of a linear SVM with an
    unpenalised intercept, 1/2 |b|^2 + C sum w hinge, over ``train`` (label,
    weight, x).

    The hinge is rounded within a ramp about the margin; its slope then is a
    multiplier between 0 and C w for each row, and at the minimum of the rounded
    problem these multipliers meet the dual's conditions. From the fitted model,
    Newton steps (halved until the value falls) approach that minimum, ramp after
    ramp, until the gap is half of ``GAP_BOUND`` or no step helps. Every point on the
    way is made feasible, so the best dual value is a proven lower bound of the
    optimum, whatever the steps do; the model itself is not changed."""
    k = len(coefficients)
    theta = np.append(np.asarray(coefficients, float), float(intercept))
    primal, best, passes = None, 0.0, 0
    for ramp in RAMPS:
        step, value = None, np.inf
        while passes < PASSES:
            at = theta if step is None else theta - step
            sums = smooth_sums(train, C, at, ramp)
            passes += 1
            ridge = 0.5 * float(at[:k] @ at[:k])
            if primal is None:
                primal = ridge + float(sums[0])
            zero, one = sums[2:2 + k + 1], sums[2 + k + 1:2 + 2 * (k + 1)]
            best = max(best, dual_value(zero, one))
            if primal - best <= 0.5 * GAP_BOUND * primal:
                break
            now = ridge + float(sums[1])
            if now >= value:  # too far
                step = step / 2.0
                if np.abs(step).max() <= 1e-9 * (1.0 + np.abs(theta).max()):
                    break
                continue
            done = np.isfinite(value) and value - now <= 1e-9 * abs(value)
            theta, value = at, now
            if done:
                break
            slope = np.append(theta[:k], 0.0) + zero - one
            bend = sums[2 + 2 * (k + 1):].reshape(k + 1, k + 1) + np.diag(np.append(np.ones(k), 1e-9))
            step = np.linalg.solve(bend, slope)
        if primal is None or primal - best <= 0.5 * GAP_BOUND * primal:
            break
    return {"primal": primal, "dual": best, "gap": (primal - best) / primal if primal else 0.0, "passes": passes}


def platt_sums(margins: DataFrame, a: float, b: float) -> dict:
    """Sums over calibration rows (m, t) of targets, probabilities and first moments."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("m") + F.lit(b))))
    return margins.agg(F.count(F.lit(1)).alias("rows"), F.sum("t").alias("target_sum"), F.sum(p).alias("probability_sum"),
                       F.sum((F.col("t") - p) * F.col("m")).alias("moment"), F.sum(F.abs("m")).alias("size")).first().asDict()
