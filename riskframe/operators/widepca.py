"""Principal components of wide sparse features without a d x d matrix (FE8).

Subspace iteration from a random range: with a d x l basis Q, one pass over the
rows computes C Q for the covariance C as a sum of row products. Each task
multiplies its rows with Q, takes the mean out of the products (the rows stay
sparse), multiplies back and gives one partial d x l matrix, in blocks of
columns; blocks are summed on the executors. The driver orthonormalises d x l
numbers. The basis grows until its settled leading components pass the variance
target, so no width beyond the kept components is ever held.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # columns of a partial sum that travel together
SLICE_ROWS = 2000
OVERSAMPLE = 8
MAX_PASSES = 60
#: Driver and broadcast bound: columns x basis.
MAX_BASIS_BYTES = 1 << 30


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the nonzero entries of unwrapped vectors."""
    rows, cols, vals = [], [], []
    for r, v in enumerate(batch.column(0).to_pylist()):
        if v is not None:
            values = np.asarray(v["values"], float)
            at = np.arange(len(values)) if v["type"] == 1 else np.asarray(v["indices"], np.int64)
            rows.append(np.full(len(values), r))
            cols.append(at)
            vals.append(values)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def _summed(vectors: DataFrame, d: int, width: int, partial) -> np.ndarray:
    """The sum over all tasks of ``partial``'s (d + 1) x width matrices: of the
    tasks' blocks on the executors, then d x width numbers to the driver."""
    schema = "block int, cells binary"

    def run(batches):
        total = np.zeros((d + 1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                partial(total, piece.num_rows, *_entries(piece))
        for at in range(0, d + 1, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([total[at:at + BLOCK].tobytes()], pa.binary())],
                                             names=["block", "cells"])

    def add(batches):
        rows = ((b.column(0)[k].as_py(), b.column(1)[k].as_py()) for b in batches for k in range(b.num_rows))
        for block, group in groupby(rows, key=lambda r: r[0]):
            total = 0.0
            for _, cells in group:
                total = total + np.frombuffer(cells)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])

    sums = vectors.mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    out = np.zeros((d + 1, width))
    for r in sums.collect():
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.cells).reshape(-1, width)
    return out


def column_moments(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, float]:
    """Rows, column means and the total variance (the covariance's trace, n - 1)."""
    def partial(total, n, rows, cols, vals):
        total[:d, 0] += np.bincount(cols, vals, d)
        total[:d, 1] += np.bincount(cols, vals * vals, d)
        total[d, 0] += n
    sums = _summed(vectors, d, 2, partial)
    n = int(sums[d, 0])
    if n < 2:
        return n, np.zeros(d), 0.0
    mean = sums[:d, 0] / n
    return n, mean, float((sums[:d, 1] - n * mean * mean).sum() / (n - 1))


def _times_covariance(vectors: DataFrame, basis: np.ndarray, n: int, mean: np.ndarray) -> np.ndarray:
    d, l = basis.shape
    shared = vectors.sparkSession.sparkContext.broadcast((basis, mean @ basis))  # bounded by MAX_BASIS_BYTES

    def partial(total, m, rows, cols, vals):
        q, centre = shared.value
        y = np.zeros((m, l))
        np.add.at(y, rows, vals[:, None] * q[cols])
        y -= centre
        np.add.at(total, cols, vals[:, None] * y[rows])
        total[d] += y.sum(axis=0)

    sums = _summed(vectors, d, l, partial)
    shared.unpersist()
    return (sums[:d] - np.outer(mean, sums[d])) / (n - 1)


def wide_pca(df: DataFrame, features: str, d: int, target: float, first: int = 16, tol: float = 1e-9,
             seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components d x k, explained ratios of k, column means): the smallest k
    whose ratios sum to more than ``target``, or all of the rank."""
    vectors = df.select(F.unwrap_udt(features).alias("v"))
    n, mean, total = column_moments(vectors, d)
    if total <= 0:
        return np.zeros((d, 0)), np.zeros(0), mean
    random = np.random.default_rng(seed)
    l = min(d, first + OVERSAMPLE)
    basis = np.linalg.qr(random.normal(size=(d, l)))[0]
    before = None
    for _ in range(MAX_PASSES):
        if basis.nbytes > MAX_BASIS_BYTES:
            raise ValueError(f"{basis.shape[1]} components of {d} columns do not fit: lower the variance target")
        image = _times_covariance(vectors, basis, n, mean)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-values)
        values, turn = np.maximum(values[order], 0), turn[:, order]
        ratios = values / total
        sure = l if l == d else l - OVERSAMPLE
        k = int((np.cumsum(ratios) <= target).sum()) + 1
        settled = before is not None and len(before) == l and np.abs(ratios[:min(k, sure)] - before[:min(k, sure)]).max() < tol
        if settled and (k <= sure or ratios[sure - 1] < tol or l == d):
            k = min(k, sure)
            return basis @ turn[:, :k], ratios[:k], mean
        before, basis = ratios, image @ turn
        if settled:  # the target lies beyond this basis
            l = min(d, 2 * l)
            basis = np.concatenate([basis, random.normal(size=(d, l - basis.shape[1]))], axis=1)
        basis = np.linalg.qr(basis)[0]
    raise RuntimeError("subspace iteration did not settle")
