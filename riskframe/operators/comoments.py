"""Pairwise-complete co-moments of many columns in one pass (AGG18, FE9).

Each task keeps one mergeable matrix state for its rows: for every pair of
columns the number of rows with both values, both means over those rows and
the three centred sums of products. The products of a batch are matrix
products of its values and its presence mask, so a row is never multiplied
into its pairs. The state leaves the task once, cut into blocks of columns;
partial states of a block are merged in task order, one at a time, with the
pairwise update of means and centred sums, so a task holds two of them at most.

Sums are taken about the task's first medians: values near their column's
centre keep their digits, and a constant column is exactly constant.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Centred sums this small beside the raw ones are rounding.
NOISE = 1e-13

_STATE = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c")


class TaskState:
    """Sums of one task's rows about a fixed origin; columns x columns each."""

    def __init__(self, d: int):
        self.origin = np.zeros(d)
        self.known = np.zeros(d, bool)  # columns whose origin is set
        self.n, self.s, self.q, self.p = (np.zeros((d, d)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Rows with NaN for missing."""
        new = ~self.known & ~np.isnan(x).all(axis=0)
        if new.any():
            self.origin[new] = np.nanmedian(x[:, new], axis=0)
            self.known |= new
        there = ~np.isnan(x)
        y, m = np.where(there, x - self.origin, 0.0), there.astype(float)
        self.n += m.T @ m
        self.s += y.T @ m  # sum of a over the rows that have b
        self.q += (y * y).T @ m
        self.p += y.T @ y

    def state(self) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            some = self.n > 0
            mean = np.where(some, self.s / self.n, 0.0)
            m2 = np.where(some, self.q - self.s * mean, 0.0)
            m2 = np.where(m2 <= NOISE * self.q, 0.0, m2)
            c = np.where(some, self.p - mean * self.s.T, 0.0)
        mean = mean + self.origin[:, None]
        return {"n": self.n, "mean_a": mean, "mean_b": mean.T, "m2_a": m2, "m2_b": m2.T, "c": c}


def merge(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The state of both sets of rows together."""
    n = x["n"] + y["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, y["n"] / n, 0.0)
    da, db = y["mean_a"] - x["mean_a"], y["mean_b"] - x["mean_b"]
    # a side without rows has no mean to differ from
    both = (x["n"] > 0) & (y["n"] > 0)
    da, db = np.where(both, da, 0.0), np.where(both, db, 0.0)
    w = x["n"] * share
    out = {"n": n}
    for name, d in (("mean_a", da), ("mean_b", db)):
        out[name] = np.where(x["n"] > 0, x[name] + d * share, y[name])
    for name, d in (("m2_a", da * da), ("m2_b", db * db), ("c", da * db)):
        out[name] = x[name] + y[name] + d * w
    return out


def co_moments(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(i, j, n, mean_a, mean_b, m2_a, m2_b, c) for every pair of column numbers
    i >= j with at least one row that has both: row count, means, and centred sums
    of squares and products over those rows. NULL and NaN are missing."""
    d = len(columns)
    parts = "bi int, bj int, task int, " + ", ".join(f"{s} binary" for s in _STATE)
    pairs = "i int, j int, n long, " + ", ".join(f"{s} double" for s in _STATE[1:])

    def accumulate(batches):
        state = TaskState(d)
        for batch in batches:
            if batch.num_rows:
                state.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
        if not state.known.any():
            return
        found, task = state.state(), TaskContext.get().partitionId()
        for i in range(0, d, block):
            for j in range(0, i + 1, block):
                cells = [np.ascontiguousarray(found[s][i:i + block, j:j + block]).tobytes() for s in _STATE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int32()) for v in (i // block, j // block, task)] + [pa.array([c], pa.binary()) for c in cells],
                    names=["bi", "bj", "task", *_STATE])

    def combine(batches):
        rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for (bi, bj), group in groupby(rows, key=lambda r: (r["bi"], r["bj"])):
            width = min(block, d - bj * block)
            total = None
            for r in group:
                one = {s: np.frombuffer(r[s]).reshape(-1, width) for s in _STATE}
                total = one if total is None else merge(total, one)
            i, j = np.nonzero(total["n"])
            keep = i + bi * block >= j + bj * block
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i + bi * block, pa.int32()), pa.array(j + bj * block, pa.int32()), pa.array(total["n"][i, j].astype(np.int64))]
                + [pa.array(total[s][i, j]) for s in _STATE[1:]], names=["i", "j", *_STATE])

    values = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    states = values.mapInArrow(accumulate, parts)
    return states.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "task").mapInArrow(combine, pairs)


def named_pairs(moments: DataFrame, columns: list[str]) -> DataFrame:
    """``co_moments`` with the columns' names as col_a, col_b."""
    names = F.array(*[F.lit(c) for c in columns])
    return moments.withColumns({"col_a": F.element_at(names, F.col("i") + 1), "col_b": F.element_at(names, F.col("j") + 1)})
