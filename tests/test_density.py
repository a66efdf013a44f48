"""Kernel densities from binned moments against every row, within the stated bound."""

import math

import numpy as np
import pytest

from riskframe.operators import explore


def _row_level(x, grid, h):
    z = (grid[:, None] - x[None, :]) / h
    return np.exp(-0.5 * z * z).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))


SHAPES = {
    "normal": lambda r: r.normal(3.0, 2.0, 3000),
    "ties": lambda r: r.integers(0, 7, 3000) / 7.0,
    "skewed": lambda r: r.exponential(1e6, 3000),
    "two far groups": lambda r: np.concatenate([r.normal(-1e3, 1, 2000), r.normal(1e3, 1, 1000)]),
    "a third in one value": lambda r: np.concatenate([np.full(1000, 0.25), r.uniform(0, 1, 2000)]),
    "two rows": lambda r: np.array([1.0, 2.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_density_equals_row_level(spark, shape):
    x = SHAPES[shape](np.random.default_rng(5))
    df = spark.createDataFrame([(float(v), 1) for v in x] + [(None, 1), (1.0, None)], "v double, g int")
    for bins in (64, 4):
        out = explore.kde_density(df, ["v"], "g", 100, 2.0, bins_per_bandwidth=bins).orderBy("grid_index").collect()
        h = float(f"{x.std(ddof=1) * len(x) ** -0.2:.8e}")
        grid = np.array([r.x for r in out])
        bound = 36 * bins ** -7.0 / math.factorial(7) / (h * math.sqrt(2 * math.pi))
        error = np.abs(np.array([r.density for r in out]) - _row_level(x, grid, h)).max()
        # what the bound leaves out is the rounding of the sums, and of h to 9 digits
        peak = 1 / (h * math.sqrt(2 * math.pi))
        assert error <= bound + 1e-12 * peak, (bins, error / peak)


def test_density_of_too_few_values_is_empty(spark):
    for rows in ([], [(1.0, 1)], [(1.0, 1), (1.0, 1)], [(None, 1), (None, 1)]):
        df = spark.createDataFrame(rows, "v double, g int")
        assert explore.kde_density(df, ["v"], "g").count() == 0
