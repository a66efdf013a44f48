"""One-pass pairwise-complete co-moments against NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest

from riskframe.operators import explore, features
from riskframe.operators.comoments import TaskState, co_moments, merge


def _frame(spark, x, parts=5):
    rows = [tuple(None if v != v else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(x.shape[1]))).repartition(parts)


@pytest.mark.parametrize("block", [64, 3])
def test_pairs_match_pandas_with_missing_values(spark, block):
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 8)) * 10.0 ** np.arange(-3, 5) + 1e3
    x[r.random(x.shape) < 0.3] = np.nan
    x[:, 5] = 4.25  # constant
    x[:, 6] = np.nan  # no value
    x[1:, 7] = np.nan  # one value
    df, cols = _frame(spark, x), [f"c{k}" for k in range(8)]
    got = {(q.i, q.j): q for q in co_moments(df, cols, block).collect()}
    for i in range(8):
        for j in range(i + 1):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if not both.any():
                assert (i, j) not in got
                continue
            a, b, q = x[both, i], x[both, j], got[i, j]
            assert q.n == both.sum()
            assert q.c / q.n == pytest.approx(((a - a.mean()) * (b - b.mean())).mean(), rel=1e-8, abs=1e-9 * a.std() * b.std())
            assert q.m2_a / q.n == pytest.approx(a.var(), rel=1e-9, abs=0) and q.m2_b / q.n == pytest.approx(b.var(), rel=1e-9, abs=0)
    corr = {(q.col_a, q.col_b): q.corr for q in explore.pearson_pairs(df, cols).collect()}
    want = pd.DataFrame(x, columns=cols).corr()
    for (a, b), v in corr.items():
        assert (v is None and np.isnan(want.loc[a, b])) or v == pytest.approx(want.loc[a, b], abs=1e-9)
    assert co_moments(df.limit(0), cols).collect() == []


def test_merge_is_the_state_of_all_rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 4)) + 50
    x[r.random(x.shape) < 0.4] = np.nan
    x[:30, 2] = np.nan  # missing from one side
    states = []
    for part in (x[:30], x[30:31], x[31:], x):
        s = TaskState(4)
        s.add(part)
        states.append(s.state())
    total = merge(merge(states[0], states[1]), states[2])
    for name, v in states[3].items():
        assert np.allclose(total[name], v, rtol=1e-10, atol=1e-9), name


def test_wide_table_multiplies_no_row(spark):
    """200 columns: no generator in the plan, one state a task leaves the scan."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 200))
    df, cols = _frame(spark, x, 3), [f"c{k}" for k in range(200)]
    for plan in (explore.pearson_pairs(df, cols), features.covariance_pairs(df, cols)):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    cov = features.covariance_pairs(df, cols).toPandas()
    assert len(cov) == 200 * 201 // 2
    want = np.cov(x.T, bias=True)
    at = cov.col_a.str[1:].astype(int), cov.col_b.str[1:].astype(int)
    assert np.allclose(cov["cov"], want[at], rtol=1e-9, atol=1e-12)
