"""Property tests against brute force (hypothesis, few examples: each runs
Spark jobs)."""

from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskframe.operators import evaluate, quantiles, sampling

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@given(counts=st.dictionaries(st.integers(0, 5), st.integers(1, 10_000), min_size=1, max_size=5),
       frac=st.sampled_from(["0.2", "0.05", "0.5", "0.01", "0.999"]))
@settings(max_examples=200, deadline=None)
def test_largest_remainder_properties(counts, frac):
    n = sum(counts.values())
    f = Fraction(frac)
    total = -((-n * f.numerator) // f.denominator)
    q = sampling.largest_remainder(counts, total)
    assert sum(q.values()) == total
    for c, k in counts.items():
        exact = Fraction(k * total, n)
        assert exact - 1 < q[c] <= exact + 1 and 0 <= q[c] <= k


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from([-1.0, -0.0, 0.0, 0.5, 1.0, 2.0, 3.5]),
                               st.integers(0, 1)), min_size=2, max_size=40))
def test_auc_matches_pairwise_brute_force(spark, rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    df = spark.createDataFrame(rows, "score double, y int")
    got = evaluate.roc_auc(df, "y", "score").first().auc
    if not pos or not neg:
        assert got is None
        return
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-12


@SETTINGS
@given(xs=st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60),
       p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]))
def test_order_statistics_exact(spark, xs, p):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    lo, hi, _ = quantiles.quantile_ranks(len(xs), p)
    _, stats = quantiles.order_statistics(df, ["x"], [p])
    ordered = sorted(float(x) for x in xs)
    assert stats[(0,)][lo] == ordered[lo] and stats[(0,)][hi] == ordered[hi]
