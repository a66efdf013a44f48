"""Hand-made micro tables: nulls, ties, constants, unseen categories,
sentinels, histogram edges, AUC ties, empty classes, CSV tokens."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions.columns import clip
from riskframe.operators import evaluate, explore, features, profile, quantiles
from riskframe.sources import applicants, csv


def test_even_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    q = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])[("x",)]
    assert q == {0.25: 1.75, 0.5: 2.5, 0.75: 4.75}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-3.0,)], "x double")
    out = df.select(clip(F.col("x"), F.lit(0.0), F.lit(4.0)).alias("c")).collect()
    assert [r.c for r in out] == [4.0, None, 0.0]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "k string")
    df = df.withColumn("SK_ID_CURR", F.monotonically_increasing_id()).withColumn("TARGET", F.lit(0))
    st = features.fit_state(df)
    assert st["modes"]["k"] == "a"
    assert st["categories"]["k"] == ["a", "b"]


def test_unseen_category_all_zeros(spark):
    train = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, "c")], "SK_ID_CURR long, TARGET int, k string")
    st = features.fit_state(train)
    test = spark.createDataFrame([(9, "zz")], "SK_ID_CURR long, k string")
    vec = features.prepared_features(test, st).first().features
    assert list(vec) == [0.0, 0.0, 0.0]


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, k double")
    r = explore.pearson_pairs(df, ["a", "k"]).first()
    assert r.corr is None
    tr = df.withColumn("SK_ID_CURR", F.monotonically_increasing_id()).withColumn("TARGET", F.lit(0))
    st = features.fit_state(tr)
    vals = features.scale(features.impute(features.clip_fitted(tr.select("k"), st), st), st).collect()
    assert all(v.k == 0.0 for v in vals)


def test_pair_nulls_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0), (5.0, None), (6.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = explore.pearson_pairs(df, ["a", "b"]).first()
    xs = [(a, b) for a, b in rows if b is not None]
    n = len(xs)
    ma = sum(a for a, _ in xs) / n
    mb = sum(b for _, b in xs) / n
    cov = sum((a - ma) * (b - mb) for a, b in xs)
    va = sum((a - ma) ** 2 for a, _ in xs)
    vb = sum((b - mb) ** 2 for _, b in xs)
    assert r.n == 4
    assert r.corr == pytest.approx(cov / math.sqrt(va * vb), abs=1e-12)


def test_null_group_dropped(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), ("x", 0), ("y", 0)], "k string, y int")
    rows = {r.k: r for r in explore.rate_by_category(df, "k", "y").collect()}
    assert set(rows) == {"x", "y"}
    assert rows["x"].default_rate_pct == 50.0


def test_sentinel_null_counts_normal(spark):
    df = spark.createDataFrame([(365243,), (-10,), (None,)], "d int")
    r = explore.sentinel_counts(df, "d", 365243).first()
    assert (r.n_sentinel, r.n_normal, r.n_rows) == (1, 2, 3)


def test_hist_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 2.5), (0, 10.0)], "g int, x double")
    h = explore.equal_width_histogram(df, F.col("x"), "g", 4).collect()
    assert [r.n for r in h] == [2, 1, 0, 1]  # 10.0 (the max) is in the last bin; bin 2 empty
    assert h[0].bin_lo == 0.0 and h[-1].bin_hi == 10.0


def test_score_ties_and_negative_zero(spark):
    rows = [(0.0, 1), (-0.0, 0), (1.0, 1), (1.0, 0), (-1.0, 0), (2.0, 1)]
    df = spark.createDataFrame(rows, "score double, y int")
    auc = evaluate.roc_auc(df, "y", "score").first().auc
    # brute force over all (pos, neg) pairs, ties count one half
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)


def test_auc_invariant_under_monotone_transform(spark):
    rows = [(float(i % 17) / 3, int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, y int")
    a1 = evaluate.roc_auc(df, "y", "score").first().auc
    a2 = evaluate.roc_auc(df.withColumn("score", F.exp("score") * 3 - 1), "y", "score").first().auc
    assert 0.0 <= a1 <= 1.0 and a1 == pytest.approx(a2)


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, pred int")
    r = evaluate.binary_metrics(df, "y", "pred").first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0
    assert r.accuracy == pytest.approx(1 / 3)


def test_one_class_missing_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, pred int")
    cm = evaluate.confusion_matrix(df, "y", "pred").collect()
    assert [(r.actual, r.predicted, r.n) for r in cm] == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    rep = {r.class_name: r for r in evaluate.classification_report(df, "y", "pred").collect()}
    assert set(rep) == {"No Default", "Default", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].support == 0.6667  # 4 decimals


def test_partial_applicant_alignment(spark):
    template = spark.createDataFrame([], "SK_ID_CURR long, A double, B string, DAYS_EMPLOYED int")
    forms = spark.createDataFrame([(1, 2.5, 3, "zzz")], "SK_ID_CURR long, A double, YEARS_EMPLOYED int, UNKNOWN string")
    out = applicants.align_to_schema(applicants.form_to_columns(forms), template, keep=["SK_ID_CURR"])
    assert out.columns == ["SK_ID_CURR", "A", "B", "DAYS_EMPLOYED"]
    r = out.first()
    assert (r.A, r.B, r.DAYS_EMPLOYED) == (2.5, None, -1095)


def test_missing_weekday(spark):
    days = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]
    df = spark.createDataFrame([(d, i % 2) for i, d in enumerate(days * 3)], "w string, y int")
    out = explore.rate_in_fixed_order(df, "w", "y", days + ["SUNDAY"]).collect()
    assert len(out) == 7 and out[-1].w == "SUNDAY" and out[-1].default_rate_pct is None


def test_csv_tokens(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,amount,gender\n1,NA,XNA\n2,,M\n3,4.5,F\n")
    df = csv.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "int", "amount": "double", "gender": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0].amount is None and rows[1].amount is None and rows[0].gender == "XNA"
    miss = {r.column_name: r.missing_count for r in profile.missing_counts(df).collect()}
    assert miss == {"id": 0, "amount": 2, "gender": 0}


def test_missing_path_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.read_csv(spark, str(tmp_path / "does-not-exist.csv"))


def test_sig_same_bits_in_spark_python_duckdb(spark):
    import random

    import duckdb

    from riskframe.functions.columns import sig, sig_value
    from riskframe.plans.oracle import sig_sql

    rng = random.Random(3)
    vals = [534350.77875, -0.6826495, 0.0, -0.0, 1e-30, 123456789012.5, 2.5e-8, 7.0, -117961.57125]
    vals += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", sig("x", 9).alias("s")).collect()}
    con = duckdb.connect()
    duck = dict(con.execute(f"SELECT i, {sig_sql('x', 9)} FROM (SELECT unnest(range(?)) AS i, unnest(?::DOUBLE[]) AS x)",
                            [len(vals), vals]).fetchall())
    for i, v in enumerate(vals):
        assert got[i] == sig_value(v, 9) == duck[i], (v, got[i], sig_value(v, 9), duck[i])


def test_unpivot_stack(spark):
    from riskframe.functions.columns import unpivot

    df = spark.createDataFrame([(1, 2.0, None), (2, None, 5)], "k int, a double, b int")
    out = unpivot(df, ["k"], [("a", F.col("a")), ("b", F.col("b").cast("double"))], ["name", "v"])
    assert out.columns == ["k", "name", "v"]
    got = sorted((r.k, r.name, r.v) for r in out.collect())
    assert got == [(1, "a", 2.0), (1, "b", None), (2, "a", None), (2, "b", 5.0)]


def test_checkpoint_dir_required_on_cluster():
    """Outside local mode an unset spark.checkpoint.dir is an error, never a
    machine-local scratch folder."""
    from riskframe.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, path):  # pragma: no cover - must not be reached
            raise AssertionError("must not set a local folder")

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_hot_key_split_join_matches_plain_join(spark):
    from riskframe.sources.applications import join_splitting_hot_keys

    left = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 50) for i in range(3000)], "id long, k long")
    # the right side repeats key 7 beyond the broadcast bound: the check
    # falls back to a shuffle join and the rows stay the same
    right = spark.createDataFrame([(k, f"r{k}") for k in range(50)] + [(7, f"x{j}") for j in range(2000)],
                                  "rk long, v string")
    split = join_splitting_hot_keys(left, right, "k", "rk", [7])
    plain = left.join(right, F.col("k") == F.col("rk"))
    assert split.count() == plain.count()
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_fixed_order_ignores_unlisted_categories(spark):
    df = spark.createDataFrame([("MONDAY", 1), ("MONDAY", 0), ("HOLIDAY", 1), (None, 1)], "d string, y int")
    out = explore.rate_in_fixed_order(df, "d", "y", ["MONDAY", "TUESDAY"]).collect()
    assert [(r.ord, r.d, r.default_rate_pct, r.n) for r in out] == [(1, "MONDAY", 50.0, 2), (2, "TUESDAY", None, 0)]
