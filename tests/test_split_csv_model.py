"""Split with missing labels, CSV quoting, and the folds of the model fit."""

import pytest

from riskframe.operators import model, profile, sampling
from riskframe.plans import context
from riskframe.sources import csv


@pytest.mark.parametrize("shift", range(5))
def test_split_keeps_rows_without_a_label(spark, shift):
    rows = [(i + 1000 * shift, None if i % 10 == 0 else int(i % 7 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int")
    test, train = sampling.split_predicates(df, "y", "k", "0.2", f"s{shift}")
    assert df.where(test).count() + df.where(train).count() == 1000
    got = profile.split_cover(df, test, train).first()
    assert (got.n_rows, got.n_overlap, got.n_uncovered, got.n_test) == (1000, 0, 0, 200)


def _read(spark, tmp_path, text, **options):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return csv.read_csv(spark, str(path), **options)


def test_csv_quotes(spark, tmp_path):
    df = _read(spark, tmp_path, 'a,b\n"a ""b"" c",1\n"say ""hi"", you",2\n"ends in \\",3\n')
    assert [tuple(r) for r in df.orderBy("b").collect()] == [('a "b" c', 1), ('say "hi", you', 2), ("ends in \\", 3)]


def test_csv_line_break_in_quotes(spark, tmp_path):
    df = _read(spark, tmp_path, 'a,b\n"one\ntwo",1\nx,2\n', multi_line=True)
    assert [tuple(r) for r in df.orderBy("b").collect()] == [("one\ntwo", 1), ("x", 2)]


def test_csv_short_row_and_long_integer(spark, tmp_path):
    df = _read(spark, tmp_path, "a,b,c\n1234567890123456789,x,1\n2,y\n")
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "int")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(2, "y", None), (1234567890123456789, "x", 1)]


def test_csv_integer_beyond_64_bits_is_double(spark, tmp_path):
    assert _read(spark, tmp_path, "a\n9999999999999999999\n1\n").dtypes == [("a", "double")]


def test_csv_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q "x", \\'), (2, "plain")], "a int, b string")
    csv.write_csv(df, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, csv.read_csv(spark, str(tmp_path / "out.csv")).collect())) == [(1, 'q "x", \\'), (2, "plain")]


@pytest.mark.parametrize("name", ["none.csv", "none.parquet", "none"])
def test_missing_path_of_every_source(spark, tmp_path, name):
    with pytest.raises(FileNotFoundError):
        context.load_applications(spark, str(tmp_path / name))


def test_fold_regularisation_keeps_c():
    weights = {0: 10.0, 1: 20.0, 2: 30.0}
    assert [1 / (model.fold_reg(weights, f, 2.0) * sum(w for g, w in weights.items() if g != f)) for f in weights] == pytest.approx([2.0] * 3)


def test_fit_keeps_partitions_and_fold_c(spark):
    from conftest import SMALL
    from riskframe.plans.queries import _model
    fitted = _model(spark, SMALL)
    assert fitted.info["solver_partitions"] > 1
    assert all(r > fitted.reg_param for r in fitted.info["fold_regs"])
    # a fit that uses all its iterations is reported
    assert ("final" in fitted.info["not_converged"]) == (fitted.svm_iterations >= 100)
