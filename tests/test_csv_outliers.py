"""CSV records that span lines, surplus fields, booleans; box-plot outlier rows."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from conftest import SMALL
from riskframe.operators import explore, profile
from riskframe.plans import queries as Q
from riskframe.sources.csv import read_csv


def _file(tmp_path, text):
    p = tmp_path / "t.csv"
    p.write_text(text)
    return str(p)


def test_quoted_line_breaks_without_an_option(spark, tmp_path):
    path = _file(tmp_path, 'a,b\n"one\ntwo",1\n"say ""hi"", you",2\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("one\ntwo", 1), ('say "hi", you', 2)]
    assert list(pd.read_csv(path).itertuples(index=False, name=None)) == [("one\ntwo", 1), ('say "hi", you', 2)]


@pytest.mark.parametrize("text", ['a,b\n1,2,3\n4,5\n', 'a,b\n"x\ny",2\n4,5,6\n'])
def test_surplus_fields_raise(spark, tmp_path, text):
    with pytest.raises(ValueError, match="expected 2 fields"):
        read_csv(spark, _file(tmp_path, text))


def test_short_rows_and_commas_in_quotes_are_no_surplus(spark, tmp_path):
    path = _file(tmp_path, 'a,b\n"x,y",2\nz\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("x,y", 2), ("z", None)]


def test_booleans_are_neither_numeric_nor_categorical(spark, tmp_path):
    df = read_csv(spark, _file(tmp_path, "a,b,c\nTrue,true,1\nFALSE,,2\n"))
    assert [f.dataType for f in df.schema] == [T.BooleanType(), T.StringType(), T.IntegerType()]
    assert [(c, k) for _, c, _, k in profile.column_kinds(df)] == [("a", "other"), ("b", "categorical"), ("c", "numeric")]


def test_outlier_rows_are_the_counted_ones(spark):
    box = {r.TARGET: r.n_outliers for r in Q.income_boxplot(spark, SMALL).collect()}
    rows = Q.income_outliers(spark, SMALL)
    got = {r.TARGET: r["count"] for r in rows.groupBy("TARGET").count().collect()}
    assert got == {k: v for k, v in box.items() if v}
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(AMT_INCOME_TOTAL" in pushed and "EqualTo(TARGET" in pushed


def test_outliers_of_many_groups(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(x)) for g in range(5) for x in [1, 2, 3, 4, 100 + g]], "g int, x double")
    want = sorted((g, 100.0 + g, "above") for g in range(5))
    assert sorted(map(tuple, explore.box_outliers(df, "x", "g").collect())) == want
    monkeypatch.setattr(explore, "MAX_PREDICATES", 2)
    assert sorted(map(tuple, explore.box_outliers(df, "x", "g").collect())) == want


def test_feature_counts_tell_columns_without_values(spark):
    from riskframe.operators import profile

    df = spark.createDataFrame([(1, None, float("nan"), "a", None), (2, 3, float("nan"), None, None)],
                               "SK_ID_CURR long, a int, b double, c string, d string")
    assert [tuple(r) for r in profile.feature_type_counts(df).collect()] == [("categorical", 2, 1), ("numeric", 2, 1)]
    assert [tuple(r) for r in profile.feature_type_counts(df.limit(0)).collect()] == [("categorical", 2, 0), ("numeric", 2, 0)]
    assert profile.feature_type_counts(df.select("SK_ID_CURR")).collect() == []
