"""Data profile of a table: counts, event rate, imbalance, column kinds,
missing values, preview (AGG1, AGG2, AGG4-7, FLT5, SRT1, SRT2, PRJ3).

Every measure over all columns is one aggregate job (one pass), unpivoted
afterwards on its single result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema as S
from riskframe.functions.columns import rate, round_even


def dataset_summary(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns, event rate (percent) and the class imbalance ratio
    ``floor(n0 / n1)`` looked up by label value (AGG1, AGG2, AGG4)."""
    y = F.col(label)
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.avg(y.cast("double")).alias("rate"),
                 F.sum(F.when(y == 0, 1).otherwise(0)).alias("n0"),
                 F.sum(F.when(y == 1, 1).otherwise(0)).alias("n1"))
    return agg.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        (F.col("rate") * 100).alias("default_rate_pct"),
        F.floor(rate(F.col("n0"), F.col("n1"))).cast("bigint").alias("imbalance_ratio"))


def column_kinds(df: DataFrame, exclude=(S.KEY, S.LABEL)) -> list[tuple[int, str, str, str]]:
    """(position, column, type, kind) of the feature columns, from the schema (PRJ3)."""
    out = []
    for i, f in enumerate(df.schema.fields):
        if f.name in exclude:
            continue
        if isinstance(f.dataType, S.NUMERIC_TYPES):
            kind = "numeric"
        elif isinstance(f.dataType, T.StringType):
            kind = "categorical"
        else:
            kind = "other"
        out.append((i, f.name, f.dataType.simpleString(), kind))
    return out


def feature_type_counts(df: DataFrame, exclude=(S.KEY, S.LABEL)) -> DataFrame:
    """Numeric and categorical feature columns, and how many of them hold any
    value, by one pass over the rows (AGG5). An empty table has columns without
    values; a table without feature columns gives an empty result."""
    kinds = column_kinds(df, exclude)
    if not kinds:
        return df.sparkSession.createDataFrame([], "kind string, n_features bigint, n_with_values bigint")
    valued = df.agg(*[F.coalesce(F.max((~_is_missing(c, df.schema[c].dataType)).cast("int")), F.lit(0)).alias(f"v{i}")
                      for i, c, _, _ in kinds])
    rows = valued.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"v{i}").alias("valued"))
                                            for i, _, _, k in kinds])))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_features"),
                                    F.sum("valued").alias("n_with_values")).orderBy("kind")


def _is_missing(c: str, dtype) -> F.Column:
    x = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_pct) for every column, from one
    aggregate pass; NaN counts as missing like pandas ``isnull`` (AGG6)."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.when(_is_missing(f.name, f.dataType), 1).otherwise(0)).alias(f"m{i}")
                   for i, f in enumerate(fields)])
    long = agg.select("_n", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, f in enumerate(fields)])).alias("c")).select("_n", "c.*")
    return long.select(
        "column_name",
        F.coalesce("missing_count", F.lit(0)).cast("bigint").alias("missing_count"),
        round_even(rate(F.col("missing_count"), F.col("_n")) * 100, 2).alias("missing_pct"))


def missing_profile(df: DataFrame, top: int = 20) -> DataFrame:
    """Columns with missing values, by share descending (ties by name), top
    ``top`` (AGG7, FLT5, SRT2)."""
    return (missing_counts(df).where(F.col("missing_count") > 0)
            .orderBy(F.desc("missing_pct"), F.desc("missing_count"), "column_name").limit(top))


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows in key order (SRT1): a top-k, not a full sort."""
    return df.orderBy(key).limit(n)


def split_cover(rows: DataFrame, test: Column, train: Column) -> DataFrame:
    """Invariant of a split (JOIN6): the two row predicates that every query
    uses are disjoint and cover all rows. One row of counts from one scan; a
    predicate that is NULL for a row selects nothing, as in a filter."""
    chosen = rows.select(F.coalesce(test, F.lit(False)).alias("test"), F.coalesce(train, F.lit(False)).alias("train"))

    def n(condition):
        return F.count_if(condition).alias

    return chosen.agg(F.count(F.lit(1)).alias("n_rows"), n(F.col("train"))("n_train"), n(F.col("test"))("n_test"),
                      n(F.col("test") & F.col("train"))("n_overlap"),
                      n(~F.col("test") & ~F.col("train"))("n_uncovered"), n(~F.col("train"))("n_not_train"))
