"""Binary classifier evaluation as aggregates (AGG21-24, JOIN5, PRJ13).

The score and prediction sit beside the label in the same row, so no
pairing join is needed; every metric is an aggregate over that row set.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskframe.functions.columns import round_even

CLASSES = (0, 1)
ROWS_PER_AUC_BUCKET = 2_000_000
MAX_AUC_BUCKETS = 8192


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, n) over the full 2x2 grid, zero-filled (AGG21)."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in CLASSES for p in CLASSES],
                                 "actual int, predicted int")
    counts = (df.groupBy(F.col(label).cast("int").alias("actual"),
                         F.col(prediction).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("actual").isin(*CLASSES) & F.col("predicted").isin(*CLASSES)))
    # at most 4 count rows: a proven-small build side for the outer join
    return (grid.join(F.broadcast(counts), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .orderBy("actual", "predicted"))


def _counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label), F.col(prediction)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return df.agg(cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 1)).alias("fp"),
                  cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 0) & (p == 0)).alias("tn"))


def _div(a, b):
    """a / b, 0 when b == 0 (the metrics' zero-division convention)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, and precision / recall / F1 of class 1; 0 where undefined (AGG22)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _counts(df, label, prediction).select(
        _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame, label: str, prediction: str,
                          names=("No Default", "Default")) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy (repeated in every
    column), macro and support-weighted averages: five rows, 4 decimals (AGG24)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    c = _counts(df, label, prediction)
    # class 0 sees the matrix mirrored: its tp is tn, its fp is fn, ...
    m = c.select(
        _div(tn, tn + fn).alias("p0"), _div(tn, tn + fp).alias("r0"),
        _div(2 * tn, 2 * tn + fn + fp).alias("f0"), (tn + fp).cast("double").alias("s0"),
        _div(tp, tp + fp).alias("p1"), _div(tp, tp + fn).alias("r1"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).cast("double").alias("s1"),
        _div(tp + tn, tp + fp + fn + tn).alias("acc"))
    s = F.col("s0") + F.col("s1")

    def w(a, b):
        return (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / s

    def row(name, p, r, f1, sup):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f1.alias("f1_score"), sup.alias("support"))

    col = F.col
    rows = F.array(
        row(names[0], col("p0"), col("r0"), col("f0"), col("s0")),
        row(names[1], col("p1"), col("r1"), col("f1"), col("s1")),
        row("accuracy", col("acc"), col("acc"), col("acc"), col("acc")),
        row("macro avg", (col("p0") + col("p1")) / 2, (col("r0") + col("r1")) / 2,
            (col("f0") + col("f1")) / 2, s),
        row("weighted avg", w("p0", "p1"), w("r0", "r1"), w("f0", "f1"), s))
    report = m.select(F.explode(rows).alias("r")).select("r.*")
    return report.select("class_name", *[round_even(c, 4).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC-AUC of a continuous score, ties counted one half (AGG23).

    ``AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N)`` over distinct
    scores. Rows are first reduced to one row per distinct score (map-side
    combined; a hot score is one row). The prefix sum of negatives has no
    natural key, so distinct scores are range-partitioned into buckets (the
    same sampling Spark uses for a global sort) and the running sum inside a
    bucket is a window partitioned by bucket. Per bucket only three numbers
    leave the executors; the bucket offsets (negatives in lower buckets) are
    added exactly with Python integers. -0.0 and 0.0 are one score.
    """
    s = (F.col(score).cast("double") + F.lit(0.0)).alias("s")
    per = (df.select(s, F.col(label).cast("int").alias("y"))
           .where(F.col("s").isNotNull() & F.col("y").isNotNull())
           .groupBy("s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                             F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).cast("bigint").alias("neg")))
    # three jobs read the per-score counts (totals, range bounds, buckets):
    # keep them for the duration of the call (recomputable if an executor is lost)
    per = per.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _auc_from_counts(df.sparkSession, per)
    finally:
        per.unpersist()


def _auc_from_counts(spark, per: DataFrame) -> DataFrame:
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("D")).first()
    P, N, D = (tot["P"] or 0), (tot["N"] or 0), (tot["D"] or 0)
    if P == 0 or N == 0:
        return spark.createDataFrame([(None, P, N)], "auc double, n_pos bigint, n_neg bigint")
    buckets = max(1, min(MAX_AUC_BUCKETS, math.ceil(D / ROWS_PER_AUC_BUCKET)))
    ranged = per.repartitionByRange(buckets, "s").withColumn("bucket", F.spark_partition_id())
    w = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    dec = "decimal(38,0)"
    # One evaluation of the range partitioning: per bucket, the within-bucket
    # part of the numerator and the bucket's positive / negative totals.
    per_bucket = (ranged.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
                  .groupBy("bucket")
                  .agg(F.sum(F.col("pos").cast(dec) * (2 * F.col("below") + F.col("neg")).cast(dec)).alias("a"),
                       F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
                  .collect())  # one row per bucket, <= MAX_AUC_BUCKETS
    num2, offset = 0, 0
    for r in sorted(per_bucket, key=lambda r: r["bucket"]):
        num2 += int(r["a"]) + 2 * int(r["bpos"]) * offset
        offset += int(r["bneg"])
    return spark.createDataFrame([(num2 / (2.0 * P * N), P, N)],
                                 "auc double, n_pos bigint, n_neg bigint")


def score_columns(df: DataFrame, score: str, threshold: float = 0.0) -> DataFrame:
    """Prediction (score > threshold) and confidence |score| (ML4, PRJ13)."""
    return df.withColumn("prediction", (F.col(score) > F.lit(threshold)).cast("int")) \
             .withColumn("confidence", F.abs(F.col(score)))
