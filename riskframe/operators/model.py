"""Class weights, PCA to a variance target, class-weighted linear SVM, Platt
calibration and the persisted scoring pipeline (ML1-ML7, FE5, FE8, WIN1,
WIN2, AGG25-AGG27, SNK1).

Everything distributed is a Spark ML estimator: the covariance behind PCA is
a tree aggregate of d x d partial Gramians (the d x d eigenproblem runs on the
driver, bounded by the encoded width), ``LinearSVC`` runs one aggregate pass
per iteration over the cached training vectors, and the calibration is a
``LogisticRegression`` over out-of-fold decision values.
"""

from __future__ import annotations

import json
import time
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.storagelevel import StorageLevel

from riskframe import schema as S
from riskframe.functions.columns import hash_order, unpivot
from riskframe.operators.certify import platt_sums
from riskframe.operators.features import DENSE_WIDTH, encoded_means, feature_names, fit_state, prepared_features
from riskframe.operators.sampling import stratified_subsample


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights ``n / (k * n_c)`` (ML1): one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # windows over the aggregated result (one row per class)
    every = Window.partitionBy()
    total, k = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return (counts.select(label, "n", (total.cast("double") / (k * F.col("n"))).alias("weight"))
            .orderBy(label))


# --------------------------------------------------------------------------
# Pipeline stages written in Python (persisted with the default params writer)
class RiskPreprocessorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted sentinel / clip / impute / scale / one-hot preparation."""

    stateJson = Param(Params._dummy(), "stateJson", "fitted statistics as JSON",
                      typeConverter=TypeConverters.toString)
    applyClip = Param(Params._dummy(), "applyClip", "clip to the training fences",
                      typeConverter=TypeConverters.toBoolean)
    outputCol = Param(Params._dummy(), "outputCol", "output vector column",
                      typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, stateJson: str = "{}", applyClip: bool = True, outputCol: str = "features"):
        super().__init__()
        self._setDefault(stateJson="{}", applyClip=True, outputCol="features")
        self._set(**self._input_kwargs)

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.stateJson))

    def setApplyClip(self, value: bool) -> "RiskPreprocessorModel":
        return self._set(applyClip=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state()
        return prepared_features(df, state, self.getOrDefault(self.applyClip), self.getOrDefault(self.outputCol),
                                 packed=0 < len(feature_names(state)) <= DENSE_WIDTH)


class LeadingComponents(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The first components of a projection of uncentred rows, less the
    projection of the training means: the centring of PCA, done after the
    projection so that the encoded rows stay sparse."""

    offset = Param(Params._dummy(), "offset", "projected training means", typeConverter=TypeConverters.toListFloat)
    inputCol = Param(Params._dummy(), "inputCol", "projection", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "leading centred components", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, offset: list | None = None, inputCol: str = "pca_all", outputCol: str = "pca_features"):
        super().__init__()
        self._setDefault(offset=[], inputCol="pca_all", outputCol="pca_features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        offset = self.getOrDefault(self.offset)
        lead = F.slice(vector_to_array(self.getOrDefault(self.inputCol)), 1, len(offset))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(
            F.zip_with(lead, F.lit(offset), lambda x, m: x - m)))


class PlattCalibrationModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``p(default) = 1 / (1 + exp(-(a * margin + b)))`` on the SVM margin."""

    a = Param(Params._dummy(), "a", "slope", typeConverter=TypeConverters.toFloat)
    b = Param(Params._dummy(), "b", "intercept", typeConverter=TypeConverters.toFloat)
    rawCol = Param(Params._dummy(), "rawCol", "raw prediction column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, a: float = 1.0, b: float = 0.0, rawCol: str = "rawPrediction"):
        super().__init__()
        self._setDefault(a=1.0, b=0.0, rawCol="rawPrediction")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = vector_to_array(F.col(self.getOrDefault(self.rawCol)))[1]
        z = F.lit(self.getOrDefault(self.a)) * m + F.lit(self.getOrDefault(self.b))
        return (df.withColumn("decision", m)
                .withColumn("p_default", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))


# --------------------------------------------------------------------------
@dataclass
class FittedModel:
    pipeline: PipelineModel
    state: dict
    explained: list[float]
    k: int
    encoded_width: int
    n_train_rows: int
    class_counts: dict
    reg_param: float
    svm_iterations: int
    platt: tuple[float, float]
    subsample: str | None
    info: dict = field(default_factory=dict)

    def facts(self) -> dict:
        """All but the pipeline, as JSON values."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "pipeline"}
        return json.loads(json.dumps(own | {"class_counts": list(self.class_counts.items())}, default=float))

    @staticmethod
    def from_facts(pipeline: PipelineModel, facts: dict) -> FittedModel:
        own = {"class_counts": {c: n for c, n in facts["class_counts"]}, "platt": tuple(facts["platt"])}
        return FittedModel(pipeline=pipeline, **facts | own)


def choose_k(ratios: list[float], target: float) -> int:
    """Smallest k whose cumulative ratio exceeds ``target`` (WIN2)."""
    cum, k = 0.0, 0
    for r in ratios:
        if cum <= target:
            k += 1
        cum += r
    return max(1, min(k, len(ratios)))


def _fit_svm(train: DataFrame, features: str, label: str, weight: str, reg: float, max_iter: int):
    svm = LinearSVC(featuresCol=features, labelCol=label, weightCol=weight, regParam=reg,
                    standardization=False, fitIntercept=True, maxIter=max_iter, tol=1e-6)
    return svm.fit(train)


def fits_at_once(df: DataFrame, block_bytes: int, most: int) -> int:
    """How many fits that hold ``block_bytes`` each go into half of the executors'
    storage memory together; at least one, which Spark puts on disk where it must.
    Fits share the cores anyway: more at once only hide the start of small jobs."""
    memory = df.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus()
    status = memory.values().toList()
    sizes = [status.apply(i)._1() for i in range(status.size())]
    # on a cluster one of the entries is the driver, which holds no blocks
    total = sum(sizes) - (max(sizes) if len(sizes) > 1 else 0)
    return max(1, min(most, int(total // 2 // max(1, block_bytes))))


def fold_reg(weight_in_fold: dict, fold: int, C: float) -> float:
    """Regularisation of a fold's model: its own training rows (all other
    folds) at the same C."""
    total = sum(w for f, w in weight_in_fold.items() if f != fold)
    return 1.0 / (C * total) if total else 1.0 / C


def fit_pipeline(train_raw: DataFrame, variance: float = S.PCA_VARIANCE, C: float = S.SVM_C,
                 subsample_fraction: str | None = None, folds: int = 5, max_iter: int = 100,
                 parallel_fits: int = 6, state: dict | None = None) -> FittedModel:
    """Fit preparation -> centring -> PCA (variance target) -> weighted
    LinearSVC -> Platt calibration on the raw training rows.

    ``subsample_fraction`` trains the SVM on a stratified subsample (the
    analysed dashboard uses 0.05 to dodge a quadratic solver); the default
    trains on every training row, which the distributed solver handles in
    linear time.
    """
    tick = [time.time()]
    info: dict = {}

    def lap(name):
        now = time.time()
        info[name] = round(now - tick[0], 3)
        tick[0] = now

    state = state or fit_state(train_raw)
    lap("state")
    prep = RiskPreprocessorModel(stateJson=json.dumps(state), applyClip=True, outputCol="features")
    xc = prep.transform(train_raw.select(S.KEY, S.LABEL, *state["num_cols"], *state["cat_cols"]))
    d = len(feature_names(state))
    # encoded once: the components read the rows twice, the projection once more
    xc = xc.select(S.KEY, S.LABEL, "features").persist(StorageLevel.DISK_ONLY)
    try:
        return _fit_encoded(xc, prep, train_raw, state, d, variance, C, subsample_fraction, folds, max_iter, parallel_fits, info, lap)
    finally:
        xc.unpersist()


def _fit_encoded(xc: DataFrame, prep: RiskPreprocessorModel, train_raw: DataFrame, state: dict, d: int, variance: float,
                 C: float, subsample_fraction: str | None, folds: int, max_iter: int, parallel_fits: int,
                 info: dict, lap) -> FittedModel:
    """``fit_pipeline`` from the encoded training rows on."""
    pca_full = PCA(k=d, inputCol="features", outputCol="pca_all").fit(xc)
    ratios = [float(v) for v in pca_full.explainedVariance]
    k = choose_k(ratios, variance)
    lap("pca")
    # the means come from the fitted statistics, no pass
    offset = (np.array(encoded_means(state)) @ pca_full.pc.toArray())[:k]
    slicer = LeadingComponents(offset=[float(v) for v in offset], inputCol="pca_all", outputCol="pca_features")
    base = slicer.transform(pca_full.transform(xc)).select(S.KEY, S.LABEL, "pca_features")
    if subsample_fraction:
        base = stratified_subsample(base, S.LABEL, S.KEY, subsample_fraction, S.SUBSAMPLE_SALT)
    labels = train_raw.select(S.KEY, S.LABEL)
    if subsample_fraction:
        labels = stratified_subsample(labels, S.LABEL, S.KEY, subsample_fraction, S.SUBSAMPLE_SALT)
    weights = balanced_weights(labels, S.LABEL)
    wrows = {r[S.LABEL]: (r["n"], r["weight"]) for r in weights.collect()}
    n_train = sum(n for n, _ in wrows.values())
    lap("weights")
    reg = 1.0 / (C * n_train)  # sum of balanced weights = n_train
    wexpr = F.lit(None).cast("double")
    for c, (_, wt) in wrows.items():
        wexpr = F.when(F.col(S.LABEL) == c, F.lit(wt)).otherwise(wexpr)
    train = (base.withColumn("weight", wexpr)
             .withColumn("label_d", F.col(S.LABEL).cast("double"))
             .withColumn("fold", F.pmod(hash_order(S.KEY, S.FOLD_SALT), F.lit(folds))))
    # the solver keeps the partitions of the scan: one task for each. Each fit reads
    # these rows twice and holds blocks of its own, which need the memory
    train = train.persist(StorageLevel.DISK_ONLY)
    oof = None
    try:
        jobs = {"final": train}
        for f in range(folds):
            jobs[f] = train.where(F.col("fold") != f)
        in_fold = {r["fold"]: r["w"] for r in train.groupBy("fold").agg(F.sum("weight").alias("w")).collect()}
        regs = {"final": reg} | {f: fold_reg(in_fold, f, C) for f in range(folds)}
        at_once = fits_at_once(train, n_train * (k + 2) * 8, parallel_fits)
        info["fits_at_once"] = at_once
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            futures = {name: pool.submit(_fit_svm, df, "pca_features", "label_d", "weight", regs[name], max_iter)
                       for name, df in jobs.items()}
            models = {name: fut.result() for name, fut in futures.items()}
        svm = models["final"]
        info["not_converged"] = [str(name) for name, m in models.items()
                                 if m.hasSummary and m.summary().totalIterations >= max_iter]
        if info["not_converged"]:
            warnings.warn(f"linear SVM stopped at {max_iter} iterations: {info['not_converged']}", stacklevel=2)
        info["fold_regs"] = [regs[f] for f in range(folds)]
        info["solver_partitions"] = train.rdd.getNumPartitions()
        lap("svm_fits")
        # out-of-fold margins -> Platt targets (P+1)/(P+2), 1/(N+2)
        for f in range(folds):
            part = models[f].transform(train.where(F.col("fold") == f)).select(
                "label_d", vector_to_array("rawPrediction")[1].alias("m"))
            oof = part if oof is None else oof.unionByName(part)
        # two numbers a row, read by the calibration and its sums
        oof = oof.persist()
        n_pos = wrows.get(1, (0, 0))[0]
        n_neg = wrows.get(0, (0, 0))[0]
        t_pos = (n_pos + 1.0) / (n_pos + 2.0)
        t_neg = 1.0 / (n_neg + 2.0)
        t = F.when(F.col("label_d") == 1.0, F.lit(t_pos)).otherwise(F.lit(t_neg))
        soft = oof.select(F.array(F.col("m")).alias("arr"), t.alias("t"))
        # each margin twice: target 1 with weight t, target 0 with weight 1 - t
        soft = unpivot(soft, ["arr"], [(1.0, F.col("t")), (0.0, F.lit(1.0) - F.col("t"))], ["y", "w"])
        soft = soft.select(array_to_vector("arr").alias("mf"), "y", "w")
        lr = LogisticRegression(featuresCol="mf", labelCol="y", weightCol="w", regParam=0.0,
                                standardization=False, maxIter=100, tol=1e-10).fit(soft)
        a, b = float(lr.coefficients[0]), float(lr.intercept)
        info["platt_sums"] = platt_sums(oof.select("m", t.alias("t")), a, b)
        lap("platt")
    finally:
        if oof is not None:
            oof.unpersist()
        train.unpersist()
    platt = PlattCalibrationModel(a=a, b=b, rawCol="rawPrediction")
    pipeline = PipelineModel(stages=[prep, pca_full, slicer, svm.setFeaturesCol("pca_features"), platt])
    return FittedModel(pipeline=pipeline, state=state, explained=ratios, k=k, encoded_width=d,
                       n_train_rows=n_train, class_counts={c: n for c, (n, _) in wrows.items()},
                       reg_param=reg, svm_iterations=svm.summary().totalIterations if svm.hasSummary else -1,
                       platt=(a, b), subsample=subsample_fraction, info=info)


def training_points(m: FittedModel, train_raw: DataFrame) -> DataFrame:
    """(label, weight, x) of the SVM's training rows, for a model fitted on all of them."""
    n, k = m.n_train_rows, len(m.class_counts)
    weight = F.lit(None).cast("double")
    for c, rows in m.class_counts.items():
        weight = F.when(F.col(S.LABEL) == c, F.lit(n / (k * rows))).otherwise(weight)
    return PipelineModel(stages=m.pipeline.stages[:3]).transform(train_raw).select(
        F.col(S.LABEL).cast("double").alias("label"), weight.alias("weight"), vector_to_array("pca_features").alias("x"))


def score(model: PipelineModel, df: DataFrame, apply_clip: bool = True) -> DataFrame:
    """Score rows end to end: class (margin > 0), confidence |margin|,
    calibrated probability of default (ML3-ML6). ``apply_clip=False`` scores
    like the dashboard's live form, which does not clip new applicants."""
    stages = list(model.stages)
    prep = stages[0].copy().setApplyClip(apply_clip)
    out = PipelineModel(stages=[prep] + stages[1:]).transform(df)
    return (out.withColumn("prediction", F.col("prediction").cast("int"))
            .withColumn("confidence", F.abs(F.col("decision"))))


def explained_variance_table(spark, ratios: list[float], k: int, width: int,
                             variance: float = S.PCA_VARIANCE) -> DataFrame:
    """Per component: ratio, running sum (WIN1), kept flag (WIN2), with the
    component count and the feature-reduction percent (AGG25, AGG26)."""
    df = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)],
                               "component int, explained_ratio double")
    # d rows (the encoded width): a bounded window without partition key
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("cumulative_ratio", F.sum("explained_ratio").over(w))
            .withColumn("kept", F.col("component") <= F.lit(k))
            .withColumn("n_components", F.lit(k))
            .withColumn("encoded_width", F.lit(width))
            .withColumn("variance_target", F.lit(variance))
            .withColumn("reduction_pct", F.round((F.lit(1.0) - F.lit(k) / F.lit(width)) * 100, 1)))
