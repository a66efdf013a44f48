"""Model pipeline invariants: PCA variance choice, scaled stats, save ->
load -> same scores, stream scoring equals batch scoring."""

import uuid

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from riskframe import schema as S
from riskframe.operators import model
from riskframe.plans import queries as Q
from riskframe.plans.context import prepared
from riskframe.session import ensure_checkpoint_dir


def test_choose_k():
    assert model.choose_k([0.5, 0.3, 0.15, 0.05], 0.95) == 3  # 0.95 exactly is not above
    assert model.choose_k([0.5, 0.3, 0.16, 0.04], 0.95) == 3
    assert model.choose_k([0.97, 0.03], 0.95) == 1


def test_pca_variance_is_monotone(spark):
    rows = Q.pca_variance(spark, SMALL).orderBy("component").collect()
    cum = [r.cumulative_ratio for r in rows]
    assert all(b >= a for a, b in zip(cum, cum[1:]))
    assert cum[-1] == pytest.approx(1.0)
    k = rows[0].n_components
    assert cum[k - 1] > S.PCA_VARIANCE and (k == 1 or cum[k - 2] <= S.PCA_VARIANCE)


def test_scaled_train_mean_zero_std_one(spark):
    st = Q._state(spark, SMALL)
    x, _ = Q._imputed(spark, SMALL)
    from riskframe.operators import features
    s = features.scale(x.where("split = 'train'").select(*st["num_cols"]), st)
    row = s.agg(*[F.avg(c).alias(f"m_{c}") for c in st["num_cols"]],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in st["num_cols"]]).first()
    for c in st["num_cols"]:
        assert abs(row[f"m_{c}"]) < 1e-9
        assert row[f"s_{c}"] == pytest.approx(1.0, abs=1e-9) or row[f"s_{c}"] == 0.0


def test_no_missing_after_pipeline(spark):
    r = Q.pipeline_stage_counts(spark, SMALL).first()
    assert r.missing_after_imputation == 0
    assert r.n_train + r.n_test == r.n_rows


def test_save_load_same_scores(spark):
    m = Q._model(spark, SMALL)
    test = prepared(spark, SMALL).test
    path = f"{ensure_checkpoint_dir(spark)}/test-model-{uuid.uuid4().hex}"
    m.pipeline.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = {r[S.KEY]: (r.prediction, r.decision, r.p_default)
         for r in model.score(m.pipeline, test).select(S.KEY, "prediction", "decision", "p_default").collect()}
    b = {r[S.KEY]: (r.prediction, r.decision, r.p_default)
         for r in model.score(loaded, test).select(S.KEY, "prediction", "decision", "p_default").collect()}
    assert a == b
    # the class is the sign of the margin and confidence its absolute value
    assert all(p == int(d > 0) for p, d, _ in a.values())


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in Q.applicant_scores(spark, SMALL).collect()}
    stream = {tuple(r) for r in Q.streamed_applicant_scores(spark, SMALL).collect()}
    assert batch == stream and len(batch) > 0


def test_model_beats_chance(spark):
    # sf0.001 has ~300 test rows with ~20 defaults; "clearly above 0.5"
    r = Q.svm_test_metrics(spark, SMALL).first()
    assert r.auc > 0.6


def test_subsample_parity_option(spark):
    """The dashboard's 5 % stratified subsample: the SVM sees exactly the
    rows (and class counts) of the ``class_weights`` query. On sf0.01 (600
    rows): 60 rows of sf0.001 make the hinge-loss solver crawl."""
    ctx = prepared(spark, MEDIUM)
    m = model.fit_pipeline(ctx.train, state=Q._state(spark, MEDIUM), subsample_fraction=S.SUBSAMPLE_FRACTION)
    weights = {r[S.LABEL]: r.n for r in Q.class_weights(spark, MEDIUM).collect()}
    assert m.class_counts == weights
    assert m.n_train_rows == Q.stratified_subsample(spark, MEDIUM).count()
    scored = model.score(m.pipeline, ctx.test).select("prediction", "p_default").collect()
    assert scored and all(0.0 <= r.p_default <= 1.0 for r in scored)


def test_pca_matches_numpy_eigenvalues(spark):
    """FE8 against brute force on the small fixture: the explained-variance
    ratios are the eigenvalue shares of the centred training matrix, and the
    projection of a row equals the centred row times the components (up to
    each component's sign)."""
    import numpy as np

    from riskframe.operators.model import RiskPreprocessorModel
    import json

    m = Q._model(spark, SMALL)
    st = m.state
    prep = RiskPreprocessorModel(stateJson=json.dumps(st), applyClip=True)
    x = np.array([r.features.toArray() for r in prep.transform(prepared(spark, SMALL).train).collect()])
    from riskframe.operators.features import encoded_means
    assert np.allclose(x.mean(axis=0), encoded_means(st), atol=1e-9)  # centring from the fitted counts
    own = m.pipeline.stages[2].transform(m.pipeline.stages[1].transform(prep.transform(prepared(spark, SMALL).train)))
    z = np.array([r.pca_features.toArray() for r in own.select("pca_features").collect()])
    assert np.allclose(z.mean(axis=0), 0.0, atol=1e-9) and z.shape[1] == m.k
    eig = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    assert np.allclose(m.explained, eig / eig.sum(), atol=1e-9)
    pca = m.pipeline.stages[1]
    pc = pca.pc.toArray()
    vals, vecs = np.linalg.eigh(np.cov(x, rowvar=False))
    top = vecs[:, np.argsort(vals)[::-1][:m.k]]
    assert np.allclose(np.abs(pc[:, :m.k].T @ top), np.eye(m.k), atol=1e-6)


def test_svm_solution_is_a_local_optimum_of_the_c_form(spark):
    """ML2: the LinearSVC solution minimises the reference's objective
    0.5*|w|^2 + C * sum_i weight_i * hinge_i (balanced weights), checked
    against random perturbations of (w, b)."""
    import numpy as np

    m = Q._model(spark, SMALL)
    stages = m.pipeline.stages
    svm = stages[3]
    rows = (stages[2].transform(stages[1].transform(stages[0].transform(prepared(spark, SMALL).train)))
            .select(S.LABEL, "pca_features").collect())
    x = np.array([r.pca_features.toArray() for r in rows])
    y = np.array([1.0 if r[S.LABEL] == 1 else -1.0 for r in rows])
    n, n_pos = len(y), int((y > 0).sum())
    wt = np.where(y > 0, n / (2.0 * n_pos), n / (2.0 * (n - n_pos)))

    def objective(w, b):
        return 0.5 * w @ w + S.SVM_C * np.sum(wt * np.maximum(0.0, 1.0 - y * (x @ w + b)))

    w0, b0 = svm.coefficients.toArray(), svm.intercept
    j0 = objective(w0, b0)
    rng = np.random.default_rng(0)
    for scale in (1e-2, 1e-3):
        for _ in range(200):
            dw = rng.normal(size=w0.shape) * scale * (np.linalg.norm(w0) + 1e-9)
            db = rng.normal() * scale * (abs(b0) + 1e-9)
            assert j0 <= objective(w0 + dw, b0 + db) * (1 + 1e-3)
