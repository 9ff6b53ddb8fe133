"""Randomised SVD (J1) against numpy's."""

import random

import numpy as np
import pytest

from supportflow.operators import retrieval as R
from supportflow.operators import svd as SV


def texts(n, seed=3):
    rng = random.Random(seed)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(5)]
    return [" ".join(rng.choice(topics[i % 5] if rng.random() < .8 else ["and", "the", "of"]) for _ in range(rng.randint(3, 25))) for i in range(n)]


def sparse(spark, m, seed=1, terms=30, parts=5):
    rng = np.random.default_rng(seed)
    A = rng.normal(size=(m, 6)) @ rng.normal(size=(6, terms)) + 0.01 * rng.normal(size=(m, terms))
    A[rng.random(A.shape) < .5] = 0
    A[3] = 0
    rows = [([int(j) for j in np.flatnonzero(a)], [float(x) for x in a[np.flatnonzero(a)]]) for a in A]
    return A, spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(parts)


@pytest.mark.parametrize("k,fan", [(4, 32), (6, 2)])
def test_factors_are_numpys(spark, monkeypatch, k, fan):
    monkeypatch.setattr(SV, "FAN", fan)                          # several levels of the tree
    A, rows = sparse(spark, 90)
    right, values = SV.decompose(rows, 30, k, passes=12)
    _, s, w = np.linalg.svd(A, full_matrices=False)
    assert values == pytest.approx(s[:k], rel=1e-6)
    assert np.allclose(right.T @ right, np.eye(k), atol=1e-10)
    assert np.linalg.norm(right @ right.T - w[:k].T @ w[:k]) < 1e-3       # the same subspace
    assert np.allclose(SV._gram_pass(rows, right), A.T @ (A @ right))
    R_ = SV._tree_triangle(rows, right)
    assert np.allclose(R_.T @ R_, right.T @ A.T @ A @ right)


def test_few_rows_terms_and_none(spark):
    A, rows = sparse(spark, 8, terms=5, parts=2)
    right, values = SV.decompose(rows, 5, 8)
    assert right.shape == (5, 8) and values[:5] == pytest.approx(np.linalg.svd(A, compute_uv=False), rel=1e-6) and not values[5:].any()
    right, values = SV.decompose(rows.limit(0), 5, 3)
    assert not values.any() and right.shape == (5, 3)
    with pytest.raises(ValueError, match="terms"):
        SV.decompose(rows, SV.MAX_TERMS + 1, 3)


def test_vectors_keep_similar_texts_together(spark):
    t = texts(120)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t)] + [(500, None), (501, "unknown")], "id long, text string")
    f = SV.fit(docs, k=6)
    vec = {r["id"]: np.array(r["vec"]) for r in f.vectors(docs, "text", ["id"]).collect()}
    assert len(vec) == 122 and not vec[500].any() and not vec[501].any() and len(vec[0]) == 6
    q = R.l2_normalise(f.vectors(docs.filter("id < 120").withColumnRenamed("id", "qid"), "text", ["qid"], "qvec"), "qvec")
    hits = R.top_k(q, q.selectExpr("qid as case_id", "qvec as vec"), k=3, exclude_self=True).collect()
    assert np.mean([h["qid"] % 5 == h["case_id"] % 5 for h in hits]) > 0.95


def test_a_batch_is_multiplied_in_slices(monkeypatch):
    """A batch of any size is cut by its terms: no row is lost, and none is cut."""
    import pyarrow as pa
    monkeypatch.setattr(SV, "TERMS", 50)
    rng = np.random.default_rng(2)
    sizes = [0, 0, 7, 200, 0, *rng.integers(0, 30, 100), 0]
    idx = pa.array([rng.integers(0, 40, n).astype(np.int32) for n in sizes], pa.list_(pa.int32()))
    val = pa.array([rng.normal(size=n) for n in sizes], pa.list_(pa.float64()))
    Q = rng.normal(size=(40, 6))
    parts = list(SV._slices(idx, val))
    assert sum(len(i) for i, _ in parts) == len(idx)
    assert all(len(i.flatten()) <= 50 or len(i) == 1 for i, _ in parts)
    whole = SV._products(idx, val, Q)[3]
    assert np.array_equal(np.vstack([SV._products(i, v, Q)[3] for i, v in parts]), whole)
