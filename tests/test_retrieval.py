"""Blocked exact top-k (J4-J6) against numpy brute force."""

import numpy as np
import pytest

from supportflow.operators import retrieval as R


def _brute(Q, qids, C, cids, k):
    out = {}
    for qi, q in zip(qids, Q):
        s = C @ q
        order = sorted(range(len(cids)), key=lambda j: (-s[j], cids[j]))[:k]
        out[qi] = [(cids[j], round(float(s[j]), 9)) for j in order]
    return out


def _frame(spark, ids, vecs, idc, vc):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs)],
                                 f"{idc} long, {vc} array<double>")


@pytest.mark.parametrize("block_rows,pivots", [(20000, None), (10, None), (7, 12)])
def test_topk_matches_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(7)
    C = rng.normal(size=(60, 8))
    C /= np.linalg.norm(C, axis=1, keepdims=True)
    C[5] = C[6]                           # equal scores: tie broken by case_id
    C[7] = 0.0                            # zero vector
    Q = rng.normal(size=(25, 8))
    Q[0] = C[10]                          # query equal to a corpus row
    qids, cids = list(range(100, 125)), list(range(60))
    q = _frame(spark, qids, Q, "qid", "qvec")
    c = _frame(spark, cids, C, "case_id", "vec")
    hits = R.top_k(q, c, k=5, block_rows=block_rows, pivots=pivots).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.case_id, round(h.score, 9)))
    assert got == _brute(Q, qids, C, cids, 5)
    assert got[100][0][0] == 10


def test_k_larger_than_corpus(spark):
    q = _frame(spark, [1, 2], [[1.0, 0.0], [0.0, 1.0]], "qid", "qvec")
    c = _frame(spark, [7, 8, 9], [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], "case_id", "vec")
    hits = R.top_k(q, c, k=5).collect()
    assert len(hits) == 6                  # three per query, no padding
    assert {(h.qid, h.rank, h.case_id) for h in hits if h.rank == 1} == {(1, 1, 7), (2, 1, 9)}


def test_normalise_keeps_zero_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>")
    out = {r.id: r.v for r in R.l2_normalise(df, "v").collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and out[2] == [0.0, 0.0]


def test_text_vectors_match_python(spark):
    import hashlib

    import regex

    from supportflow.operators import features as FT
    rows = [(1, "Hello hello World!"), (2, None), (3, "a b c"), (4, "Élan vital, élan")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.v for r in FT.text_vectors(df, "text", "v", dim=16).collect()}
    for i, t in rows:
        toks = regex.findall(r"[\p{L}\p{N}_]{2,}", (t or "").lower())
        want = np.bincount([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 16 for x in toks],
                           minlength=16).astype(float)
        assert got[i] == list(want)
    assert sum(got[1]) == 3 and sum(got[2]) == 0 and sum(got[4]) == 3


@pytest.mark.parametrize("block_rows,pivots", [(20000, None), (8, 6)])
def test_exclude_self_leave_one_out(spark, block_rows, pivots):
    rng = np.random.default_rng(11)
    V = rng.normal(size=(30, 6))
    V /= np.linalg.norm(V, axis=1, keepdims=True)
    ids = list(range(30))
    q = _frame(spark, ids, V, "qid", "qvec")
    c = _frame(spark, ids, V, "case_id", "vec")
    hits = R.top_k(q, c, k=2, block_rows=block_rows, pivots=pivots, exclude_self=True).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append(h.case_id)
    for i in ids:
        s = V @ V[i]
        order = [j for j in sorted(ids, key=lambda j: (-s[j], j)) if j != i][:2]
        assert got[i] == order


def test_far_blocks_are_skipped_and_results_stay_exact(spark):
    """Queries near tight groups read few of the blocks; zero vectors and negative scores too."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    C = np.repeat(centres, 30, axis=0) + 0.02 * rng.normal(size=(600, 16))
    C[::97] = 0.0
    C[5] = C[4]
    Q = np.concatenate([centres[:15] + 0.02 * rng.normal(size=(15, 16)), -centres[:3], np.zeros((1, 16))])
    qids, cids = list(range(1000, 1000 + len(Q))), list(range(600))
    visits = {}
    hits = R.top_k(_frame(spark, qids, Q, "qid", "qvec"), _frame(spark, cids, C, "case_id", "vec"), k=5,
                   block_rows=25, pivots=60, visits=visits).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.case_id, round(h.score, 9)))
    want = _brute(Q, qids, C, cids, 5)
    assert {q: [(c, s) for c, s in v] for q, v in got.items()} == want
    assert visits["visited"] < 0.6 * visits["all"], visits


def test_a_group_is_copied_once_per_block_of_its_own_visits(spark):
    """One group that most queries visit: the others are not copied for them."""
    rng = np.random.default_rng(5)
    centres = np.eye(12)
    C = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(480, 12))
    Q = np.concatenate([np.repeat(centres[:1], 300, axis=0), centres[1:]]) + 0.01 * rng.normal(size=(311, 12))
    qids, cids = list(range(311)), list(range(480))
    visits, block = {}, 30
    hits = R.top_k(_frame(spark, qids, Q, "qid", "qvec"), _frame(spark, cids, C, "case_id", "vec"), k=3,
                   block_rows=block, pivots=40, visits=visits).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.case_id, round(h.score, 9)))
    assert got == _brute(Q, qids, C, cids, 3)
    assert sum(n for _, n, _ in visits["copies"]) == visits["visited"]
    assert all(c == -(-n // block) for _, n, c in visits["copies"])
    # the corpus was copied len(queries) / block times for every group before
    assert sum(c for *_, c in visits["copies"]) < 0.5 * -(-311 // block) * len({g for g, *_ in visits["copies"]})


def test_pivot_tree_bounds_hold_and_stay_small(monkeypatch):
    """No vector scores above its leaf's or its top pivot's bound; arrays of ``CHUNK`` rows."""
    rng = np.random.default_rng(9)
    V = rng.normal(size=(3000, 6)) * rng.choice([0.1, 1, 5], size=(3000, 1))
    V[::50] = 0
    tree = R.PivotTree(R.PivotTree.units(np.concatenate([V[1:40], V[1:3]]))[0])
    leaf, angle, top, norm = tree.place(V)
    rows = [(g, (leaf == g).sum(), angle[leaf == g].max(), top[leaf == g].max(), norm[leaf == g].min(), norm[leaf == g].max())
            for g in np.unique(leaf)]
    tree.summary(np.array(rows, float))
    Q = rng.normal(size=(300, 6))
    S = Q @ V.T
    sizes, whole = [], R.PivotTree.units
    monkeypatch.setattr(R.PivotTree, "units", staticmethod(lambda v: sizes.append(len(v)) or whole(v)))
    for least in (-1.0, 0.0, 0.5, 3.0):
        for q, reach in enumerate(tree.reached(Q, np.full(300, least))):
            assert set(leaf[S[q] >= least]) <= set(reach.tolist())
            assert len(set(reach.tolist())) == len(reach)
    assert all(set(f) <= set(leaf) and tree.rows[f].sum() >= 3 for f in tree.first(Q, 3)) and max(sizes) <= R.CHUNK


def test_empty_sides(spark):
    q, c = _frame(spark, [1], [[1.0, 0.0]], "qid", "qvec"), _frame(spark, [7], [[1.0, 0.0]], "case_id", "vec")
    for options in ({}, {"pivots": 2}):
        assert R.top_k(q, c.limit(0), **options).count() == 0
        assert R.top_k(q.limit(0), c, **options).count() == 0


def test_vector_table_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from supportflow.operators import features as FT
    from supportflow.sources import tables as TB
    texts = spark.createDataFrame([(1, "some words here"), (2, ""), (3, None)], "case_id long, t string")
    v = R.l2_normalise(FT.text_vectors(texts, "t", "vec").select("case_id", "vec"), "vec")
    TB.write_vectors(v, str(tmp_path / "v"))
    back = TB.read_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    TB.write_vectors(v.withColumn("vec", F.col("vec").cast("array<float>")), str(tmp_path / "v"))
    assert TB.read_vectors(spark, str(tmp_path / "v")).count() == 3


def test_score_from_evidence_string(spark):
    df = spark.createDataFrame([("Similarity 0.8312 | Customer: x | Brand: y",), ("Similarity -0.1 | z",), ("none",), (None,)],
                               "e string")
    assert [r.s for r in df.select(R.similarity_from_evidence("e").alias("s")).collect()] == [0.8312, -0.1, 0.0, 0.0]


def test_cells_match_brute_force_with_copies_ties_and_zeros(spark, monkeypatch):
    """Blocks of a few rows, tiles smaller than a block, more copies than ``k``, null query ids."""
    for name, n in (("PACK", 16), ("TILE", 8), ("HELD", 50), ("PAIRS", 7)):
        monkeypatch.setattr(R, name, n)
    rng = np.random.default_rng(13)
    C = rng.integers(0, 4, size=(300, 12)) * 1.0
    C[40:90] = C[40]                      # one large group of copies
    C[100:104] = 0.0
    Q = np.concatenate([C[35:45], rng.integers(0, 3, size=(40, 12)), np.zeros((2, 12)), -C[:2], 1e-30 * C[3:4]])
    qids, cids = list(range(1000, 1000 + len(Q))), [int(i) for i in rng.permutation(300)]
    calls, real = [], R._cells_top_k
    monkeypatch.setattr(R, "_cells_top_k", lambda *a: calls.append(a) or real(*a))
    hits = R.top_k(_frame(spark, qids, Q, "qid", "qvec"), _frame(spark, cids, C, "case_id", "vec"), k=4, block_rows=50).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.case_id, h.score))
    assert len(calls) == 1
    for q, v in zip(qids, Q):             # scores of whole numbers are exact: every tie goes to the smaller id
        s = C @ v
        assert got[q] == [(cids[j], s[j]) for j in sorted(range(300), key=lambda j: (-s[j], cids[j]))[:4]] or q == qids[-1], q


def test_one_cell_holds_a_part_of_a_corpus(monkeypatch):
    """The pairs that a task holds stay bounded where all scores are equal."""
    import pickle

    import pyarrow as pa
    n, dim, held = 3000, 8, []
    monkeypatch.setattr(R, "HELD", 2000)
    monkeypatch.setattr(R, "TILE", 100)
    V = np.zeros((n, dim))
    V[:, 0], V[:, 1] = 1, np.arange(n)      # no two equal, all alike for the query
    row, at = np.nonzero(V)
    body = lambda ids, X, r, c: pickle.dumps((ids, dim, np.bincount(r, minlength=len(X)).astype(np.int32), c.astype(np.int32), X[r, c]), 5)
    q = np.zeros((20, dim))
    q[:, 0] = 1
    real = R._scores
    monkeypatch.setattr(R, "_scores", lambda Q, c, r, col: held.append(len(r)) or real(Q, c, r, col))
    run = R._cell_topk(3, False)
    out = run(None, pa.table({"body": pa.array([body(np.arange(20), q, *np.nonzero(q))], pa.binary())}),
              pa.table({"body": pa.array([body(np.arange(n)[::-1].copy(), V, row, at)], pa.binary())}))
    assert out["case_id"].to_pylist() == [0, 1, 2] * 20 and max(held) <= 2000 + 20 * 100


def _one_cell(Q, C, k, exclude_self=False):
    """``{qid: [(case_id, score)]}`` of one cell, ids counted from 0."""
    import pickle

    import pyarrow as pa

    def table(X):
        row, at = np.nonzero(X)
        packed = np.arange(len(X)), X.shape[1], np.bincount(row, minlength=len(X)).astype(np.int32), at.astype(np.int32), X[row, at]
        return pa.table({"body": pa.array([pickle.dumps(packed, 5)], pa.binary())})
    out, got = R._cell_topk(k, exclude_self)(None, table(Q), table(C)).to_pylist(), {}
    for h in sorted(out, key=lambda h: (h["qid"], h["rank"])):
        got.setdefault(h["qid"], []).append((h["case_id"], h["score"]))
    return got


def test_a_cell_scores_only_pairs_whose_folded_bound_reaches_the_best(monkeypatch):
    """Sparse rows: behind the first tile few pairs are scored; the hits are those of every pair."""
    monkeypatch.setattr(R, "TILE", 200)
    monkeypatch.setattr(R, "ROWS", 16)
    monkeypatch.setattr(R, "WAITING", 2)
    rng = np.random.default_rng(3)
    p = 1 / (2 + np.arange(64))                    # a few common components, many rare ones
    C = (rng.random((3001, 64)) < 1.5 * p) * rng.integers(1, 4, size=(3001, 64)).astype(float)
    C[::5] *= -1                                   # signs do not matter to the bound
    C[700:760] = C[700]
    Q = np.concatenate([C[690:740], (rng.random((30, 64)) < 1.5 * p) * 2.0])
    scored, real = [], R._pair_scores
    monkeypatch.setattr(R, "_pair_scores", lambda unit, whole, row, col: scored.append(len(row)) or real(unit, whole, row, col))
    for exclude_self in (False, True):
        scored.clear()
        got = _one_cell(Q, C, 4, exclude_self)
        for i, q in enumerate(Q):                  # scores of whole numbers are exact
            s = C @ q
            want = sorted((j for j in range(len(C)) if not (exclude_self and j == i)), key=lambda j: (-s[j], j))[:4]
            assert got[i] == [(j, s[j]) for j in want], i
        assert 0 < sum(scored) < 0.1 * len(Q) * len(C)


def test_folded_rows_bound_every_score_and_dense_rows_are_not_folded_for_long(monkeypatch):
    rng = np.random.default_rng(4)
    C, Q = rng.normal(size=(900, 48)), rng.normal(size=(70, 48))
    C, Q = (X / np.linalg.norm(X, axis=1)[:, None] for X in (C, Q))
    folded = R._Folded(C.astype(np.float32))
    assert folded.C.shape == (900, 24)
    assert (folded.rows(Q.astype(np.float32)) @ folded.C.T >= Q @ C.T - 1e-5).all()
    monkeypatch.setattr(R, "TILE", 50)
    monkeypatch.setattr(R, "ROWS", 10)
    kept, real = [], R._Folded
    monkeypatch.setattr(R, "_Folded", lambda X: kept.append(real(X)) or kept[-1])
    got, S = _one_cell(Q, C, 3), Q @ C.T
    assert all([j for j, _ in got[i]] == np.argsort(-S[i])[:3].tolist() for i in range(len(Q)))
    assert len(kept) == 1 and kept[0].many == 3 and kept[0].few <= 3        # three batches tried, 119 tiles in all
    flags = rng.random((7, 11)) < 0.2
    assert R._where(flags).tolist() == np.flatnonzero(flags).tolist()
    assert R._where(flags[:1, :3]).tolist() == np.flatnonzero(flags[:1, :3]).tolist()


def test_a_few_tiles_of_many_do_not_end_the_folded_bound(monkeypatch):
    """The first tile knows only poor scores, so many pairs of the next reach its bar: that tile meets
    whole rows, the tiles behind it the folded ones."""
    monkeypatch.setattr(R, "TILE", 256)
    monkeypatch.setattr(R, "ROWS", 60)
    rng = np.random.default_rng(8)
    Q = (rng.random((60, 128)) < 0.1) * rng.integers(2, 6, size=(60, 128)).astype(float)
    Q[:, 0], Q[:, 127] = 1, 0
    C = Q[rng.integers(0, 60, 3000)] + (rng.random((3000, 128)) < 0.01)
    C[:256, :127], C[:256, 127] = 0, 1 + np.arange(256) / 256
    kept, real = [], R._Folded
    monkeypatch.setattr(R, "_Folded", lambda X: kept.append(real(X)) or kept[-1])
    got = _one_cell(Q, C, 2)
    for i, q in enumerate(Q):                      # scores of whole numbers are exact
        s = C @ q
        assert got[i] == [(j, s[j]) for j in sorted(range(len(C)), key=lambda j: (-s[j], j))[:2]], i
    assert kept[0].many >= 1 and kept[0].few >= 8   # of 11 tiles; 0 before: the batch went back to whole rows
    for n in (1, 63, 64, 65, 5000):
        for share in (0.0, 0.01, 1.0):
            flags = rng.random(n) < share
            assert R._where(flags).tolist() == np.flatnonzero(flags).tolist()


def test_sizes_make_no_vector_and_single_rows_are_not_compared(spark, tmp_path):
    """Rows are counted without their vectors; of a block only rows with another's print are compared."""
    import pickle

    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, DoubleType
    made = tmp_path / "made"
    made.mkdir()

    def vector(i):
        (made / f"{i}").touch()
        return None if i == 7 else [float(i), 1.0, 2.0]
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("case_id"), F.udf(vector, ArrayType(DoubleType()))("id").alias("vec"))
    assert R._sizes(rows.selectExpr("case_id as qid", "vec as qvec"), rows) == (400, 400, 3)
    assert len(list(made.iterdir())) <= 200        # of the first partitions; all 400 before
    late = rows.filter("case_id >= 7 and case_id < 20").coalesce(1)        # the first vector is null
    assert R._sizes(late.selectExpr("case_id as qid", "vec as qvec"), late) == (13, 13, 3)
    assert R._sizes(rows.selectExpr("case_id as qid", "vec as qvec").limit(0), rows.limit(0)) == (0, 0, 0)

    X = np.zeros((60, 5))
    X[:, 0], X[:, 1] = 1, np.arange(60)
    X[10:20] = X[10]
    X[30:33] = 0
    row, at = np.nonzero(X)
    ids = np.random.default_rng(1).permutation(60)
    v = R._Vectors([pickle.dumps((ids, 5, np.bincount(row, minlength=60).astype(np.int32), at.astype(np.int32), X[row, at]), 5)])
    single, alike = v.by_print()
    assert alike.tolist() == [*range(10, 20), *range(30, 33)] and len(single) == 47
    kept = set(v.needed(2).tolist())
    assert kept == set(single) | {10 + int(i) for i in np.argsort(ids[10:20])[:2]} | {30 + int(i) for i in np.argsort(ids[30:33])[:2]}
