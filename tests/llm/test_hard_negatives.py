"""Hard-negative mining against brute force: many small parts, ties, copies, awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportflow.llm import hard_negatives
from supportflow.plans import check

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, label string, vec array<long>, anchor boolean"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    dim = max((len(r[2]) for r in rows if r[2] is not None), default=0)
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    vec = [list(r[2]) + [0] * (dim - len(r[2])) for r in rows]
    order = lambda s, i: (-s, rows[i][0] is None, rows[i][0] or 0)     # noqa: E731
    out = []
    for a, r in enumerate(rows):
        if not r[3]:
            continue
        scored = [(sum(x * y for x, y in zip(vec[a], vec[i])), i) for i in range(len(rows)) if i != a]
        same = sorted((x for x in scored if rows[x[1]][1] == r[1]), key=lambda x: order(*x))[:positives]
        for s, p in same:
            fit = sorted((x for x in scored if rows[x[1]][1] != r[1] and low * s <= 100 * x[0] <= high * s), key=lambda x: order(*x))
            out += [(r[0], rows[p][0], k + 1, rows[i][0], s, t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def table(n, seed, dim=6, spread=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    out = []
    for i in range(n):
        c = int(rng.integers(4))
        v = (centre[c] + rng.normal(size=dim) * .3) * spread * rng.choice([.2, 1, 1, 3])
        label = "hot" if rng.random() < .4 else f"l{rng.integers(4)}"
        out.append((i, label, [int(x) for x in v], i % 9 == 0))
    return out


def test_query_matches_oracle(spark):
    from supportflow.llm.oracle import oracle_sql
    from supportflow.llm.queries import queries
    out = queries()["op13_hard_negatives"](spark, SF)
    res = check.duck(SF).execute(oracle_sql()["op13_hard_negatives"])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(out.columns)
    assert check._rows(out.columns, [tuple(r) for r in out.collect()]) == check._rows(cols, res.fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_many_small_parts_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * 6 * 20)        # parts of 20 rows
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)                     # and copies of them
    rows = table(320, seed)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_ties_copies_and_awkward_rows(spark):
    copies = [(i, "a" if i % 2 else "b", [3, 4], i < 2) for i in range(12)]
    rows = copies + [(50, "b", [2, 3], False), (51, "b", [2, 3], False), (51, "b", [2, 3], False), (None, "b", [2, 3], False),
                     (60, None, [9, 9], True), (61, "a", None, True), (62, "a", [1, None], True), (63, "c", [0, 0], True),
                     (64, "c", [0, 0], False), (65, "c", [], True), (66, "z", [5], True), (None, "a", [2, 2], True),
                     (70, "d", [-3, -4], True), (71, "d", [3, 4], False), (72, "a", [3, 4, 0], None)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows + copies) == brute(rows + copies)            # repeated rows and anchors
    assert mined(spark, []) == []
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "a", "w", "list", "score", "rank")})
    assert sorted(map(tuple, hard_negatives.mine(wide).collect()), key=str) == brute(rows)


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_raise(spark):
    big = 1 << 28
    rows = [(0, "a", [big + 1, 1], True), (1, "a", [big + 1, 0], False), (2, "b", [(big + 1) * 3 // 4, 7], False),
            (3, "b", [(big + 1) * 3 // 4, 6], False)]
    assert mined(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, "ab"[i % 2], [1 << 33, 1], i == 0) for i in range(4)])


def test_no_row_above_the_threshold_is_pruned():
    rng = np.random.default_rng(7)
    pruned = 0
    for _ in range(60):
        v = (rng.normal(size=(300, 5)) * rng.choice([3, 30, 300], size=(300, 1))).astype(np.int64)
        lists = hard_negatives.CoordinateLists(v)
        q = (rng.normal(size=5) * 50).astype(np.int64)
        length = math.sqrt((q.astype(float) ** 2).sum())
        scores = v @ q
        for least in np.quantile(scores, [0, .3, .9, .99, 1]).astype(int).tolist() + [0, 1, -5]:
            got = lists.candidates(q, length, float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(got.tolist()) and len(set(got.tolist())) == len(got)
            pruned += 300 - len(got)
    assert pruned > 10_000


def test_quantised_drops_null_and_non_finite(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],), ([],)]
    d = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in d.select(hard_negatives.quantised("v")).collect()] == [[128, -1], None, None, None, None, []]
