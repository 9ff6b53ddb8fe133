"""Metrics (F8-F12), positions, sampling and the stratified split (G1-G5) against brute force."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from supportflow.operators import metrics as M
from supportflow.operators import sampling as SM

PAIRS = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "d"), (None, "a"), ("b", None)]


def _brute_per_label(pairs):
    labels = {y for y, _ in pairs if y is not None} | {p for _, p in pairs if p is not None}
    out = {}
    for lab in labels:
        tp = sum(1 for y, p in pairs if y == lab and p == lab)
        fp = sum(1 for y, p in pairs if y != lab and p == lab)
        fn = sum(1 for y, p in pairs if y == lab and p != lab)
        sup = sum(1 for y, _ in pairs if y == lab)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        out[lab] = (tp, fp, fn, sup, prec, rec, f1)
    return out


@pytest.fixture()
def pairs_df(spark):
    return spark.createDataFrame(PAIRS, "y string, p string")


def test_per_label_and_macro(spark, pairs_df):
    want = _brute_per_label(PAIRS)
    got = {r.label: (r.tp, r.fp, r.fn, r.support, r.precision, r.recall, r.f1)
           for r in M.per_label(pairs_df, "y", "p").collect()}
    assert set(got) == set(want) == {"a", "b", "c", "d"}     # 'c' only in truth, 'd' only in prediction
    for k in want:
        assert got[k][:4] == want[k][:4]
        assert got[k][4:] == pytest.approx(want[k][4:])
    mf = M.macro_f1(pairs_df, "y", "p").first()
    assert mf.n_labels == 4
    assert mf.macro_f1 == round(sum(v[6] for v in want.values()) / 4, 4)
    assert 0.0 <= mf.macro_f1 <= 1.0


def test_accuracy(spark, pairs_df):
    r = M.accuracy(pairs_df, "y", "p").first()
    assert r.n == len(PAIRS) and r.accuracy == round(3 / 8, 4)


def test_report_rows(spark, pairs_df):
    rep = {r.label: r for r in M.classification_report(pairs_df, "y", "p").collect()}
    want = _brute_per_label(PAIRS)
    assert set(rep) == set(want) | {"accuracy", "macro avg", "weighted avg"}
    n = sum(v[3] for v in want.values())
    assert rep["accuracy"].f1 == round(3 / n, 4) and rep["accuracy"].support == n
    assert rep["weighted avg"].f1 == round(sum(v[6] * v[3] for v in want.values()) / n, 4)


def test_binary_f1_no_positives_and_null_truth(spark):
    df = spark.createDataFrame([(False, False), (None, True), (False, False)], "y boolean, p boolean")
    r = M.binary_f1(df, F.col("y"), F.col("p")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (0, 1, 0, 2, 0.0)      # null truth counts as False
    rows = {r.truth: (r.pred_false, r.pred_true) for r in M.binary_confusion(df, F.col("y"), F.col("p")).collect()}
    assert rows == {False: (2, 1), True: (0, 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "y string, p string")
    assert M.per_label(df, "y", "p").count() == 0
    assert M.accuracy(df, "y", "p").first().n == 0
    assert M.macro_f1(df, "y", "p").first().n_labels == 0


def test_confusion_pairs_keep_zeros(spark, pairs_df):
    got = {(r.true_label, r.pred_label): r.n for r in M.confusion_pairs(
        pairs_df.filter("y in ('a', 'b') and p in ('a', 'b')"), "y", "p", ["a", "b"]).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}


def test_confusion_labels_come_from_the_data(spark, pairs_df):
    got = {(r.true_label, r.pred_label): r.n for r in M.confusion_pairs(pairs_df, "y", "p").collect()}
    labels = {x for r in pairs_df.collect() for x in (r.y, r.p) if x is not None}
    assert set(got) == {(a, b) for a in labels for b in labels}
    with pytest.raises(Exception, match="outside"):
        M.confusion_pairs(pairs_df, "y", "p", ["a"]).collect()


@pytest.mark.parametrize("partitions", [4, 16])
def test_positions_beyond_the_range_sample(spark, partitions):
    """Rows and offsets must come from one partitioning, whatever else the rows hold."""
    n = 300_000
    df = spark.range(n).select((F.xxhash64("id") % 1_000_003).alias("k"), "id", F.lit("kept").alias("more"),
                               (F.col("id") * 2).alias("twice")).repartition(5)
    out = SM.with_position(df, ["k", "id"], num_partitions=partitions)
    assert out.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (n, 0, n - 1)
    pairs = out.select("pos", "k").join(out.select((F.col("pos") - 1).alias("pos"), F.col("k").alias("after")), "pos")
    assert pairs.filter("k > after").count() == 0


def test_stratified_split_of_many_rows(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 2).alias("y"), F.lit("x").alias("more"))
    got = {r.y: r.n for r in SM.stratified_split(df, "y", "id", 0.2, 42).filter("split = 'test'").groupBy("y").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 20_000, 1: 20_000}


def test_with_position_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long").repartition(7)
    got = {(r.g, r.i): r.pos for r in SM.with_position(df, ["g", "i"], num_partitions=5, start=10).collect()}
    want = {k: 10 + n for n, k in enumerate(sorted(rows))}
    assert got == want


def _md5(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


def test_seeded_sample_and_head(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, t string")
    got = [r.id for r in SM.seeded_sample(df, 10, "id", 42).collect()]
    assert sorted(got) == sorted(sorted(range(200), key=lambda i: (_md5(i, 42), i))[:10])
    assert SM.seeded_sample(df, 500, "id", 42).count() == 200            # min(n, N)
    assert [r.id for r in SM.head_n(df, 3, ["id"]).collect()] == [0, 1, 2]


def test_stratified_split_per_label(spark):
    # one label holds most rows (skew); shares are rounded per label
    rows = [(i, 0 if i < 900 else (1 if i < 990 else 2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(6)
    sp = SM.stratified_split(df, "y", "id", 0.2, 42)
    got = {}
    for r in sp.collect():
        got.setdefault(r.y, set()).add((r.id, r.split))
    for lab, n in ((0, 900), (1, 90), (2, 10)):
        ids = sorted((i for i, y in rows if y == lab), key=lambda i: (_md5(i, 42), i))
        test = set(ids[:round(n * 0.2)])
        assert got[lab] == {(i, "test" if i in test else "train") for i in ids}


def test_first_open(spark):
    df = spark.createDataFrame([(3, False), (1, True), (2, None), (4, False)], "id long, done boolean")
    assert [r.id for r in SM.first_open(df, "done", ["id"], 2).collect()] == [2, 3]
