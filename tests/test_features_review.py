"""TF-IDF (L1) and the majority baseline (L4) against brute force; review operators."""

import datetime as dt
import math
from collections import Counter

import pytest
import regex

from pyspark.sql import functions as F

from supportflow.operators import features as FT
from supportflow.operators import models as MD
from supportflow.operators import review as RV

DOCS = [
    (1, "The cat sat on the mat. The cat!"),
    (2, "A dog sat; the dog barked"),
    (3, "Über café — the Café sat"),
    (4, None),
    (5, "x y z"),                                   # no token of two characters
    (6, "cat sat cat sat cat sat"),
]


def _brute_tfidf(docs, min_df, max_features, sublinear):
    tok = {}
    for i, t in docs:
        u = regex.findall(r"[\p{L}\p{N}_]{2,}", (t or "").lower())
        tok[i] = u + [f"{a} {b}" for a, b in zip(u, u[1:])]
    n = len(docs)
    df, total = Counter(), Counter()
    for terms in tok.values():
        df.update(set(terms))
        total.update(terms)
    keep = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in keep}
    out = {}
    for i, terms in tok.items():
        c = Counter(x for x in terms if x in idf)
        w = {t: ((1 + math.log(v)) if sublinear else v) * idf[t] for t, v in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("min_df,max_features,sublinear", [(2, 100000, True), (1, 10000, False), (1, 4, True)])
def test_tfidf_matches_brute_force(spark, min_df, max_features, sublinear):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight
           for r in FT.tfidf(docs, min_df=min_df, max_features=max_features, sublinear=sublinear).collect()}
    want = _brute_tfidf(DOCS, min_df, max_features, sublinear)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_terms_keep_whole_long_text(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert FT.term_stats(docs).count() == 20000 + 19999


def test_large_vocabulary_is_joined(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    sent = {(r.doc_id, r.term): r.weight for r in FT.tfidf(docs).collect()}
    monkeypatch.setattr(FT, "VOCABULARY_ROWS", 1)
    assert {(r.doc_id, r.term): pytest.approx(r.weight) for r in FT.tfidf(docs).collect()} == sent


def test_majority_baseline_tie_goes_to_smallest(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a")], "id long, y string")
    test = spark.createDataFrame([(9, "a"), (10, "c")], "id long, y string")
    got = {r.id: r.prediction for r in MD.majority_baseline(train, test, "y").collect()}
    assert got == {9: "a", 10: "a"}


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(8)], "id long, y int")
    w = {r.y: r.w for r in MD.class_weights(df, "y").select("y", "w").distinct().collect()}
    assert w == pytest.approx({0: 8 / (2 * 6), 1: 8 / (2 * 2)})


def test_review_queue_and_progress(spark):
    items = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "doc_id long, text string")
    reviewed = spark.createDataFrame([(2,), (2,), (7,)], "doc_id long")
    q = RV.review_queue(items, reviewed, "doc_id", F.lit("general_support"))
    assert sorted(r.doc_id for r in q.collect()) == [1, 3]
    assert [r.doc_id for r in RV.next_items(q, "doc_id", 1).collect()] == [1]
    p = RV.review_progress(items, reviewed, "doc_id").first()
    assert (p.total, p.reviewed, p.remaining, p.progress) == (3, 1, 2, round(1 / 3, 4))


def test_apply_reviews_latest_wins(spark):
    t0 = dt.datetime(2024, 1, 1)
    labels = spark.createDataFrame(
        [(1, "app_media_issue", False, "", False), (2, "general_support", True, "old", None)],
        "doc_id long, intent string, escalate boolean, escalation_reason string, reviewed boolean")
    decisions = spark.createDataFrame(
        [(1, t0, "battery_issue", True, "hot"), (1, t0 + dt.timedelta(hours=1), "account_purchase_issue", False, "ignored")],
        "doc_id long, decided_at timestamp, intent string, escalate boolean, escalation_reason string")
    got = {r.doc_id: (r.intent, r.escalate, r.escalation_reason, r.reviewed)
           for r in RV.apply_reviews(labels, decisions, "doc_id").collect()}
    assert got[1] == ("account_purchase_issue", False, "", True)          # reason blank when not escalated
    assert got[2] == ("general_support", True, "old", False)     # untouched, null reviewed -> False


def test_append_ratings_keeps_latest(spark):
    old = spark.createDataFrame([(1, 3, 1), (2, 4, 1)], "doc_id long, rating int, rated_at long")
    new = spark.createDataFrame([(1, 5, 2), (3, 2, 2)], "doc_id long, rating int, rated_at long")
    got = {r.doc_id: r.rating for r in RV.append_ratings(old, new, "doc_id", "rated_at").collect()}
    assert got == {1: 5, 2: 4, 3: 2}


def test_defaults_and_flags(spark):
    df = spark.createDataFrame([(1, None), (2, "ESCALATE"), (3, "AUTO-HANDLE")], "id long, decision string")
    out = RV.with_default(RV.with_default(df, "decision", "AUTO-HANDLE"), "reviewed", False)
    rows = {r.id: (r.decision, r.reviewed) for r in out.collect()}
    assert rows == {1: ("AUTO-HANDLE", False), 2: ("ESCALATE", False), 3: ("AUTO-HANDLE", False)}
    flags = [r.f for r in df.orderBy("id").select(RV.decision_flag("decision").alias("f")).collect()]
    assert flags == [False, True, False]


def test_tfidf_logreg_separable(spark):
    rows = [(i, f"screen broken crack glass {i}", 1) for i in range(12)] + \
           [(100 + i, f"battery drains charger slow {i}", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    train = df.filter(F.col("doc_id") % 4 != 0)
    test = df.filter(F.col("doc_id") % 4 == 0)
    got = {r.doc_id: (r.y, r.prediction) for r in MD.tfidf_logreg(train, test, "y", max_iter=50).collect()}
    assert len(got) == test.count() and all(y == p for y, p in got.values())


def test_error_split(spark):
    df = spark.createDataFrame([(1, "ERROR"), (2, "app_media_issue"), (3, None), (4, "ERROR")], "id long, intent string")
    assert {r.status: r.n for r in RV.error_split(df).collect()} == {"error": 2, "valid": 2}
    assert sorted(r.id for r in RV.valid_rows(df).collect()) == [2, 3]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 50])
def test_top_terms_exact_with_ties(spark, n):
    rows = [("a", 5), ("b", 3), ("c", 3), ("d", 3), ("e", 1), ("f", 1), ("g", 9)]
    stats = spark.createDataFrame(rows, "term string, total long").repartition(3)
    got = sorted(r.term for r in FT.top_terms(stats, n).collect())
    want = sorted(t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
    assert got == want
