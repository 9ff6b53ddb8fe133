"""Registered queries on the smallest driver tables: oracle agreement and invariants.

Every registered query runs against its DuckDB oracle.
"""

import os

import pytest
from pyspark.sql import functions as F

from supportflow.plans import check
from supportflow.plans.queries import queries

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, name):
    rec = check.compare(spark, SF, [name], verbose=False)[name]
    assert "error" not in rec, rec.get("error")
    if rec["oracle"]:
        assert rec["match"], rec


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_topk_sorted_and_bounded(spark):
    hits = queries()["topk_retrieval"](spark, SF)
    bad = (hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("mr"),
                                   F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))
           .filter((F.col("n") > 5) | (F.col("mr") != F.col("n"))
                   | ~F.forall(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))),
                               lambda i: (F.col("n") == 1) | (F.col("s")[i - 1]["score"] >= F.col("s")[i]["score"]))))
    assert hits.count() > 0 and bad.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_agent_keeps_rows_and_one_rule_each(spark):
    qs = queries()
    out = qs["agent_batch"](spark, SF)
    n_msgs = (spark.read.parquet(f"{SF}/conversations.parquet").filter(F.col("role") == "user").count())
    assert out.count() == n_msgs == out.select("tweet_id").distinct().count()
    dec = qs["escalation_decisions"](spark, SF)
    assert dec.filter(F.col("rule_id").isNull() | F.col("decision").isNull()).count() == 0
    assert dec.count() == dec.select("tweet_id").distinct().count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_equals_batch(spark):
    """The file stream gives the same rows as the batch scoring of the same table."""
    from supportflow.operators import lexicon as L
    from supportflow.operators import policy as P
    from supportflow.sources.adapters import tweet_id
    from supportflow.streaming import scoring as ST
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    msgs = (conv.filter(F.col("role") == "user")
            .select(tweet_id().alias("tweet_id"), "text"))
    batch = ST.score_messages(msgs, L.STAND_IN, P.stand_in_v2())
    stream = queries()["stream_scoring"](spark, SF)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.select(*batch.columns).collect()))


@pytest.mark.skipif(not os.path.isdir(SF01), reason="driver tables not present")
def test_every_real_label_and_rule_fires(spark):
    from supportflow.operators import lexicon as L
    from supportflow.operators import policy as P
    qs = queries()
    seen = qs["classify_real"](spark, SF01).agg(*[F.collect_set(c).alias(c) for c in ("intent", "weak_label", "relabelled")]).first()
    assert all(set(x) == set(L.LABEL_ORDER) for x in seen)
    for name, policy in (("escalation_real", P.policy_v2()), ("escalation_real_v1", P.policy_v1())):
        fired = {r.rule_id for r in qs[name](spark, SF01).select("rule_id").distinct().collect()}
        assert fired == {r.rule_id for r in policy.rules}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_one_case_corpus_per_query(spark, monkeypatch):
    from supportflow.operators import cases as C
    built = []
    real = C.build_cases
    monkeypatch.setattr(C, "build_cases", lambda *a, **k: built.append(1) or real(*a, **k))
    for name in ("agent_batch", "evidence_strings", "topk_safe"):
        built.clear()
        queries()[name](spark, SF)
        assert len(built) == 1, name


def _conversations(spark):
    rows = [(c, t, r, f"this die thble message {c} from {t}") for c in range(6) for t, r in enumerate(("user", "assistant", "user"))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("name,batch", [("stream_scoring", None), ("stream_agent", "agent_batch")])
def test_streams_read_a_table_of_many_files(spark, tmp_path, name, batch):
    """The table is a folder of part files; the stream saw none of them before."""
    _conversations(spark).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries()[name](spark, str(tmp_path))
    assert got.count() == 12
    if batch:
        want = queries()[batch](spark, str(tmp_path)).drop("reply", "evidence")      # equal scores, in any order
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
