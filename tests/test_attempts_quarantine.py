"""Streaming state over judge attempts (S1, N8) and the quarantine of bad rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.operators import judge as J
from supportflow.operators import quarantine as QU
from supportflow.streaming import attempts as AT

SCHEMA = "id long, attempt int, raw string, at timestamp"


def arrivals(seed, n=60):
    rng = random.Random(seed)
    rows = [(i, a, rng.choice(["score: 4", "no idea", "3", "", None, "5/5"]), i * 60 + a) for i in range(n) for a in range(1, rng.randint(2, 5))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, attempt int, raw string, s long").select(
        "id", "attempt", "raw", F.timestamp_seconds("s").alias("at"))


def test_stopped_and_started_again_equals_the_batch(spark, tmp_path):
    rows = arrivals(1)
    cut = [rows[:50], rows[50:60] + rows[:20], rows[60:] + rows[40:70]]             # replayed attempts among them
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, part in enumerate(cut):
        frame(spark, part).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        AT.run(stream, out, state)                                                     # a new query on the same folders
        so_far = sorted({r for p in cut[:k + 1] for r in p}, key=str)
        want = J.retry_first_success(J.score_one(frame(spark, so_far))).select("id", "llm_overall", "attempts")
        got = AT.latest(spark, out)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_idle_ids_are_forgotten(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, part in enumerate([[(1, 1, "no", 100)], [(2, 1, "4", 10_000)], [(3, 1, "4", 20_000)], [(4, 1, "4", 30_000)]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        AT.run(spark.readStream.schema(SCHEMA).parquet(source), out, state, delay="1 second", idle_ms=1000)
    rows = AT.latest(spark, out)
    assert sorted(map(tuple, rows.collect())) == [(1, None, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1)]


def test_ids_share_a_bucket_and_keep_their_own_state(spark, tmp_path, monkeypatch):
    """F16: a state per bucket, not per id (a null id included); the texts are scored before the shuffle."""
    monkeypatch.setattr(AT, "BUCKETS", 3)
    rows = [(i if i else None, a, raw, 100 * a + k) for k, (i, a, raw) in enumerate(
        [(1, 2, "4"), (2, 1, "no"), (None, 2, "3"), (3, 1, "5"), (1, 1, "2"), (2, 2, None), (2, 3, "1"), (None, 1, "no"), (3, 2, "4")])]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows[:4], rows[2:7], rows[5:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        AT.run(spark.readStream.schema(SCHEMA).parquet(source), out, state)
    want = J.retry_first_success(J.score_one(frame(spark, rows))).select("id", "llm_overall", "attempts")
    assert sorted(map(tuple, AT.latest(spark, out).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_an_idle_id_leaves_a_live_bucket(spark):
    held, changed = AT._merge(np.zeros(0, AT.HELD), np.array([7, 5, 7]), np.array([2.0, 1, 1]), np.array([3.0, np.nan, 4]), 50)
    assert not len(held) and changed.tolist() == [(5, 0, 0, 1, 50), (7, 1, 4, 2, 50)]
    held, changed = AT._merge(changed, np.array([7, 6]), np.array([np.nan, 3]), np.array([5.0, 2]), 90)
    assert held.tolist() == [(5, 0, 0, 1, 50)] and changed.tolist() == [(6, 3, 2, 1, 90), (7, 1, 4, 3, 90)]


LINES = ['1,good text', 'abc,bad id', ',no id', '4,', '5,too,many,columns', '6,"quoted\ntext"', 'x7,', '8,   ', '9,fine']


def test_four_causes_all_kept_and_counted(spark):
    records = spark.createDataFrame([(x,) for x in LINES], "record string")
    good, bad = QU.split(QU.typed(records, QU.MESSAGE), QU.message_checks())
    assert sorted(r["tweet_id"] for r in good.collect()) == [1, 6, 9]
    assert good.count() + bad.count() == len(LINES)
    got = {r["record"]: r["reasons"] for r in bad.collect()}
    assert got["abc,bad id"] == ["unreadable_id"] and got[",no id"] == ["missing_id"] and got["4,"] == ["missing_text"]
    assert got["5,too,many,columns"] == ["corrupt_record"] and got["x7,"] == ["unreadable_id", "missing_text"]
    counts = {r["reason"]: r["n"] for r in QU.report(bad).collect()}
    assert counts == {"unreadable_id": 2, "missing_id": 1, "missing_text": 3, "corrupt_record": 1}


def test_null_checks_fail_and_no_check_passes_all(spark):
    d = spark.createDataFrame([(1,), (None,)], "x int")
    good, bad = QU.split(d, {"small": F.col("x") < 5})
    assert good.count() == 1 and bad.first()["reasons"] == ["small"]
    assert QU.split(d, {})[0].count() == 2 and QU.split(d.limit(0), {"small": F.col("x") < 5})[1].count() == 0


def test_sink_keeps_the_steps_apart(spark, tmp_path):
    sink = QU.Sink(spark, str(tmp_path / "errors"))
    _, a = QU.split(spark.createDataFrame([(1, None), (2, "x")], "id int, t string"), {"missing": F.col("t").isNotNull()})
    _, b = QU.split(spark.createDataFrame([(9.5,)], "v double"), {"negative": F.col("v") < 0})
    sink.put("read", a)
    sink.put("score", b)
    sink.put("read", a)                                        # a rerun replaces its own rows
    rows = sorted((r["step"], r["row"], tuple(r["reasons"])) for r in sink.read().collect())
    assert rows == [("read", '{"id":1}', ("missing",)), ("score", '{"v":9.5}', ("negative",))]


def test_typed_reads_every_type(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.BooleanType()), T.StructField("c", T.DoubleType())])
    rows = QU.typed(spark.createDataFrame([("1,true,2.5",), ("x,maybe,1e",), (",,",)], "record string"), schema).collect()
    assert [(r["a"], r["b"], r["c"], r["_unread"]) for r in rows] == [(1, True, 2.5, []), (None, None, None, ["a", "b", "c"]), (None, None, None, [])]


@pytest.mark.parametrize("raw,reply,codes", [(None, None, ["no_response"]), ("x", None, ["rejected_reply"]), ("x", "y", [])])
def test_response_checks(spark, raw, reply, codes):
    d = spark.createDataFrame([(raw, reply)], "raw string, reply string")
    assert QU.with_reasons(d, QU.response_checks()).first()["reasons"] == codes
