"""Conversation roots (D2) and hold-out joins (C3-C5) on literal edge rows."""

from pyspark.sql import functions as F

from supportflow.operators import threads as TH


def _brute_roots(parent: dict) -> dict:
    """Documented meaning: follow parents until none, or a parent outside the table (that
    id is the root); on a cycle the smallest id on the cycle."""
    out = {}
    for start in parent:
        path, seen, cur = [], set(), start
        while cur in parent and parent[cur] is not None and cur not in seen:
            seen.add(cur)
            path.append(cur)
            cur = parent[cur]
        if cur in seen:                           # closed a cycle: ids from cur onwards
            cyc = path[path.index(cur):]
            out[start] = min(cyc)
        else:
            out[start] = cur
    return out


def test_roots_edge_cases(spark):
    rows = []
    rows += [(i, None if i == 1 else str(i - 1)) for i in range(1, 301)]            # chain of 300
    rows += [(1000, "999.0"), (1001, "1000")]                                        # missing parent
    rows += [(2000, "2001"), (2001, "2000"), (1990, "2000"), (1980, "1990")]          # 2-cycle + tail
    rows += [(3000, "3000")]                                                          # self parent
    rows += [(4000, "abc"), (4001, ""), (4002, "4000.0")]                            # junk ids
    df = spark.createDataFrame(rows, "tweet_id long, in_response_to_tweet_id string")
    got = {r["id"]: r["root"] for r in TH.conversation_roots(TH.reply_edges(df)).collect()}

    def lenient(x):
        try:
            return int(float(x))
        except (TypeError, ValueError):
            return None
    want = _brute_roots({i: lenient(p) for i, p in rows})
    assert got == want
    assert got[300] == 1 and got[1001] == 999 and got[1980] == 2000 and got[3000] == 3000
    assert got[4002] == 4000 and got[4000] == 4000


def test_only_open_rows_move(spark):
    """The tables that ids are looked up in are read without an exchange, also with a hot root."""
    rows = [(i, None if i % 500 == 1 else i - 1) for i in range(1, 1001)]               # two long chains
    rows += [(10_000 + i, 1) for i in range(2000)] + [(20_000 + i, 10_000 + i) for i in range(300)]
    edges = spark.createDataFrame(rows, "id long, parent long")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = []
        got = {r["id"]: r["root"] for r in TH.conversation_roots(edges, rounds).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got == _brute_roots(dict(rows))
    opened = [n for n, _ in rounds]
    assert opened[0] == 3298 and opened == sorted(opened, reverse=True) and opened[1] < 0.5 * opened[0]
    for k, (_, plan) in enumerate(rounds):
        lines = plan.splitlines()
        assert sum("SortMergeJoin" in x for x in lines) == k + 2
        scans = [i for i, x in enumerate(lines) if "FileScan" in x]
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))                       # noqa: E731
        exchanged = []
        for i in scans:
            d = depth(lines[i])
            for j in range(i - 1, -1, -1):
                if depth(lines[j]) < d:
                    d = depth(lines[j])
                    if "SortMergeJoin" in lines[j]:
                        break
                    if "Exchange" in lines[j]:
                        exchanged.append(i)
                        break
        assert len(exchanged) == 1 and len(scans) == k + 3, plan               # the requests alone
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("roots_")]


def test_holdout_removes_whole_conversations(spark):
    tw = spark.createDataFrame([(1, None), (2, "1"), (3, "2"), (10, None), (11, "10"), (20, None)],
                               "tweet_id long, in_response_to_tweet_id string")
    roots = TH.conversation_roots(TH.reply_edges(tw))
    twr = TH.with_conversation_root(tw, roots)
    golden = spark.createDataFrame([(3,)], "tweet_id long")
    groots = TH.golden_roots(golden, roots)
    held = TH.held_out_tweets(twr, groots)
    assert sorted(r.tweet_id for r in held.collect()) == [1, 2, 3]
    cases = spark.createDataFrame([(1, "2"), (10, "11"), (20, "2"), (21, "22")],
                                  "customer_tweet_id long, brand_reply_id string")
    safe = TH.leakage_safe_cases(cases, held)
    assert sorted(r.customer_tweet_id for r in safe.collect()) == [10, 21]
    row_level = TH.row_level_holdout(cases, spark.createDataFrame([(10,)], "tweet_id long"))
    assert sorted(r.customer_tweet_id for r in row_level.collect()) == [1, 20, 21]
    # no held-out root survives in the safe corpus (invariant)
    assert safe.join(held.select(F.col("tweet_id").alias("customer_tweet_id")), "customer_tweet_id").count() == 0
