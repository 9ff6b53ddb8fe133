"""Conversation graph: reply edges and conversation roots.

Root rule: follow parents until a message has no parent, or its parent is not in the
table (then that missing parent id is the root). On a cycle the root is the smallest id
on the cycle.

Roots come from pointer doubling: every open row holds ``nxt`` (first its parent) and
each round replaces it with its partner's ``nxt``, so a chain of depth ``d`` resolves in
``ceil(log2 d)`` rounds. ``mn`` (smallest id on the covered path) resolves cycles: after
``ceil(log2 N) + 1`` rounds an open row's ``nxt`` lies on its cycle, and that row's ``mn`` is
the cycle's smallest id.

Only open rows move. Each round writes its rows once, bucketed by ``id``, into the shared
checkpoint folder: those it finished (never written again) and those still open. The rounds
after it look ids up in these tables where they lie: the lookup side has no exchange. What is
looked up is the distinct ``nxt`` of the open rows, combined before the shuffle, so a root that a
third of all rows share is one request; its answer meets the open rows in a plain join, whose
skew AQE splits. A lost executor only costs the current round.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.functions.text import lenient_id
from supportflow.operators.reduction import anti_join
from supportflow.session import BROADCAST_ROWS, ensure_checkpoint_dir, scratch_path


def reply_edges(tweets: DataFrame, id_col: str = "tweet_id",
                parent_col: str = "in_response_to_tweet_id") -> DataFrame:
    """``id, parent``; blank, 'nan', 'None' or non-numeric parents become null.

    One row per id (a duplicated id keeps its smallest parent).
    """
    return (tweets.select(F.col(id_col).cast("long").alias("id"), lenient_id(parent_col).alias("parent"))
            .groupBy("id").agg(F.min("parent").alias("parent")))


def _bucketed(rows: DataFrame, n: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` written once, bucketed by ``id``: as a bucketed table (its name goes to ``names``)
    and as plain files, which outlive the table's name."""
    spark = rows.sparkSession
    name, path = f"roots_{uuid.uuid4().hex}", scratch_path(spark, "roots")
    rows.repartition(n, "id").write.format("parquet").bucketBy(n, "id").option("path", path).saveAsTable(name)
    names.append(name)
    return spark.table(name), spark.read.schema(rows.schema).parquet(path)


def _answers(opened: DataFrame, tables: list[DataFrame], n: int) -> DataFrame:
    """``asked, p_nxt, p_done, p_mn``: the row of every id that an open row points to. An id is in
    one of the tables; each is read where it lies."""
    out = opened.select(F.col("nxt").alias("asked")).distinct().repartition(n, "asked")
    for k, t in enumerate(tables):
        row = t.select(F.col("id").alias(f"id{k}"), F.struct("nxt", "done", "mn").alias(f"r{k}"))
        out = out.join(row, F.col("asked") == F.col(f"id{k}"), "left").drop(f"id{k}")
    row = F.coalesce(*[F.col(f"r{k}") for k in range(len(tables))])
    return out.select("asked", row["nxt"].alias("p_nxt"), row["done"].alias("p_done"), row["mn"].alias("p_mn"))


def conversation_roots(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """``id, root`` for every id of ``edges(id, parent)``. ``rounds`` receives the open rows and
    the lookup's plan of each round."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    n, names = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    try:
        known = edges.select(F.col("id").alias("pid"))
        start, files = _bucketed(edges.join(known, edges["parent"] == known["pid"], "left")
                             .select("id", F.coalesce("parent", "id").alias("nxt"),
                                     (F.col("parent").isNull() | F.col("pid").isNull()).alias("done"),
                                     F.least("id", F.coalesce("parent", "id")).alias("mn")), n, names)
        finished, done, opened = [start.filter("done")], [files.filter("done")], start.filter("NOT done")
        left = opened.count()                                # a chain or cycle holds open rows only
        for _ in range(max(1, left).bit_length() + 1):
            if not left:
                break
            answers = _answers(opened, [*finished, opened], n)
            if rounds is not None:
                rounds.append((left, answers._jdf.queryExecution().executedPlan().toString()))
            moved = (opened.join(answers, F.col("nxt") == F.col("asked"), "left")
                     .select("id", F.coalesce("p_nxt", "nxt").alias("nxt"), F.coalesce("p_done", F.lit(True)).alias("done"),
                             F.least("mn", F.coalesce("p_mn", "mn")).alias("mn")))
            table, files = _bucketed(moved, n, names)
            finished, done = [*finished, table.filter("done")], [*done, files.filter("done")]
            opened, still = table.filter("NOT done"), files.filter("NOT done")
            left = opened.count()
        out = [d.select("id", F.col("nxt").alias("root")) for d in done]
        if left:
            # what is open now lies on a cycle or leads into one: nxt is on the cycle
            cycle = still.select(F.col("id").alias("c_id"), F.col("mn").alias("root"))
            out.append(still.join(cycle, F.col("nxt") == F.col("c_id"), "left").select("id", "root"))
        return reduce(DataFrame.unionByName, out)
    finally:
        for name in names:                                   # the files stay until the application ends
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_conversation_root(tweets: DataFrame, roots: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """D3: ``conversation_root`` column for every tweet."""
    return tweets.join(roots.select(F.col("id").alias(id_col), F.col("root").alias("conversation_root")),
                       id_col, "left")


def golden_roots(golden: DataFrame, roots: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """Distinct conversation roots of the golden ids (an id absent from the tweet
    table is its own root)."""
    g = golden.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull())
    return (g.join(roots, "id", "left")
            .select(F.coalesce("root", "id").alias("conversation_root")).distinct())


def held_out_tweets(tweets_with_root: DataFrame, groots: DataFrame) -> DataFrame:
    """Every tweet of a held-out conversation (left-semi on the root)."""
    return tweets_with_root.join(groots, "conversation_root", "left_semi")


def leakage_safe_cases(cases: DataFrame, held_out: DataFrame, id_col: str = "tweet_id", reduced: bool = False,
                       broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """C4: drop a case if its customer id or its reply id is held out (two left-anti joins).
    ``reduced``: with more than ``broadcast_rows`` held-out ids, a bit set of them lets cases that
    are certainly not held out pass without a shuffle."""
    if reduced:
        held = held_out.select(F.col(id_col).cast("long").alias("__hid"), F.col(id_col).cast("string").alias("__sid"))
        return anti_join(anti_join(cases, held, "customer_tweet_id", "__hid", broadcast_rows), held,
                         "brand_reply_id", "__sid", broadcast_rows)
    ids = held_out.select(F.col(id_col).cast("long").alias("__hid"))
    sids = held_out.select(F.col(id_col).cast("string").alias("__sid"))
    return (cases.join(ids, cases["customer_tweet_id"] == ids["__hid"], "left_anti")
            .join(sids, cases["brand_reply_id"] == sids["__sid"], "left_anti"))


def row_level_holdout(cases: DataFrame, golden: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """Drop cases whose customer message is itself a golden id."""
    g = golden.select(F.col(id_col).cast("long").alias("__gid")).distinct()
    return cases.join(g, cases["customer_tweet_id"] == g["__gid"], "left_anti")


def holdout_audit(tweets_with_root: DataFrame, groots: DataFrame, held_out: DataFrame,
                  cases: DataFrame, safe: DataFrame) -> DataFrame:
    """D5 audit: one row per stage (``stage, rows``); an empty safe corpus is an error to
    be checked by the caller on this table, not by collecting the corpus."""
    parts = [
        tweets_with_root.agg(F.lit("tweets").alias("stage"), F.count(F.lit(1)).alias("rows")),
        groots.agg(F.lit("held_out_conversations").alias("stage"), F.count(F.lit(1)).alias("rows")),
        held_out.agg(F.lit("held_out_tweets").alias("stage"), F.count(F.lit(1)).alias("rows")),
        cases.agg(F.lit("cases").alias("stage"), F.count(F.lit(1)).alias("rows")),
        safe.agg(F.lit("leakage_safe_cases").alias("stage"), F.count(F.lit(1)).alias("rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
