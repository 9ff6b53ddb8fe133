"""Sources (A1-A4, A6) and the case corpus (B3-B7, C1, C1x, C2, E1) on literal edge rows."""

import pytest
from pyspark.errors import AnalysisException

from supportflow.functions.text import lenient_id, py_strip
from supportflow.operators import cases as C
from supportflow.sources import tables as TB

TWEET_COLS = "tweet_id long, author_id string, inbound boolean, created_at string, text string, " \
             "response_tweet_id string, in_response_to_tweet_id string"


def test_csv_quoted_newlines_and_projection(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        'tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id,extra\n'
        '1,user_1,true,x,"line one\nline two",2,,a\n'
        '2,Brand,false,x,"say ""hi""",,1.0,b\n'
        '3,user_2,true,x,plain,,,c\n', encoding="utf-8")
    schema = TB.RAW_TWEETS                        # 7 columns: the eighth is not read
    full = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    assert full.count() == 3                       # a reader without multiLine sees 4 records
    df = TB.read_csv(spark, str(path), schema, columns=["tweet_id", "text"])
    rows = {r.tweet_id: r.text for r in df.collect()}
    assert rows == {1: "line one\nline two", 2: 'say "hi"', 3: "plain"}


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        TB.read_table(spark, str(tmp_path), "nope").count()


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    assert TB.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="reply"):
        TB.require_columns(df, ["id", "reply"])


def test_write_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, text string")
    TB.write_table(df, str(tmp_path / "p"))
    TB.write_table(df, str(tmp_path / "p"))        # overwrite, not append
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())
    TB.write_table(df, str(tmp_path / "c"), fmt="csv")
    back = TB.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)


def test_lenient_id(spark):
    df = spark.createDataFrame([("267330.0",), ("267330",), ("abc",), ("",), (None,), (" 12 ",)], "x string")
    got = [r.v for r in df.select(lenient_id("x").alias("v")).collect()]
    assert got == [267330, 267330, None, None, None, 12]


def test_py_strip_unicode_blanks(spark):
    df = spark.createDataFrame([("  hi  \n",), ("\t\t",), (None,)], "x string")
    assert [r.v for r in df.select(py_strip("x").alias("v")).collect()] == ["hi", "", None]


def _tweets(spark):
    rows = [
        # customer messages
        (10, "u1", True, "t", "  my phone  ", "20", None),
        (11, "u2", True, "t", None, "21", None),            # null text: dropped
        (12, "u3", True, "t", "   ", "22", None),           # blank after strip: dropped
        (13, "u4", True, "t", "two replies", "23,24", None),  # comma list: C1x only
        (14, "u5", True, "t", "no reply match", "99", None),  # reply id absent
        (15, "u6", True, "t", "not answered", None, None),
        # brand replies
        (20, "Brand", False, "t", "we can help", None, "10.0"),   # float parent id
        (21, "Brand", False, "t", "hello", None, "11"),
        (22, "Brand", False, "t", "hi", None, "12"),
        (23, "Brand", False, "t", "first", None, "13"),
        (24, "Brand", False, "t", "second", None, "13"),
        (25, "Brand", False, "t", "stray", None, "abc"),        # non-numeric parent
        (26, "Other", False, "t", "not the brand", None, "15"),
        (99, "Brand", True, "t", "inbound brand row", None, "14"),
    ]
    return spark.createDataFrame(rows, TWEET_COLS)


def test_brand_replies_and_linked(spark):
    tw = _tweets(spark)
    assert sorted(r.tweet_id for r in C.brand_replies(tw, "Brand").collect()) == [20, 21, 22, 23, 24, 25]
    linked = sorted(r.tweet_id for r in C.linked_messages(tw, "Brand").collect())
    assert linked == [10, 11, 12, 13]                  # 14 only has an inbound 'Brand' row, 15 another author


def test_build_cases_edges(spark):
    tw = _tweets(spark)
    linked = C.linked_messages(tw, "Brand")
    got = {r.customer_tweet_id: (r.customer_text, r.brand_reply_id, r.brand_reply)
           for r in C.build_cases(linked, tw, "Brand").collect()}
    assert got == {10: ("my phone", "20", "we can help")}
    got_x = {r.customer_tweet_id: (r.brand_reply_id, r.brand_reply)
             for r in C.build_cases(linked, tw, "Brand", explode_ids=True).collect()}
    assert got_x == {10: ("20", "we can help"), 13: ("23", "first")}   # keep-first by reply id


def test_first_reply_of_a_list_is_kept(spark):
    rows = [(1, "u", True, "t", "q", "99,100", None), (2, "u", True, "t", "q", "100,99", None),
            (99, "Brand", False, "t", "reply 99", None, "1"), (100, "Brand", False, "t", "reply 100", None, "2")]
    tw = spark.createDataFrame(rows, TWEET_COLS)
    got = {r.customer_tweet_id: r.brand_reply_id
           for r in C.build_cases(C.linked_messages(tw, "Brand"), tw, "Brand", explode_ids=True).collect()}
    assert got == {1: "99", 2: "100"}


def test_long_conversations_keep_their_ids_apart(spark):
    from supportflow.operators import threads as TH
    from supportflow.sources.adapters import customer_messages, tweets_from_conversations
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in (1, 2) for t in range(1500)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tw = tweets_from_conversations(conv)
    assert tw.select("tweet_id").distinct().count() == 3000
    roots = {r.root for r in TH.conversation_roots(TH.reply_edges(tw)).collect()}
    assert roots == {1 << 20, 2 << 20}
    with pytest.raises(Exception, match="out of range"):
        customer_messages(spark.createDataFrame([(1, 1 << 20, "user", "x")], conv.schema)).collect()


def test_keep_first_heavy_key(spark):
    # one key holds most rows; the result is the smallest by the order columns
    rows = [(1, i % 97, f"r{i}") for i in range(5000)] + [(2, 5, "b"), (2, 5, "a")]
    df = spark.createDataFrame(rows, "k long, o long, v string").repartition(8)
    got = {r.k: (r.o, r.v) for r in C.keep_first(df, "k", ["o"]).collect()}
    assert got == {1: (0, "r0"), 2: (5, "a")}


def test_explode_reply_ids(spark):
    df = spark.createDataFrame([(1, "5, 6"), (2, None), (3, "7")], "id long, brand_reply_id string")
    got = sorted((r.id, r.brand_reply_id) for r in C.explode_reply_ids(df).collect())
    assert got == [(1, "5"), (1, "6"), (2, None), (3, "7")]


def test_corpus_audit_counts(spark):
    tw = _tweets(spark)
    cases = C.build_cases(C.linked_messages(tw, "Brand"), tw, "Brand")
    got = {r.stage: r.rows for r in C.corpus_audit(tw, "Brand", cases).collect()}
    assert got == {"total_tweets": 14, "inbound_tweets": 7, "brand_replies": 6,
                   "linked_messages": 4, "cases": 1}
