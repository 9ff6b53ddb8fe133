"""Historical case corpus (B1-B7, C1, C1x, C2, E1-E3, F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.functions.text import lenient_id, py_strip
from supportflow.operators.reduction import semi_join
from supportflow.session import BROADCAST_ROWS


def brand_replies(tweets: DataFrame, brand: str) -> DataFrame:
    """Outbound messages written by the brand."""
    return tweets.filter((F.col("author_id") == F.lit(brand)) & ~F.col("inbound"))


def linked_messages(tweets: DataFrame, brand: str, reduced: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inbound messages the brand answered.

    Parent ids of brand replies are coerced leniently (B6), de-duplicated (E2) and used
    as the right side of a left-semi join; Spark picks broadcast or sort-merge by size.
    ``reduced``: the ids are counted, and beyond ``broadcast_rows`` of them messages without
    an answer are dropped by a bit set before the shuffle.
    """
    answered = (brand_replies(tweets, brand)
                .select(lenient_id("in_response_to_tweet_id").alias("tweet_id"))
                .filter(F.col("tweet_id").isNotNull())
                .distinct())
    inbound = tweets.filter(F.col("inbound"))
    if reduced:
        return semi_join(inbound, answered, "tweet_id", "tweet_id", broadcast_rows)
    return inbound.join(answered, "tweet_id", "left_semi")


def explode_reply_ids(df: DataFrame, col: str = "brand_reply_id") -> DataFrame:
    """C1x (extension): one row per id of a comma list in ``col`` (ids trimmed)."""
    return with_list_position(df, col).drop("__at")


def with_list_position(df: DataFrame, col: str) -> DataFrame:
    """C1x with ``__at``, the id's place in its list."""
    rest = [c for c in df.columns if c != col]
    return (df.select(*rest, F.posexplode_outer(F.split(F.col(col), ",")).alias("__at", "__one"))
            .withColumn(col, F.trim(F.col("__one"))).select(*df.columns, "__at"))


def keep_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``: the smallest by ``order_cols`` (then the other columns).

    A grouped ``min`` over a struct, so the map side already drops duplicates and a key
    with millions of copies costs one partial row per task, not one huge group.
    """
    rest = [c for c in df.columns if c != key and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols + rest]).alias("__s")
    return (df.groupBy(key).agg(F.min(packed).alias("__s"))
            .select(key, *[F.col(f"__s.{c}").alias(c) for c in order_cols + rest])
            .select(*df.columns))


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df``, read straight from Parquet files, with each row's place: file, then row in the file."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                   F.col("_metadata.row_index").alias("row")).alias(name))


def keep_first_in_file(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """E1 in file order: of the rows with equal ``key`` the one that stands first in the files,
    whatever its other values. Combined before the shuffle, like ``keep_first``. ``position`` sorts
    the rows (``with_file_position``, or that of the CSV reader) and is dropped."""
    return keep_first(df, key, [position]).drop(position)


def build_cases(linked: DataFrame, tweets: DataFrame, brand: str,
                explode_ids: bool = False, position: str | None = None) -> DataFrame:
    """C1 + B4 + E1 + H2 + B5: customer message joined to the brand reply it received.

    Keys are compared as text (B7) like the exchange files; a comma list of reply ids
    matches nothing unless ``explode_ids`` (C1x) is on. Of several rows for one message the
    first in id order stays, or with ``position`` (a column of both tables) the first in file
    order: of the messages, then of an id list, then of the replies.
    """
    cases = linked.select(                                   # B2: exchange column names
        F.col("tweet_id").alias("customer_tweet_id"), "created_at",
        F.col("text").alias("customer_text"),
        F.col("response_tweet_id").cast("string").alias("brand_reply_id"),
        *([F.col(position).alias("__first")] if position else []))
    cases = with_list_position(cases, "brand_reply_id") if explode_ids else cases.withColumn("__at", F.lit(0))
    replies = brand_replies(tweets, brand).select(
        F.col("tweet_id").cast("string").alias("brand_reply_id"),
        F.col("text").alias("brand_reply"), *([F.col(position).alias("__second")] if position else []))
    joined = (cases.join(replies, "brand_reply_id", "inner")
              .dropna(subset=["customer_text", "brand_reply"]))
    # The first id of the list, then the smaller id as a number
    joined = joined.withColumn("__number", F.col("brand_reply_id").try_cast("decimal(38,0)"))
    order = ["__first", "__at", "__second"] if position else ["__at", "__number", "brand_reply_id", "brand_reply"]
    first = keep_first(joined, "customer_tweet_id", order)
    return (first
            .withColumn("customer_text", py_strip("customer_text"))
            .withColumn("brand_reply", py_strip("brand_reply"))
            .filter((F.col("customer_text") != "") & (F.col("brand_reply") != ""))
            .select("customer_tweet_id", "created_at", "customer_text", "brand_reply_id", "brand_reply"))


def corpus_audit(tweets: DataFrame, brand: str, cases: DataFrame) -> DataFrame:
    """one row per stage: ``stage, rows`` (total, inbound, brand replies, linked, cases)."""
    t = tweets.agg(F.count(F.lit(1)).alias("total_tweets"),
                   F.count_if(F.col("inbound")).alias("inbound_tweets"),
                   F.count_if((F.col("author_id") == F.lit(brand)) & ~F.col("inbound")).alias("brand_replies"))
    long_t = t.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("stage"), F.col(c).alias("rows"))
        for c in ("total_tweets", "inbound_tweets", "brand_replies")])).alias("s")).select("s.*")
    lk = linked_messages(tweets, brand).agg(F.lit("linked_messages").alias("stage"),
                                            F.count(F.lit(1)).alias("rows"))
    cs = cases.agg(F.lit("cases").alias("stage"), F.count(F.lit(1)).alias("rows"))
    return long_t.unionByName(lk).unionByName(cs)
