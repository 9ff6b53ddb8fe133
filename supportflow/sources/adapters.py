"""Stand-in inputs built from the driver tables.

``conversations(conv_id, turn, role, text)`` stands in for a tweet dump:

* ``tweet_id = conv_id * 2**20 + turn`` (one id per turn; a turn or conversation number that
  does not fit raises)
* ``author_id = BRAND`` for assistant turns, else ``'user_' || conv_id``
* ``inbound = role <> 'assistant'``
* ``in_response_to_tweet_id`` = id of turn - 1, ``response_tweet_id`` = id of turn + 1
  (turns are numbered 0, 1, 2, ... inside a conversation), both as text like the dump.

The neighbours are found by equi-joins on the unique key ``(conv_id, turn)``, not by a
window over ``conv_id``, so one very long conversation never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRAND = "Brand"


TURNS = 1 << 20


def tweet_id(conv_id: str = "conv_id", turn: str = "turn") -> F.Column:
    """The id of a turn; injective, and an error where a number is out of range."""
    c, t = F.col(conv_id).cast("long"), F.col(turn).cast("long")
    fits = (t >= 0) & (t < TURNS) & (c >= 0) & (c < (1 << 42))
    return (F.when(c.isNull() | t.isNull(), F.lit(None).cast("long"))
            .when(fits, c * TURNS + t)
            .otherwise(F.raise_error(F.lit("conversation or turn number out of range")).cast("long")))


_tweet_id = tweet_id


def tweets_from_conversations(conversations: DataFrame, brand: str = BRAND) -> DataFrame:
    base = conversations.select("conv_id", "turn", "role", "text", _tweet_id().alias("tweet_id"))
    parent = base.select("conv_id", (F.col("turn") + 1).alias("turn"),
                         F.col("tweet_id").cast("string").alias("in_response_to_tweet_id"))
    child = base.select("conv_id", (F.col("turn") - 1).alias("turn"),
                        F.col("tweet_id").cast("string").alias("response_tweet_id"))
    return (base.join(parent, ["conv_id", "turn"], "left")
            .join(child, ["conv_id", "turn"], "left")
            .select(
                "tweet_id",
                F.when(F.col("role") == "assistant", F.lit(brand))
                 .otherwise(F.concat(F.lit("user_"), F.col("conv_id").cast("string"))).alias("author_id"),
                (F.col("role") != "assistant").alias("inbound"),
                F.lit(None).cast("string").alias("created_at"),
                "text",
                "response_tweet_id",
                "in_response_to_tweet_id",
            ))


def customer_messages(conversations: DataFrame) -> DataFrame:
    """User turns as the message table the classifier and policy score."""
    return (conversations.filter(F.col("role") == "user")
            .select(_tweet_id().alias("tweet_id"), "conv_id", "turn", "text"))
