"""Human review data work (P1-P3, C6, E1, E3, F13, G5) and flag helpers.

The web forms of the reference are not rebuilt; what they do to tables is: find what is
still unreviewed, suggest a label, apply decisions, append ratings, report progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportflow.functions.text import truthy
from supportflow.operators.lexicon import known_label


def review_queue(items: DataFrame, reviewed: DataFrame, key: str, suggested: Column) -> DataFrame:
    """P1 + C6 + K10: items without a review (left-anti on the key) and a suggested label."""
    return (items.join(reviewed.select(key).distinct(), key, "left_anti")
            .withColumn("suggested_label", known_label(suggested)))


def next_items(queue: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The next ``n`` unreviewed items in key order (next item of a reviewer)."""
    return queue.orderBy(key).limit(n)


def review_progress(items: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """``total, reviewed, remaining, progress``."""
    flagged = items.select(key).join(reviewed.select(key).distinct().withColumn("__r", F.lit(True)), key, "left")
    return (flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("__r").isNotNull()).alias("reviewed"))
            .withColumn("remaining", F.col("total") - F.col("reviewed"))
            .withColumn("progress", F.round(F.when(F.col("total") > 0, F.col("reviewed") / F.col("total"))
                                            .otherwise(F.lit(0.0)), 4)))


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """E1 (keep last): one row per key, the one with the greatest ``order_col`` (ties: the
    greatest remaining columns). A grouped ``max`` over a struct: map-side combined, so a
    key with very many rows never forms one big group."""
    rest = [c for c in df.columns if c not in (key, order_col)]
    packed = F.struct(F.col(order_col), *[F.col(c) for c in rest])
    return (df.groupBy(key).agg(F.max(packed).alias("__s"))
            .select(key, *[F.col(f"__s.{c}").alias(c) for c in [order_col] + rest])
            .select(*df.columns))


def apply_reviews(labels: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The latest decision per key sets ``intent, escalate, escalation_reason`` (reason
    blank when not escalated) and ``reviewed = True``; other rows keep their values."""
    last = latest_per_key(decisions, key, "decided_at").select(
        key, F.col("intent").alias("__i"), F.col("escalate").alias("__e"),
        F.col("escalation_reason").alias("__r"))
    j = labels.join(last, key, "left")
    has = F.col("__e").isNotNull() | F.col("__i").isNotNull()
    return (j.withColumn("intent", F.when(has, known_label("__i")).otherwise(F.col("intent")))
            .withColumn("escalate", F.when(has, F.coalesce(F.col("__e"), F.lit(False))).otherwise(F.col("escalate")))
            .withColumn("escalation_reason", F.when(has, F.when(F.col("__e"), F.coalesce(F.col("__r"), F.lit("")))
                                                    .otherwise(F.lit(""))).otherwise(F.col("escalation_reason")))
            .withColumn("reviewed", F.when(has, F.lit(True)).otherwise(F.coalesce(F.col("reviewed"), F.lit(False))))
            .drop("__i", "__e", "__r"))


def append_ratings(existing: DataFrame, new: DataFrame, key: str, order_col: str = "rated_at") -> DataFrame:
    """P3 + E3: append new ratings and keep the latest per key."""
    return latest_per_key(existing.unionByName(new), key, order_col)


def with_default(df: DataFrame, col: str, value) -> DataFrame:
    """Add a missing column with a default, or fill its nulls."""
    if col in df.columns:
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return df.withColumn(col, F.lit(value))


def error_split(df: DataFrame, col: str = "intent", error_value: str = "ERROR") -> DataFrame:
    """``status`` ('valid' / 'error') and ``n``: rows whose ``col`` is the error marker
    are failed rows; the rest are the valid rows a report is computed on."""
    status = F.when(F.coalesce(F.col(col) == F.lit(error_value), F.lit(False)), F.lit("error")).otherwise(F.lit("valid"))
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def valid_rows(df: DataFrame, col: str = "intent", error_value: str = "ERROR") -> DataFrame:
    """The rows that are not error rows."""
    return df.filter(~F.coalesce(F.col(col) == F.lit(error_value), F.lit(False)))


def decision_flag(decision) -> Column:
    """``decision == 'ESCALATE'``."""
    c = F.col(decision) if isinstance(decision, str) else decision
    return F.coalesce(c == F.lit("ESCALATE"), F.lit(False))


__all__ = ["review_queue", "next_items", "review_progress", "latest_per_key", "apply_reviews",
           "append_ratings", "with_default", "decision_flag", "truthy"]
