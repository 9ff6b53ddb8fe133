"""Sort, limit, sample, split, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.session import ensure_checkpoint_dir, small_side


def with_position(df: DataFrame, order_cols: list[str], name: str = "pos", start: int = 0,
                  num_partitions: int | None = None) -> DataFrame:
    """Dense position in ``order_cols`` order (must be a total order), from ``start``.

    Distributed: range-partition and sort, number rows inside each partition with
    ``monotonically_increasing_id`` (partition id in the high bits, record number in the
    low 33), then add each partition's offset from a table with one row per partition
    (bounded by the partition count, so its broadcast is safe). The numbered rows are
    checkpointed: range bounds are sampled, so rows and offsets must come from the same
    partitioning, not from two that may differ.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint())
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid")
                           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("__n")).alias("__off"))
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + F.col("__local") + F.lit(start))
            .drop("__pid", "__local", "__off"))


def md5_rank_key(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of ``key || ':' || seed`` (same in DuckDB)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def head_n(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """G1: first ``n`` rows in a stated order (``head(20)`` of an ordered table)."""
    return df.orderBy(*order_cols).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, N)`` rows chosen by a seeded hash order; repeatable anywhere."""
    return (df.withColumn("__k", md5_rank_key(F.col(key), seed))
            .orderBy("__k", key).limit(n).drop("__k"))


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per label, the first round(share * n) rows in seeded-hash order are 'test'.

    Adds ``split`` ('train'/'test'). A label may hold most rows, so no window runs per
    label: rows get a global position in (label, hash) order (range-partitioned, so a big
    label spreads over many tasks) and the rank inside a label is that position minus the
    label's first position. The per-label table has one row per class label.
    """
    pos = with_position(df.withColumn("__k", md5_rank_key(F.col(key), seed)),
                        [label, "__k", key], name="__pos")
    per_label = pos.groupBy(label).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return (pos.join(small_side(per_label), label)
            .withColumn("split", F.when(F.col("__pos") - F.col("__first") < F.round(F.col("__n") * F.lit(test_share)),
                                        "test").otherwise("train"))
            .drop("__k", "__n", "__pos", "__first"))


def first_open(df: DataFrame, done_col: str, order_cols: list[str], n: int = 1) -> DataFrame:
    """First ``n`` rows not yet done (next item for a reviewer)."""
    return df.filter(~F.coalesce(F.col(done_col), F.lit(False))).orderBy(*order_cols).limit(n)
