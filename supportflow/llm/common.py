"""Helpers shared by the operators: written intermediate tables, checked broadcasts,
distributed running sums, and batch-wise Python steps.

Rules that every operator follows:

* A caller's column names never clash with an operator's own: operators first project the
  columns they need under names that start with ``__`` and join results back by position in
  the row, never by a user column of the same name.
* Intermediate tables are written to the shared folder named by ``spark.checkpoint.dir``; a
  lost executor re-reads them from there. They are deleted when the application ends.
* A side is broadcast only after its rows were counted against a stated bound; beyond the
  bound the same join runs as a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportflow.session import ensure_checkpoint_dir, ship_package

BROADCAST_ROWS = 200_000
ARROW_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, library on the executors, Arrow batches of bounded size."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than that)."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums over the whole table in ``order`` (a total order up to rows
    that are interchangeable). ``sums``: new column -> summed column.

    The rows are range-partitioned once and written, so rows and offsets come from the same
    partitions. Offsets: one row per partition. No window spans more than one partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("__part", F.spark_partition_id())
                    .withColumn("__row", F.monotonically_increasing_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}")
                                        for k in sums])
    inside = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__part")
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"__o_{k}") + F.sum(c).over(inside))
    return out.drop("__part", "__row", *[f"__o_{k}" for k in sums])


def in_batches(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task function built once: ``make()`` returns
    ``f(record_batch) -> record_batch``."""
    def run(batches: Iterator):
        f = make()
        for b in batches:
            if b.num_rows:
                out = f(b)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def hex_base32(hex_col: Column) -> Column:
    """Bare upper-case base32 (RFC 4648) of a 40-digit hexadecimal SHA-1."""
    parts = []
    for i in range(0, 40, 5):
        digits = F.conv(F.substring(hex_col, i + 1, 5), 16, 32)
        parts.append(F.lpad(digits, 4, "0"))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
