"""Sources and sinks (A1-A7): fixed schemas, CSV exchange files, Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.sources import csv_chunks, snapshots

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Fixed schemas (FIXTURES.md). Ids that arrive as float text in exchange files stay
# STRING here and are coerced by ``functions.text.lenient_id``.
RAW_TWEETS = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType()),
])

CASES = T.StructType([
    T.StructField("customer_tweet_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("brand_reply_id", T.StringType()),
    T.StructField("brand_reply", T.StringType()),
])

CASE_VECTORS = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

GOLDEN = T.StructType(list(RAW_TWEETS.fields) + [
    T.StructField("intent", T.StringType()),
    T.StructField("escalate", T.StringType()),
    T.StructField("escalation_reason", T.StringType()),
    T.StructField("reviewed", T.StringType()),
])

HUMAN_RATINGS = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("predicted_intent", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("reply", T.StringType()),
    T.StructField("human_overall", T.IntegerType()),
])

RAW_RESPONSES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("raw", T.StringType()),
])

REVIEW_DECISIONS = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("decided_at", T.TimestampType()),
    T.StructField("intent", T.StringType()),
    T.StructField("escalate", T.BooleanType()),
    T.StructField("escalation_reason", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table ``name`` under ``sf_dir`` (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             columns: list[str] | None = None) -> DataFrame:
    """A1/A2: CSV exchange files with a fixed schema; quoted line feeds allowed, and a large file
    is still read by many tasks.

    A missing path raises ``AnalysisException [PATH_NOT_FOUND]`` (A3).
    """
    df = csv_chunks.read(spark, path, schema)
    return df.select(*columns) if columns else df


def read_csv_positioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``read_csv`` with ``position``, which sorts the rows as they stand in the files."""
    return csv_chunks.parsed(csv_chunks.records(spark, path), schema).select("row.*", "position")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail early when a table lacks columns a job needs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Replace the whole result (never a write per row). The result is written to a
    folder beside ``path`` and takes its place when it is complete, so a failed job leaves
    the earlier result untouched."""
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(fresh))
    else:
        w.format(fmt).save(fresh)
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(path), True)
    if not fs.rename(hadoop.Path(fresh), hadoop.Path(path)):
        raise OSError(f"could not move {fresh} to {path}")


def write_vectors(df: DataFrame, path: str) -> int:
    """The vector index is a versioned table keyed by ``case_id``; a reader sees the version
    before the write or after it."""
    return snapshots.replace(df.select("case_id", F.col("vec").cast("array<double>").alias("vec")), path, "case_id")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read(spark, path).select(*CASE_VECTORS.fieldNames())
