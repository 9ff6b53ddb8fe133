"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing, sharding.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``. ``run`` writes every stage's result as
Parquet to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.llm import decontaminate, language, mixing, near_dedup, sharding
from supportflow.llm.common import prepare, stored, table

SHINGLE, PERCENT = 5, 80
SHARD_BYTES = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learned from three of four folds. A text without a letter goes, and one in no
    learned language: too few of its trigrams are known (``familiar``). Null and empty texts go;
    without labelled rows all go; copies share their fate."""
    model = language.train(docs.filter(~language.is_held_out(F.col("doc_id"))))
    scored = language.predict(docs, model, prefix="__l_")
    return scored.filter((F.col("__l_lang_pred") != "und") & F.col("__l_familiar")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each component of texts with a similarity of 0.8 or more in
    five-word shingles stays. Texts without words are linked with nothing and stay."""
    return near_dedup.dedup(docs, shingle=SHINGLE, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark window go; a text without words stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what the mix serves, whole; a document served twice is two rows. Texts without
    words cost nothing and stay."""
    return mixing.mix_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents with their shard; rows equal in id and text share one."""
    return sharding.with_shard(docs, SHARD_BYTES, prefix="shard_").withColumnRenamed("shard_shard", "shard")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A trained classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
