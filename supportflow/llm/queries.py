"""The operators over the driver tables: one query per operator, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.llm import (alignment, decontaminate, fingerprints, hard_negatives, language, licenses, lines, mixing,
                             near_dedup, pii, quality, sharding, warc)
from supportflow.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.with_shard(docs).select("doc_id", "shard", "bytes", "shard_bytes", "oversized")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                        F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark), keep=["doc_id"])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.is_held_out(F.col("doc_id")))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_passages(table(spark, sf_dir, "documents"), min_words=1).select(
        F.col("id").alias("doc_id"), "start", "end", "n_words", "n_units", F.col("first_id").alias("first_doc_id"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op4_pii``, which SQL can state."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of ``op10_quality``, which SQL can state."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *alignment.vocabularies()).withColumnRenamed("id", "doc_id")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fingerprints.edited_neighbours(docs)
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        F.array_join("fingerprint", ",").alias("fingerprint"),
                        F.array_join("edited_fingerprint", ",").alias("edited_fingerprint"), "near_edited", "near_next")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, ident = F.col("label").cast("long"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        hard_negatives.quantised("embedding").alias("vec"), (ident % 50 == 0).alias("anchor"))
    return hard_negatives.mine(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    own = (op1_mixing, op2_warc, op3_sharding, op4_pii, op5_decontamination, op6_licenses, op7_language,
           op8_near_duplicates, op9_line_dedup, op10_quality, op11_alignment, op12_fingerprints,
           op13_hard_negatives, pii_base, quality_base)
    return {**{f.__name__: f for f in own}, "pipeline": corpus_pipeline.run}
