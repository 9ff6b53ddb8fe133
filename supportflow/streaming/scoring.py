"""Structured Streaming forms of the batch jobs.

S1 scores a stream of messages statelessly with the same column functions as the batch
job (classifier + text rules of the policy). S2 runs the whole agent per micro-batch
with ``foreachBatch`` against static corpus tables; every micro-batch is written to its own
``batch_id=<n>`` folder with overwrite, so a replayed batch after a failure rewrites the
same output (idempotent sink). Stream state and output live under the cluster's
checkpoint folder unless paths are given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.functions.text import py_strip
from supportflow.operators import lexicon as L
from supportflow.operators import policy as P
from supportflow.session import delete_on_exit, ensure_checkpoint_dir
from supportflow.sources.adapters import tweet_id

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

EVIDENCE_KINDS = ("no_evidence", "low_similarity")


def text_rules(policy: P.Policy) -> P.Policy:
    """The policy without the rules that need retrieved evidence (S1 has no retrieval)."""
    return P.Policy(policy.name + "_text", tuple(r for r in policy.rules if r.kind not in EVIDENCE_KINDS),
                    policy.term_sets)


def score_messages(messages: DataFrame, lex: L.Lexicon, policy: P.Policy) -> DataFrame:
    """S1 core, for a stream or a table: skip blank messages, classify, apply text rules."""
    m = messages.filter(py_strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    cl = L.classify(m, "text", lex)
    d = P.decide(cl, text_rules(policy), n_hits_col=None, top_score_col=None)
    return d.select("tweet_id", "intent", "confidence", "rule_id", "decision")


def _paths(spark: SparkSession, name: str, out: str | None, ckpt: str | None) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, base)
    return out or base + "/out", ckpt or base + "/state"


def conversation_stream(spark: SparkSession, path: str, file_glob: str = "*.parquet") -> DataFrame:
    """A file stream of conversation turns: the Parquet file ``path``, or the files in the folder
    ``path`` matching ``file_glob``. (A stream starts from a folder, so a file is its folder's only match.)"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        path, file_glob = p.getParent().toString(), p.getName()
    return (spark.readStream.schema(CONVERSATIONS).option("pathGlobFilter", file_glob)
            .parquet(path))


def run_scoring_stream(spark: SparkSession, source: DataFrame, lex: L.Lexicon, policy: P.Policy,
                       out: str | None = None, checkpoint: str | None = None) -> str:
    """User turns of the stream -> scored rows appended as Parquet; runs until the
    available input is processed (``availableNow``) and returns the output folder."""
    out, checkpoint = _paths(spark, "scoring", out, checkpoint)
    msgs = (source.filter(F.col("role") == "user")
            .select(tweet_id().alias("tweet_id"), "text"))
    q = (score_messages(msgs, lex, policy).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_agent_stream(spark: SparkSession, source: DataFrame, batch_fn, out: str | None = None,
                     checkpoint: str | None = None) -> str:
    """``batch_fn(batch_df) -> DataFrame`` (the whole agent against static tables) per
    micro-batch; each batch overwrites its own ``batch_id`` folder."""
    out, checkpoint = _paths(spark, "agent", out, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        (batch_fn(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    q = (source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
