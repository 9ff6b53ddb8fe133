"""Driver texts with the reference's own terms woven in, so that its real lexicon and policies
run, term by term, under an oracle.

Every document gives two messages, both kept whole: its text (``id = 2 * doc_id``) and its
language code (``2 * doc_id + 1``; a message of a word or two). ``PHRASES[id % n]`` is appended:
every term of the classifier, the labellers and both policies alone, a pair for each rule that
needs two sets, three technical terms, and nothing. Evidence comes from the id: none for one
message in four, else a similarity of ``(37 * id % 101) / 100``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.operators import lexicon as L
from supportflow.operators import policy as P
from supportflow.sources.tables import read_table


def _phrases() -> list[str]:
    single = [t.term for r in L.CLASSIFIER.labels for t in r.terms]
    single += [t for fm in (L.WEAK_LABELS, L.RELABEL) for _, terms in fm.rules for t in terms]
    out = []
    for policy in (P.policy_v2(), P.policy_v1()):
        single += [t for terms in policy.term_sets.values() for t in terms]
        for r in policy.rules:
            if r.kind == "any_and_any":
                a, b = (policy.term_sets[s] for s in r.sets)
                out += [f"{a[i % len(a)]} {b[i % len(b)]}" for i in range(max(len(a), len(b)))]
            if r.kind == "count_at_least":
                t, n = policy.term_sets[r.sets[0]], int(r.threshold)
                out += [" ".join(t[i:i + n]) for i in range(len(t) - n + 1)]
    return ["", *dict.fromkeys(single), *dict.fromkeys(out)]


PHRASES = _phrases()


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """``id, text, n_hits, top_score``."""
    docs = read_table(spark, sf, "documents")
    own = docs.select((2 * F.col("doc_id")).alias("id"), "text").unionByName(
        docs.select((2 * F.col("doc_id") + 1).alias("id"), F.col("lang").alias("text")))
    at = F.pmod(F.col("id"), F.lit(len(PHRASES))).cast("int")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), at + 1)
    hits = F.when(F.pmod("id", F.lit(4)) == 0, 0).otherwise(5).cast("long")
    return own.select("id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("text"),
                      hits.alias("n_hits"),
                      F.when(hits > 0, F.pmod(37 * F.col("id"), F.lit(101)) / 100).alias("top_score"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_WOVEN = f"""woven AS (
  SELECT id, coalesce(text, '') || ' ' || {_list(PHRASES)}[1 + id % {len(PHRASES)}] AS text,
         CASE WHEN id % 4 = 0 THEN 0 ELSE 5 END::BIGINT AS n_hits,
         CASE WHEN id % 4 <> 0 THEN (37 * id % 101)::DOUBLE / 100 END AS top_score
  FROM (SELECT 2 * doc_id AS id, text FROM documents UNION ALL SELECT 2 * doc_id + 1, lang FROM documents))"""
