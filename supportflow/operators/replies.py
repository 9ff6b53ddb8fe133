"""Grounded replies and the whole agent as a batch job.

The model is not called here: prompts are produced as a table (N1) and the model's raw
answers come back as a table ``raw_responses(id, attempt, raw)``; cleaning (N2), the
grounded fallback (N3) and the decision (M12) are projections and joins over tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.functions.parsing import clean_replies
from supportflow.functions.text import fmt_fixed, py_strip
from supportflow.operators import lexicon as L
from supportflow.operators import policy as P
from supportflow.operators import retrieval as R

# ---------------------------------------------------------------------------------
# Fallback replies and prompt instructions of the reference.
# ---------------------------------------------------------------------------------


def fallback_no_cases(brand: str) -> str:
    return (f"Thanks for contacting {brand}. We'd be happy to help. Please provide more details "
            "about the issue you're experiencing.")


def fallback_no_evidence(brand: str) -> str:
    return f"Thanks for contacting {brand}. Could you provide more details about the issue you're experiencing?"


PROMPT_RULES = [
    "Use the historical {brand} responses as the main source.",
    "Adapt the historical response to the customer's actual problem.",
    "Do NOT invent {company} policies.",
    "Do NOT invent refund or compensation policies.",
    "Do NOT invent troubleshooting steps that are not supported by the historical responses.",
    "Do NOT invent URLs, phone numbers, prices, warranty information, or promises.",
    "Do NOT claim {company} has already performed an action.",
    "If the historical evidence does not provide enough information for a specific solution, "
    "ask the customer for the minimum useful information needed.",
    "Be polite and professional.",
    "Keep the response to 1-3 sentences.",
    "Do not mention the dataset.",
    "Do not mention historical cases.",
    "Do not mention similarity scores.",
    "Do not mention that you are an AI.",
    "Do not explain your reasoning.",
    "Return ONLY the customer-facing reply.",
]
HANDLE_RE = r"^@[A-Za-z0-9_]+[\t\n\x0B\f\r ]*"    # H12: leading @handle


def prompt_template(brand: str, company: str) -> str:
    """``%s`` slots: message, intent, evidence blocks."""
    rules = "\n".join(f"{i}. {r.format(brand=brand, company=company)}" for i, r in enumerate(PROMPT_RULES, 1))
    head = (f"You are an AI customer-support assistant for {brand}.\n"
            "Write ONE short, helpful customer-facing reply.\n\n"
            "CUSTOMER MESSAGE:\n%s\n\nCLASSIFIED INTENT:\n%s\n\n"
            f"HISTORICAL {brand.upper()} RESPONSES:\n%s\n\nIMPORTANT RULES:\n")
    return (head.replace("%", "%%").replace("%%s", "%s") + rules.replace("%", "%%")
            + "\n\nCUSTOMER-FACING REPLY:")


def evidence_block(brand: str) -> str:
    b = brand.replace("%", "%%")
    return ("HISTORICAL CASE %d\nCustomer issue: %s\n" + b + " response: %s\nSimilarity score: %s\n"
            "--------------------------------\n")


def prompt_table(messages: DataFrame, hits: DataFrame, cases: DataFrame, brand: str,
                 company: str | None = None, key: str = "tweet_id") -> DataFrame:
    """``key, n_cases, n_blocks, prompt`` per message. Cases with an empty reply are
    skipped but keep their number; no hits or no usable case -> prompt null (no model call).

    ``messages`` has ``key, text, intent``; ``hits`` is ``qid, rank, case_id, score``.
    """
    block = F.format_string(evidence_block(brand), F.col("rank"),
                            py_strip(F.coalesce("customer_text", F.lit(""))), F.col("__br"),
                            fmt_fixed("score", 4))
    ev = (hits.join(cases.select("case_id", "customer_text", "brand_reply"), "case_id")
          .withColumn("__br", py_strip(F.coalesce("brand_reply", F.lit(""))))
          .groupBy("qid")
          .agg(F.count(F.lit(1)).alias("n_cases"),
               F.count_if(F.col("__br") != "").alias("n_blocks"),
               F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct(F.col("rank"), F.when(F.col("__br") != "", block)
                                                        .otherwise(F.lit("")).alias("b")))),
                   lambda s: s["b"]), "").alias("__ev"))
          .withColumnRenamed("qid", key))
    tmpl = prompt_template(brand, company or brand)
    return (messages.select(key, "text", "intent").join(ev, key, "left")
            .select(key, F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
                    F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
                    F.when(F.col("n_blocks") > 0,
                           F.format_string(tmpl, py_strip(F.coalesce("text", F.lit(""))), F.col("intent"),
                                           F.col("__ev"))).alias("prompt")))


def grounded_reply(df: DataFrame, brand: str) -> DataFrame:
    """Final reply from ``n_cases, n_blocks, reply (cleaned, may be null), top_reply``.

    No case -> first fixed text; cases but no usable reply text -> second fixed text; else
    the cleaned model reply, else the top case's reply without a leading handle, else the
    first fixed text.
    """
    top = py_strip(F.regexp_replace(py_strip(F.coalesce("top_reply", F.lit(""))), HANDLE_RE, ""))
    return df.withColumn(
        "final_reply",
        F.when(F.coalesce(F.col("n_cases"), F.lit(0)) == 0, F.lit(fallback_no_cases(brand)))
        .when(F.coalesce(F.col("n_blocks"), F.lit(0)) == 0, F.lit(fallback_no_evidence(brand)))
        .when(F.col("reply").isNotNull(), F.col("reply"))
        .when(top != "", top)
        .otherwise(F.lit(fallback_no_cases(brand))))


def first_response(raw_responses: DataFrame) -> DataFrame:
    """The earliest attempt per id (``id, raw``); a key with many attempts is
    partial-aggregated map side."""
    return (raw_responses.groupBy("id")
            .agg(F.min_by("raw", "attempt").alias("raw")))


def hit_features(hits: DataFrame, cases: DataFrame, brand: str) -> DataFrame:
    """Per query, from one join of the hits with their cases and one aggregation: ``qid,
    n_hits, top_score`` (J8 / F15), ``n_cases, n_blocks`` (N1), ``top_reply`` (the rank-1
    case's reply) and ``evidence`` (F14). The same values as ``hit_summary``,
    ``prompt_table`` and ``evidence_strings``, for the agent that needs them all: the hits
    are shuffled once instead of four times (at most k rows per query are collected)."""
    hc = hits.join(cases.select("case_id", "customer_text", "brand_reply")
                   .withColumn("__in", F.lit(True)), "case_id", "left")
    matched = F.col("__in").isNotNull()
    br = py_strip(F.coalesce("brand_reply", F.lit("")))
    return hc.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("top_score"),
        F.count_if(matched).alias("n_cases"), F.count_if(matched & (br != "")).alias("n_blocks"),
        F.max(F.when(matched & (F.col("rank") == 1), F.col("brand_reply"))).alias("top_reply"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(matched, F.struct(F.col("rank"), R.evidence_line(brand).alias("e"))))),
            lambda s: s["e"]), " || ").alias("evidence"))


def agent_batch(messages: DataFrame, hits: DataFrame, cases: DataFrame, raw_responses: DataFrame,
                brand: str, lex: L.Lexicon, policy: P.Policy, key: str = "tweet_id") -> DataFrame:
    """N4 + N5: the whole agent over a message table, one output row per input row.

    ``messages(key, text)``; ``hits(qid, rank, case_id, score)``; ``raw_responses(id,
    attempt, raw)`` keyed by message. Output: ``key, text, intent, confidence, reply,
    decision, reason, rule_id, top_similarity, evidence, status`` (rows with no text are
    ``ERROR`` rows: intent and decision 'ERROR', confidence 0, reply '').
    """
    cl = L.classify(messages.select(key, "text"), "text", lex)
    feats = hit_features(hits, cases, brand).withColumnRenamed("qid", key)
    cleaned = clean_replies(first_response(raw_responses).withColumnRenamed("id", key), "raw", brand)
    base = (cl.join(feats, key, "left")
            .withColumn("n_hits", F.coalesce(F.col("n_hits"), F.lit(0)))
            .join(cleaned.select(key, "reply"), key, "left"))
    base = grounded_reply(base, brand)
    dec = P.decide(base, policy)
    ok = F.col("text").isNotNull()
    return dec.select(
        key, "text",
        F.when(ok, F.col("intent")).otherwise(F.lit("ERROR")).alias("intent"),
        F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.col("final_reply")).otherwise(F.lit("")).alias("reply"),
        F.when(ok, F.col("decision")).otherwise(F.lit("ERROR")).alias("decision"),
        F.when(ok, F.col("reason")).otherwise(F.lit("message text missing")).alias("reason"),
        F.when(ok, F.col("rule_id")).alias("rule_id"),
        F.coalesce(F.col("top_score"), F.lit(0.0)).alias("top_similarity"),
        F.coalesce(F.col("evidence"), F.lit("")).alias("evidence"),
        F.when(ok, F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"))
