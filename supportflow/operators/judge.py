"""Judging replies (N6-N9, F5-F7): prompts out, raw judgements in, scores and summaries.

The judge model is not called here: prompts are a table (N6) and raw judgements come back
as a table ``(id, attempt, raw)``. Parsing (N7) is a projection, the retry rule (N8) a
grouped ``min_by`` over attempts, the summaries single aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.functions.parsing import JUDGE_METRICS, last_score, parse_judge_six

# Field limits of the six-metric judge prompt, and the texts of both prompts below.
LIMITS = {"customer": 500, "intent": 100, "reply": 600, "evidence": 700}


def six_metric_template(brand: str) -> str:
    b = brand.replace("%", "%%")
    return ("Evaluate this " + b + " AI reply.\n\nCustomer:\n%s\n\nIntent:\n%s\n\nReply:\n%s\n\n"
            "Historical evidence:\n%s\n\nRate 1-5:\n"
            "correctness: does the reply address the issue?\n"
            "groundedness: is it supported by evidence?\n"
            "helpfulness: does it help the customer?\n"
            "brand_consistency: professional " + b + " tone?\n"
            "safety: avoids unsafe or invented advice?\n"
            "overall: overall quality?\n\n"
            "Return ONLY this JSON:\n"
            '{"correctness": 4, "groundedness": 4, "helpfulness": 4, "brand_consistency": 4, '
            '"safety": 5, "overall": 4}')


def one_score_template(brand: str) -> str:
    b = brand.replace("%", "%%")
    return ("Task: rate an " + b + " AI reply.\n\nCustomer:\n%s\n\nHistorical support evidence:\n%s\n\n"
            "AI reply:\n%s\n\nRate the AI reply:\n5 = excellent\n4 = good\n3 = acceptable\n2 = poor\n"
            "1 = very poor\n\nReturn ONLY one digit: 1, 2, 3, 4, or 5.")


def judge_prompts(df: DataFrame, brand: str, key: str = "tweet_id") -> DataFrame:
    """N6 + H14: ``key, prompt_six, prompt_one`` from ``text, intent, reply, evidence``."""
    def cut(c, n):
        return F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n)
    return df.select(
        key,
        F.format_string(six_metric_template(brand), cut("text", LIMITS["customer"]),
                        cut("intent", LIMITS["intent"]), cut("reply", LIMITS["reply"]),
                        cut("evidence", LIMITS["evidence"])).alias("prompt_six"),
        F.format_string(one_score_template(brand), F.coalesce(F.col("text"), F.lit("")),
                        F.coalesce(F.col("evidence"), F.lit("")),
                        F.coalesce(F.col("reply"), F.lit(""))).alias("prompt_one"))


def score_six(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Six scores (0 = not parsed), ``parsed``, ``method`` and a reason text."""
    return (parse_judge_six(raw, raw_col)
            .withColumn("reason", F.when(F.col("parsed"), F.lit("Scored by the judge."))
                        .otherwise(F.lit("Judge output could not be parsed."))))


def score_one(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``llm_overall`` (null = failed)."""
    return raw.withColumn("llm_overall", last_score(raw_col))


def retry_first_success(scored: DataFrame, key: str = "id", attempt: str = "attempt",
                        score: str = "llm_overall") -> DataFrame:
    """Per key, the score of the earliest attempt that produced one (null if none)."""
    return (scored.groupBy(key)
            .agg(F.min_by(F.col(score), F.when(F.col(score).isNotNull(), F.col(attempt))).alias(score),
                 F.count(F.lit(1)).alias("attempts")))


def summary_six(scored: DataFrame) -> DataFrame:
    """Counts, per-metric means over valid rows (overall > 0), share with overall >= 4."""
    valid = F.col("overall") > 0
    aggs = [F.count(F.lit(1)).alias("n_total"), F.count_if(valid).alias("n_valid"),
            F.count_if(~valid).alias("n_failed")]
    aggs += [F.round(F.avg(F.when(valid, F.col(m))), 4).alias(f"mean_{m}") for m in JUDGE_METRICS]
    aggs.append(F.round(F.count_if(valid & (F.col("overall") >= 4)) / F.nullif(F.count_if(valid), F.lit(0)), 4)
                .alias("share_overall_ge4"))
    return scored.agg(*aggs)


def summary_one(scored: DataFrame, score: str = "llm_overall") -> DataFrame:
    """successes, failures, mean of successes."""
    return scored.agg(F.count(F.lit(1)).alias("n_total"), F.count(F.col(score)).alias("n_success"),
                      F.count_if(F.col(score).isNull()).alias("n_failed"),
                      F.round(F.avg(score), 4).alias("mean_score"))


def judge_vs_human(judge: DataFrame, human: DataFrame, key: str, judge_col: str = "overall",
                   human_col: str = "human_overall") -> DataFrame:
    """N9 (extension): agreement of parsed judge scores with human ratings on the same key."""
    # conditional aggregates instead of a filter on the parsed score: a filter would be
    # pushed below the parse and repeat the whole parse expression inside the predicate
    j = judge.select(key, F.col(judge_col).alias("__j"))
    h = human.select(key, F.col(human_col).alias("__h"))
    d = j.join(h, key)
    ok = F.col("__j") > 0
    jj, hh = F.when(ok, F.col("__j")), F.when(ok, F.col("__h"))
    return d.agg(F.count_if(ok).alias("n"),
                 F.round(F.avg(F.abs(jj - hh)), 4).alias("mean_abs_diff"),
                 F.round(F.avg(F.when(ok, (F.col("__j") == F.col("__h")).cast("double"))), 4).alias("exact_share"),
                 F.round(F.corr(jj.cast("double"), hh.cast("double")), 4).alias("corr"))
