"""Per-row parsers for model output (H13, H17-H24) as native column expressions.

Model output arrives as a table of raw strings; parsing is a projection over it. JSON goes
through ``try_parse_json`` / ``try_variant_get``; a text only counts as a JSON object if it
is ``{...}`` as a whole (Spark's parser alone would accept trailing text). Objects with a
duplicated key do not parse (they are treated as malformed). Regexes avoid ``\\b`` and
``\\s`` so that java.util.regex and RE2 (the oracle) read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.functions.text import WORD, after_first, length_between, py_strip, strip_prefixes

SP = r"[\t\n\x0B\f\r ]"          # ASCII blanks (java ``\s``), spelled out for RE2 too
NB = f"(?<![{WORD}])"            # no word character before
NA = f"(?![{WORD}])"             # no word character after

# ---------------------------------------------------------------------------------
# Reply-cleaning lists and messages of the reference.
# ---------------------------------------------------------------------------------
REPLY_PREFIXES = ["CUSTOMER-FACING REPLY:", "Customer-facing reply:", "Reply:", "Assistant:",
                  "Final answer:", "Final Reply:", "Response:"]
FINAL_PREFIXES = ["CUSTOMER-FACING REPLY:", "Reply:", "Assistant:", "Final answer:", "Final Reply:",
                  "Response:"]
BAD_STARTS = ["We are given", "We have a customer message", "The customer message", "We need to",
              "The user wants", "The task is", "We are asked to", "Historical Evidence:",
              "Classified intent:", "The classified intent is:", "Let's analyze", "Analysis:",
              "Reasoning:", "Looking at the historical", "Case 1:", "Case 2:"]


def reasoning_markers(brand: str) -> list[str]:
    return ["Customer message:", "Classified intent:", f"Historical {brand} responses:", "Important rules:"]


JUDGE_METRICS = ["correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "overall"]
LABEL_PATTERNS = {
    "correctness": "correctness",
    "groundedness": "groundedness",
    "helpfulness": "helpfulness",
    "brand_consistency": "(?:brand[_ ]?consistency|brand)",
    "safety": "safety",
    "overall": "overall",
}
REPLY_OBJECT_RE = r'(?s)\{.*?"reply"' + SP + '*:' + SP + r'*".*?"' + SP + r'*\}'
ANY_OBJECT_RE = r"(?s)\{.*?\}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_object(x) -> Column:
    """Parsed variant when ``x`` is one JSON object as a whole, else null."""
    c = _c(x)
    return F.when(c.startswith("{") & c.endswith("}"), F.try_parse_json(c))


def last_key_wins(spark: SparkSession) -> None:
    """Let a JSON object with a repeated key parse, keeping the last value."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def has_field(v: Column, key: str) -> Column:
    return F.coalesce(F.variant_get(v, f"$.{key}", "variant").isNotNull(), F.lit(False))


# ---------------------------------------------------------------------------------
# Replies (N2)
# ---------------------------------------------------------------------------------
def clean_replies(df: DataFrame, raw_col: str = "raw", brand: str = "AppleSupport") -> DataFrame:
    """N2 on a raw-response table: adds ``reply`` (null when rejected) and ``reject_reason``.

    A repeated JSON key keeps its last value. Order: strip -> JSON object (H17; object without a reply is rejected) -> otherwise text
    after ``</think>`` then after ``<think>`` (H13) -> last embedded ``{... "reply": ...}``
    (H18) -> prefixes (H9) -> bad starts / ``{`` / ``[`` (H10) -> markers (H11) -> length
    10..1000 (H8) -> second prefix pass; an empty result is null.
    """
    last_key_wins(df.sparkSession)
    bad_start = None
    for b in BAD_STARTS:
        e = F.col("__r1").startswith(F.lit(b))
        bad_start = e if bad_start is None else bad_start | e
    marker = None
    for m in reasoning_markers(brand):
        e = F.col("__r1").contains(F.lit(m))
        marker = e if marker is None else marker | e
    out = (df
           .withColumn("__raw", py_strip(F.coalesce(F.col(raw_col), F.lit(""))))
           .withColumn("__obj", json_object("__raw"))
           .withColumn("__jr", json_field(F.col("__obj"), "reply"))
           .withColumn("__c1", F.when(F.col("__raw").contains("</think>"),
                                      py_strip(after_first("__raw", "</think>"))).otherwise(F.col("__raw")))
           .withColumn("__c2", F.when(F.col("__c1").contains("<think>"),
                                      py_strip(after_first("__c1", "<think>"))).otherwise(F.col("__c1")))
           .withColumn("__cand", F.try_element_at(F.regexp_extract_all("__c2", F.lit(REPLY_OBJECT_RE), 0),
                                                  F.lit(-1)))
           .withColumn("__cr", json_field(json_object("__cand"), "reply"))
           .withColumn("__r0", F.when(F.col("__obj").isNotNull(), F.col("__jr"))
                       .when(F.coalesce(F.col("__cr"), F.lit("")) != "", F.col("__cr"))
                       .otherwise(F.col("__c2")))
           .withColumn("__r1", strip_prefixes(py_strip(F.coalesce("__r0", F.lit(""))), REPLY_PREFIXES))
           .withColumn("reject_reason",
                       F.when(F.col("__raw") == "", "empty")
                       .when(F.col("__obj").isNotNull() & (F.coalesce(F.col("__jr"), F.lit("")) == ""),
                             "json_without_reply")
                       .when(F.col("__r1").startswith("{") | F.col("__r1").startswith("["), "structured")
                       .when(bad_start, "reasoning_start")
                       .when(marker, "reasoning_marker")
                       .when(F.length("__r1") < 10, "too_short")
                       .when(F.length("__r1") > 1000, "too_long"))
           .withColumn("__r2", strip_prefixes(F.col("__r1"), FINAL_PREFIXES))
           .withColumn("reply", F.when(F.col("reject_reason").isNull() & (F.col("__r2") != ""), F.col("__r2")))
           .withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & F.col("reply").isNull(), "empty")
                       .otherwise(F.col("reject_reason"))))
    return out.drop("__raw", "__obj", "__jr", "__c1", "__c2", "__cand", "__cr", "__r0", "__r1", "__r2")


# ---------------------------------------------------------------------------------
# Judge scores (N7: six metrics; H24: one score)
# ---------------------------------------------------------------------------------
def first_score(x) -> Column:
    """First standalone digit 1-5 of a value's text, else 0."""
    d = F.regexp_extract(_c(x), f"{NB}([1-5]){NA}", 1)
    return F.when(d != "", d.cast("int")).otherwise(F.lit(0))


def _six_numbers_patterns() -> list[str]:
    d = "([1-5])"
    return [
        NB + (SP + "+").join([d] * 6) + NA,
        NB + (SP + "*," + SP + "*").join([d] * 6) + NA,
        NB + r"\|".join([d] * 6) + NA,
    ]


def parse_judge_six(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """H19-H23 cascade (H21 six labelled scores, H22 six-number sequences): JSON object (whole text, after ``</think>``, then candidates from
    the end) with all six keys and every score 1-5 -> labelled scores -> six-number
    sequence -> unparsed. Adds the six metric columns (0 when unparsed), ``parsed`` and
    ``method``."""
    last_key_wins(df.sparkSession)
    t = "__t"
    cands = F.reverse(F.regexp_extract_all(F.col("__t2"), F.lit(ANY_OBJECT_RE), 0))
    out = (df
           .withColumn("__raw", F.coalesce(F.col(raw_col), F.lit("")))
           .withColumn(t, py_strip("__raw"))
           .withColumn("__has_end", F.col(t).contains("</think>"))
           .withColumn("__after", py_strip(after_first(t, "</think>")))
           .withColumn("__t2", F.when(F.col("__has_end"), F.col("__after")).otherwise(F.col(t)))
           .withColumn("__json", F.coalesce(
               json_object(t),
               F.when(F.col("__has_end"), json_object("__after")),
               F.try_parse_json(F.try_element_at(F.filter(cands, lambda s: json_object(s).isNotNull()), F.lit(1))))))
    # one JSON parse per row for all six values and one key list for presence (a key with
    # a JSON null counts as present, as in the reference)
    six_schema = ", ".join(f"{m} string" for m in JUDGE_METRICS)
    out = (out.withColumn("__js", F.to_json(F.col("__json")))
           .withColumn("__vals", F.from_json(F.col("__js"), six_schema))
           .withColumn("__keys", F.json_object_keys(F.col("__js"))))
    all_keys = None
    for m in JUDGE_METRICS:
        e = F.coalesce(F.array_contains(F.col("__keys"), F.lit(m)), F.lit(False))
        all_keys = e if all_keys is None else all_keys & e
    out = out.withColumns({f"__j_{m}": first_score(F.col(f"__vals.{m}")) for m in JUDGE_METRICS})
    json_ok = all_keys
    for m in JUDGE_METRICS:
        json_ok = json_ok & (F.col(f"__j_{m}") > 0)
    # labelled form: text after </think> when something follows it, else the whole text
    raw_after = after_first("__raw", "</think>")
    # later stages only look at rows the earlier ones left unparsed (null text otherwise)
    out = out.withColumn("__json_ok", json_ok)
    out = out.withColumn("__tl", F.when(F.col("__json_ok"), F.lit(None).cast("string"))
                         .when(F.col("__raw").contains("</think>") & (py_strip(raw_after) != ""), raw_after)
                         .otherwise(F.col("__raw")))
    out = out.withColumns({f"__l_{m}": F.regexp_extract("__tl", f"(?i){p}{SP}*[:=\\-]{SP}*([1-5])", 1)
                           for m, p in LABEL_PATTERNS.items()})
    lab_ok = None
    for m in JUDGE_METRICS:
        e = F.col(f"__l_{m}") != ""
        lab_ok = e if lab_ok is None else lab_ok & e
    out = out.withColumn("__lab_ok", F.coalesce(lab_ok, F.lit(False)))
    out = out.withColumn("__t3", F.when(F.col("__json_ok") | F.col("__lab_ok"), F.lit(None).cast("string"))
                         .when(F.col("__has_end") & (F.col("__after") != ""), F.col("__after"))
                         .otherwise(F.col(t)))
    pats = _six_numbers_patterns()
    for pi, p in enumerate(pats):
        out = out.withColumn(f"__s{pi}", F.regexp_extract_all("__t3", F.lit(p), 0))
    seq = None
    for pi, p in enumerate(pats):
        hit = F.size(F.col(f"__s{pi}")) > 0
        first = F.try_element_at(F.col(f"__s{pi}"), F.lit(1))
        val = F.when(hit, F.array(*[F.regexp_extract(first, p, i + 1).cast("int") for i in range(6)]))
        seq = val if seq is None else F.coalesce(seq, val)
    out = out.withColumn("__seq", seq)
    method = (F.when(F.col("__raw") == "", F.lit(None))
              .when(F.col("__json_ok"), "json").when(F.col("__lab_ok"), "labelled")
              .when(F.col("__seq").isNotNull(), "sequence"))
    out = out.withColumn("method", method)
    cols = {}
    for i, m in enumerate(JUDGE_METRICS):
        cols[m] = (F.when(F.col("method") == "json", F.col(f"__j_{m}"))
                   .when(F.col("method") == "labelled", F.col(f"__l_{m}").cast("int"))
                   .when(F.col("method") == "sequence", F.col("__seq")[i])
                   .otherwise(F.lit(0)))
    out = out.withColumns(cols).withColumn("parsed", F.col("method").isNotNull())
    return out.drop(*[c for c in out.columns if c.startswith("__")])


SCORE_RE = r"([1-5])(?<![0-9][1-5])(?![0-9])"      # the digit first: a text without one is passed over quickly


def last_score(raw) -> Column:
    """Last digit 1-5 not next to another digit, after ``</think>`` when the text has
    both markers; null when there is none (``'4/5'`` gives 5)."""
    a = py_strip(F.coalesce(_c(raw), F.lit("")))
    a = F.when(a.contains("<think>") & a.contains("</think>"), py_strip(after_first(a, "</think>"))).otherwise(a)
    d = F.regexp_extract(F.reverse(a), SCORE_RE, 1)                                    # the last is the first from the end
    return F.when(d != "", d.cast("int"))


__all__ = ["clean_replies", "parse_judge_six", "last_score", "first_score", "length_between"]
