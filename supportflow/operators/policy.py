"""Escalation policy as an ordered rule table.

A policy is data: ordered rules ``(rule_id, kind, sets, threshold, min_words, decision,
reason)`` over named term sets. It compiles to one CASE WHEN chain (first match wins,
evaluated lazily in order), so the whole policy is one projection with no shuffle; long term
sets are scanned in front of it, one pass over a text per set.

Rule kinds
  any             any term of sets[0] occurs (substring)
  any_and_any     a term of sets[0] and a term of sets[1] occur
  count_at_least  at least ``threshold`` distinct terms of sets[0] occur
  low_confidence  confidence < threshold, >= min_words words, and a term of sets[0]
  max_words       at most ``threshold`` words
  no_evidence     no retrieved case
  low_similarity  top similarity < threshold (a missing score skips the rule)
  default         always
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.functions.text import SCAN_FROM, at_least_words, contains_any, count_terms, normalise, scan_terms

ESCALATE = "ESCALATE"
AUTO = "AUTO-HANDLE"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    decision: str
    reason: str
    sets: tuple[str, ...] = ()
    threshold: float | None = None
    min_words: int | None = None


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    term_sets: dict


# ---------------------------------------------------------------------------------
# Term lists, thresholds, decisions and reasons of the reference policies.
# ---------------------------------------------------------------------------------
V2_SETS = {
    "high_risk": (
        "security breach", "hacked", "hack", "stole", "stolen", "fraud", "unauthorized",
        "account compromised", "charged", "charge", "charged me", "charged twice", "money taken",
        "payment", "payment issue", "payment problem", "payment failed", "purchase missing",
        "missing purchase", "purchase isn't showing", "purchase isnt showing", "buy again",
        "buy it again", "can't verify", "cannot verify", "unable to verify", "verification",
        "activation", "activate", "activation issue", "activation impossible", "can't activate",
        "cannot activate", "unable to activate", "upgrade program", "order", "refund",
        "account locked", "can't access my account", "cannot access my account",
        "unable to access my account",
    ),
    "serious_device": (
        "won't turn on", "wont turn on", "will not turn on", "can't turn on", "cannot turn on",
        "won't power on", "wont power on", "will not power on", "phone is dead", "iphone is dead",
        "ipad is dead", "mac is dead", "device is dead", "completely dead", "dead", "unresponsive",
        "device hung", "cracked screen", "cracked iphone", "screen is cracked", "screen has cracked",
        "screen is broken", "screen has broken", "broken screen", "screen broke", "screen broken",
        "needs screen repair", "need screen repair", "screen repair", "screen replacement",
        "need repair", "needs repair", "headphones broke", "charger broke", "charger stopped",
        "cable broke", "physical damage", "defective", "damaged",
    ),
    "data_loss": (
        "photos disappeared", "photos are gone", "photos gone", "photos missing",
        "pictures disappeared", "pictures are gone", "pictures gone", "pictures missing",
        "text messages are gone", "text messages disappeared", "messages are gone",
        "messages disappeared", "messages missing", "data disappeared", "data is gone",
        "lost my data", "lost all my", "backup incomplete", "backup is incomplete", "backup failed",
        "backup missing", "backup hasn't completed", "backup hasnt completed", "not transferred",
        "only 200 of", "only 200",
    ),
    "repeated": (
        "again", "third time", "twice", "happened twice", "happened again", "multiple times",
        "several times", "repeatedly", "still not", "still doesn't", "still doesnt", "still won't",
        "still wont", "still not fixed", "still not working", "still broken", "doesn't help",
        "doesnt help", "not responding", "no response", "no answer", "nobody answers",
        "no one answers", "haven't helped", "havent helped", "no help", "months", "weeks",
        "for hours", "called multiple times", "called several times", "called many times",
        "contacted multiple times", "contacted several times", "multiple calls", "four calls",
        "nothing works", "nothing has been done",
    ),
    "update": (
        "ios 11", "ios 11.0", "ios 11.0.3", "ios 11.1", "ios 11.1.1", "latest update",
        "after updating", "after the update", "after an update", "since updating",
        "since the update", "updated and now", "update has", "update ruined", "update wrecked",
        "update broke", "downgrade",
    ),
    "severe_failure": (
        "crash", "crashes", "crashing", "freeze", "freezes", "freezing", "frozen", "restart",
        "restarts", "restarting", "restarting over", "won't work", "wont work", "can't use",
        "cant use", "unresponsive", "dead", "slow", "hangs", "heats up", "overheating",
        "battery life is awful", "apps don't work", "apps dont work", "apps freezing",
        "apps shutting down", "phone is ruined", "ruined my phone", "wrecked my phone",
        "dumpster fire", "mess", "joke", "crap", "junk",
    ),
    "technical": (
        "freezing", "freezes", "crashing", "crashes", "restarting", "restarts", "slow",
        "heats up", "battery", "wifi", "wi-fi", "bluetooth", "camera", "apps", "app",
        "can't connect", "cant connect", "won't connect", "wont connect", "not working",
        "doesn't work", "doesnt work",
    ),
    "distress": (
        "wtf", "shit", "f**king", "fuck", "fucked", "ridiculous", "terrible", "awful",
        "disappointed", "hate", "do better", "fix this now", "what a mess", "joke", "crap", "junk",
    ),
    "problem": (
        "problem", "issue", "error", "broken", "not working", "doesn't work", "doesnt work",
        "won't", "wont", "can't", "cant", "help", "failed", "failure",
    ),
}

V2_REASONS = {
    "M1": "High-risk account, payment, purchase, activation, or security issue.",
    "M2": "Serious device or hardware failure requires human support.",
    "M3": "Potential data loss or missing user content requires human support.",
    "M4": "Repeated or unresolved support issue.",
    "M5": "Update-related failure is causing significant device or software problems.",
    "M6": "Multiple simultaneous technical problems indicate a complex case.",
    "M7": "Strong customer dissatisfaction combined with a technical problem.",
    "M8": "Low classification confidence for a concrete customer problem.",
    "M9": "No relevant historical support evidence was retrieved.",
    "M10": "Historical evidence is too weak for confident automated handling.",
    "M11": "Relevant historical evidence supports automated handling.",
}

V1_SETS = {
    "sensitive": (
        "hacked", "stolen", "fraud", "unauthorized", "charged twice", "refund", "charged me",
        "payment issue", "payment problem", "purchase missing", "missing purchase",
        "order does not belong", "order not belong", "account locked", "can't access my account",
        "cannot access my account", "unable to access my account", "can't activate",
        "cannot activate", "unable to activate", "activation impossible", "physical damage",
        "cracked screen", "cracked iphone", "defective", "damaged", "won't turn on",
        "will not turn on", "can't turn on", "cannot turn on", "phone is dead", "iphone is dead",
    ),
    "repeated": (
        "no response", "no one responded", "nobody responded", "not responding",
        "support not responding", "no answer", "nobody answers", "no one answers",
        "called multiple times", "called several times", "called many times",
        "contacted multiple times", "contacted several times", "four calls", "multiple calls",
        "for months", "for weeks", "been trying for months", "been trying for weeks",
        "still not fixed", "still not working", "still broken", "again and again",
        "multiple times", "several times", "nothing has been done", "no help", "nobody can help",
        "unable to get help", "filed two reports", "filed multiple reports", "tried everything",
        "nothing works",
    ),
    "data_loss": (
        "all my photos are gone", "all photos are gone", "photos disappeared", "photos missing",
        "all my messages are gone", "all messages are gone", "messages disappeared",
        "messages missing", "data is gone", "data disappeared", "backup is incomplete",
        "backup failed", "backup missing",
    ),
    "problem": (
        "can't", "cannot", "unable", "won't", "will not", "not working", "doesn't work",
        "does not work", "broken", "problem", "issue", "error", "failed", "failure", "missing",
        "disappeared", "crash", "crashes", "crashing", "freezing", "frozen", "keeps restarting",
        "keeps crashing", "please fix", "help me fix", "how do i fix",
    ),
    "serious_device": (
        "phone won't turn on", "iphone won't turn on", "ipad won't turn on", "mac won't turn on",
        "phone is completely dead", "iphone is completely dead", "device is completely dead",
        "overheating", "overheats", "smoke coming", "burning smell",
    ),
}

V1_REASONS = {
    "V1": ("The request contains a sensitive, account, payment, activation, or serious device "
           "issue that should be reviewed by a human."),
    "V2": ("The customer reports a repeated or unresolved support problem that is better "
           "handled by a human agent."),
    "V3": ("The customer reports possible data loss or missing personal data, so human review "
           "is recommended."),
    "V4": ("The message is very short or ambiguous, so automatic escalation is avoided until "
           "more information is available."),
    "V5": ("The intent confidence is low and the customer describes a concrete technical "
           "problem that may require human review."),
    "V6": "No relevant historical {brand} evidence was retrieved.",
    "V7": "The most similar historical cases have low similarity to the customer's issue.",
    "V8": ("The customer describes a potentially serious device failure that should be "
           "reviewed by a human."),
    "V9": ("The intent is reasonably clear and relevant historical {brand} evidence was "
           "found, so the request can be auto-handled."),
}


def _v2_rules(sim_gate: float, tech_count: int) -> tuple[Rule, ...]:
    R = V2_REASONS
    return (
        Rule("M1", "any", ESCALATE, R["M1"], ("high_risk",)),
        Rule("M2", "any", ESCALATE, R["M2"], ("serious_device",)),
        Rule("M3", "any", ESCALATE, R["M3"], ("data_loss",)),
        Rule("M4", "any", ESCALATE, R["M4"], ("repeated",)),
        Rule("M5", "any_and_any", ESCALATE, R["M5"], ("update", "severe_failure")),
        Rule("M6", "count_at_least", ESCALATE, R["M6"], ("technical",), threshold=tech_count),
        Rule("M7", "any_and_any", ESCALATE, R["M7"], ("distress", "technical")),
        Rule("M8", "low_confidence", ESCALATE, R["M8"], ("problem",), threshold=0.45, min_words=5),
        Rule("M9", "no_evidence", ESCALATE, R["M9"]),
        Rule("M10", "low_similarity", ESCALATE, R["M10"], threshold=sim_gate),
        Rule("M11", "default", AUTO, R["M11"]),
    )


def _v1_rules(sim_gate: float, brand: str) -> tuple[Rule, ...]:
    R = {k: v.replace("{brand}", brand) for k, v in V1_REASONS.items()}
    return (
        Rule("V1", "any", ESCALATE, R["V1"], ("sensitive",)),
        Rule("V2", "any", ESCALATE, R["V2"], ("repeated",)),
        Rule("V3", "any", ESCALATE, R["V3"], ("data_loss",)),
        Rule("V4", "max_words", AUTO, R["V4"], threshold=3),
        Rule("V5", "low_confidence", ESCALATE, R["V5"], ("problem",), threshold=0.45, min_words=5),
        Rule("V6", "no_evidence", ESCALATE, R["V6"]),
        Rule("V7", "low_similarity", ESCALATE, R["V7"], threshold=sim_gate),
        Rule("V8", "any", ESCALATE, R["V8"], ("serious_device",)),
        Rule("V9", "default", AUTO, R["V9"]),
    )


def policy_v2(sim_gate: float = 0.55, tech_count: int = 3) -> Policy:
    """The current policy."""
    return Policy("policy_v2", _v2_rules(sim_gate, tech_count), V2_SETS)


def policy_v1(sim_gate: float = 0.55, brand: str = "AppleSupport") -> Policy:
    """The earlier policy (short messages are auto-handled before the evidence gates)."""
    return Policy("policy_v1", _v1_rules(sim_gate, brand), V1_SETS)


# Stand-in term sets for the driver's invented text; same rule chains.
STAND_IN_SETS = {
    "high_risk": ("die",),
    "serious_device": ("anea",),
    "data_loss": ("eaux",),
    "repeated": ("ción",),
    "update": ("this",),
    "severe_failure": ("thble",),
    "technical": ("thnd", "der", "ther", "thor", "erin", "thre"),
    "distress": ("thha",),
    "problem": ("tion",),
}
STAND_IN_V1_SETS = {
    "sensitive": ("die", "anea"),
    "repeated": ("ción",),
    "data_loss": ("eaux",),
    "problem": ("tion",),
    "serious_device": ("thble",),
}


def stand_in_v2(sim_gate: float = 0.40, tech_count: int = 5) -> Policy:
    return Policy("stand_in_v2", _v2_rules(sim_gate, tech_count), STAND_IN_SETS)


def stand_in_v1(sim_gate: float = 0.40, brand: str = "AppleSupport") -> Policy:
    return Policy("stand_in_v1", _v1_rules(sim_gate, brand), STAND_IN_V1_SETS)


# ---------------------------------------------------------------------------------
def rule_condition(rule: Rule, sets: dict, t: Column, confidence: Column, n_hits: Column,
                   top_score: Column, found: Column | None = None) -> Column:
    """``found``: the text's scan (``set_scan``), if the term sets are scanned."""
    k = rule.kind

    def any_of(s: str) -> Column:
        return contains_any(t, sets[s]) if found is None else found[s] > 0
    if k == "any":
        return any_of(rule.sets[0])
    if k == "any_and_any":
        return any_of(rule.sets[0]) & any_of(rule.sets[1])
    if k == "count_at_least":
        n = count_terms(t, sets[rule.sets[0]]) if found is None else found[rule.sets[0]]
        return n >= F.lit(int(rule.threshold))
    if k == "low_confidence":
        return ((confidence < F.lit(float(rule.threshold))) & at_least_words(t, rule.min_words)
                & any_of(rule.sets[0]))
    if k == "max_words":
        return ~at_least_words(t, int(rule.threshold) + 1)
    if k == "no_evidence":
        return F.coalesce(n_hits, F.lit(0)) == 0
    if k == "low_similarity":
        return top_score < F.lit(float(rule.threshold))
    if k == "default":
        return F.lit(True)
    raise ValueError(f"unknown rule kind {k}")


def set_scan(t: Column, policy: Policy) -> Column | None:
    """The term sets of a policy with long lists, scanned once (H3-H6); None for short ones."""
    groups = {s: [(term, False, 1) for term in terms] for s, terms in policy.term_sets.items()}
    if sum(map(len, groups.values())) < SCAN_FROM:
        return None
    return scan_terms(t, groups, sums={r.sets[0] for r in policy.rules if r.kind == "count_at_least"})


def decide(df: DataFrame, policy: Policy, text_col: str = "text", confidence_col: str = "confidence",
           n_hits_col: str | None = "n_hits", top_score_col: str | None = "top_score") -> DataFrame:
    """Adds ``rule_id, decision, reason`` (exactly one rule per row)."""
    df = df.withColumn("__t", normalise(text_col))
    t = F.col("__t")
    conf = F.col(confidence_col).cast("double")
    hits = F.col(n_hits_col) if n_hits_col else F.lit(0)
    top = F.col(top_score_col).cast("double") if top_score_col else F.lit(None).cast("double")
    scan, found = set_scan(t, policy), None
    if scan is not None:
        df, found = df.withColumn("__found", scan), F.col("__found")
    out = None
    for r in policy.rules:
        cond = rule_condition(r, policy.term_sets, t, conf, hits, top, found)
        val = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.decision).alias("decision"),
                       F.lit(r.reason).alias("reason"))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return (df.withColumn("__d", out)
            .withColumns({"rule_id": F.col("__d.rule_id"), "decision": F.col("__d.decision"),
                          "reason": F.col("__d.reason")})
            .drop("__d", "__t", "__found"))


def policy_diff(old: DataFrame, new: DataFrame, key: str = "tweet_id") -> DataFrame:
    """How decisions move between two policy versions over the same messages."""
    return (old.select(key, F.col("decision").alias("old_decision"), F.col("rule_id").alias("old_rule"))
            .join(new.select(key, F.col("decision").alias("new_decision"),
                             F.col("rule_id").alias("new_rule")), key)
            .groupBy("old_decision", "new_decision")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("old_rule") != F.col("new_rule")).alias("rule_changed")))
