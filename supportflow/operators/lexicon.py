"""Intent classification with weighted term tables.

A lexicon is data: per label, terms with a match kind ('phrase' = substring, 'word' =
whole word) and a weight, plus an optional boost, gate word and priority. The classifier
is one projection without a shuffle: native expressions, for long lists one scan per label. ``lexicon_table`` renders
a lexicon as the FIXTURES ``lexicon`` table; ``lexicon_from_rows`` reads one back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.functions.text import SCAN_FROM, contains_any, has_word, normalise, scan_terms

GENERAL = "general_support"


@dataclass(frozen=True)
class Term:
    term: str
    kind: str  # 'phrase' | 'word' (K2: strong-signal bonuses are 'word' terms of their own weight)
    weight: int


@dataclass(frozen=True)
class LabelRule:
    label: str
    terms: tuple[Term, ...] = ()
    boost: int = 0              # K3: added when score > 0 (and the gate word is present)
    gate_word: str | None = None
    priority: int | None = None  # K4: lower wins before the argmax


@dataclass(frozen=True)
class Lexicon:
    version: str
    labels: tuple[LabelRule, ...]   # declared order = argmax tie order
    fallback: str = GENERAL
    fallback_confidence: float = 0.40    # K5: no match -> (fallback, 0.40)
    base: float = 0.55                   # K5: min(cap, base + step * score)
    step: float = 0.08
    cap: float = 0.95


@dataclass(frozen=True)
class FirstMatch:
    """K8/K9: ordered (label, substrings); first label with any hit wins."""
    version: str
    rules: tuple[tuple[str, tuple[str, ...]], ...]
    fallback: str = GENERAL
    strip: bool = False


def _phrases(terms: list[str], w: int) -> tuple[Term, ...]:
    return tuple(Term(t, "phrase", w) for t in terms)


# ---------------------------------------------------------------------------------
# Label names, term lists, weights and order of the reference classifier.
# ---------------------------------------------------------------------------------
UPDATE = "ios_update_issue"
BATTERY = "battery_issue"
KEYBOARD = "keyboard_input_issue"
APP = "app_media_issue"
ACCOUNT = "account_purchase_issue"
HARDWARE = "hardware_device_issue"
LABEL_ORDER = (UPDATE, BATTERY, KEYBOARD, APP, ACCOUNT, HARDWARE, GENERAL)

BATTERY_PHRASES = [
    "battery", "battery drain", "battery draining", "battery life", "battery dies",
    "battery dying", "not holding a charge", "won't hold a charge", "charging problem",
    "charging issue", "charger", "overheating", "overheat", "phone is hot", "iphone is hot",
]
KEYBOARD_PHRASES = [
    "keyboard", "typing", "autocorrect", "auto correct", "keypad", "predictive text",
    "predictive", "question mark", "question marks", "letter i", "replace my i",
    "replacing my", "keys not working", "keyboard not working", "can't type",
    "cannot type", "unable to type",
]
ACCOUNT_PHRASES = [
    "apple id", "password", "login", "log in", "sign in", "account", "payment", "paid",
    "charged", "charged twice", "refund", "purchase", "purchased", "billing", "order",
    "activation", "activate", "subscription", "applecare", "buy again", "buy it again",
    "missing purchase", "purchase missing", "payment failed", "billing problem",
]
ACCOUNT_STRONG = [
    "apple id", "refund", "charged twice", "purchase missing", "missing purchase",
    "payment failed", "billing problem", "buy again",
]
HARDWARE_PHRASES = [
    "screen", "display", "broken", "cracked", "physical damage", "hardware", "button",
    "speaker", "won't turn on", "will not turn on", "can't turn on", "cannot turn on",
    "dead phone", "defective", "damaged", "phone is dead", "iphone is dead",
    "device is dead", "won't power on", "power button", "screen broken", "screen cracked",
]
UPDATE_PHRASES = [
    "ios", "ios update", "software update", "system update", "updating", "upgrade",
    "upgraded", "high sierra", "software version", "latest version", "downgrade", "update",
    "updated", "after updating", "after the update", "after an update", "since updating",
    "since the update",
]
APP_PHRASES = [
    "app store", "apple music", "itunes", "photos", "photo", "pictures", "picture",
    "videos", "video", "camera", "icloud", "imessage", "messages", "message", "apple maps",
    "maps", "facetime", "safari", "pages", "backup", "back up", "backup failed",
    "photos missing", "photos disappeared", "music disappeared", "music missing",
    "messages disappeared", "messages missing", "videos missing", "app crashing",
    "apps crashing", "application crashing", "application not working",
    "apps not working", "app not working",
]

CLASSIFIER = Lexicon("classifier_v2", (
    LabelRule(UPDATE, _phrases(UPDATE_PHRASES, 2) + (Term("ios", "word", 3),)),
    LabelRule(BATTERY, _phrases(BATTERY_PHRASES, 2) + (Term("battery", "word", 4),),
              boost=3, gate_word="battery", priority=1),
    LabelRule(KEYBOARD, _phrases(KEYBOARD_PHRASES, 3), boost=2, priority=2),
    LabelRule(APP, _phrases(APP_PHRASES, 2) + (Term("app", "word", 1), Term("apps", "word", 1))),
    LabelRule(ACCOUNT, _phrases(ACCOUNT_PHRASES, 2) + _phrases(ACCOUNT_STRONG, 3)),
    LabelRule(HARDWARE, _phrases(HARDWARE_PHRASES, 3), boost=1, priority=3),
    LabelRule(GENERAL),
))

# Weak labeller for training data, first match in this order.
WEAK_LABELS = FirstMatch("weak_v1", (
    (KEYBOARD, ("keyboard", "typing", "autocorrect", "keypad", "predictive", "question mark",
                "question marks", "letter i", "replace my i")),
    (BATTERY, ("battery", "battery life", "battery drain", "draining", "charging", "charger",
               "overheating", "overheat")),
    (ACCOUNT, ("apple id", "password", "login", "log in", "sign in", "account", "payment",
               "charged", "refund", "purchase", "purchased", "billing", "order", "activation",
               "activate", "subscription", "applecare")),
    (HARDWARE, ("screen", "display", "broken", "cracked", "hardware", "button", "won't turn on",
                "will not turn on", "dead phone", "defective", "damaged")),
    (UPDATE, ("ios", "update", "updating", "software update", "software", "upgraded", "upgrade",
              "high sierra", "system update", "latest version", "version")),
    (APP, ("app", "apps", "application", "apple music", "music", "itunes", "photo", "photos",
           "video", "picture", "icloud", "imessage", "messages", "message", "maps", "apple maps",
           "facetime", "safari", "app store", "pages", "backup")),
))

# Golden-set relabeller, other terms, and apps/media before update.
RELABEL = FirstMatch("relabel_v2", (
    (KEYBOARD, ("keyboard", "autocorrect", "auto correct", "typing", "type", "letter",
                "predictive text", "capitalizing", "question mark", '"i"', " i ")),
    (BATTERY, ("battery", "battery life", "battery drain", "draining", "charge", "charging",
               "charger", "usb port")),
    (ACCOUNT, ("apple id", "account", "password", "login", "log in", "purchase", "refund",
               "paypal", "order", "payment", "billing", "iphone x order", "upgrade program")),
    (HARDWARE, ("screen", "cracked", "won't turn on", "wont turn on", "broken", "hardware",
                "defective", "overheats", "phone is dead", "unresponsive")),
    (APP, ("app", "apps", "application", "camera", "photo", "photos", "picture", "pictures",
           "music", "itunes", "podcast", "video", "imessage", "airdrop", "maps", "icloud")),
    (UPDATE, ("ios", "update", "updated", "updating", "software", "high sierra", "latest version")),
))

# Stand-in lexicon for the driver's invented text; same labels and rules.
STAND_IN = Lexicon("stand_in", (
    LabelRule(UPDATE, (Term("this", "phrase", 2), Term("with", "word", 3))),
    LabelRule(BATTERY, (Term("thble", "phrase", 3), Term("ble", "word", 4)),
              boost=3, gate_word="ble", priority=1),
    LabelRule(KEYBOARD, (Term("thon ", "phrase", 3),), boost=2, priority=2),
    LabelRule(APP, (Term("from", "phrase", 2), Term("que", "phrase", 2))),
    LabelRule(ACCOUNT, (Term("die", "phrase", 2), Term("ung", "phrase", 2))),
    LabelRule(HARDWARE, (Term("anea", "phrase", 3),), boost=1, priority=3),
    LabelRule(GENERAL),
))

# Stand-in first-match labeller for documents (four invented languages).
STAND_IN_WEAK = FirstMatch("stand_in_weak", (
    (KEYBOARD, ("thon ",)),
    (BATTERY, ("thble",)),
    (ACCOUNT, ("die", "ung")),
    (HARDWARE, ("anea",)),
    (UPDATE, ("this",)),
    (APP, ("from", "que")),
))


# ---------------------------------------------------------------------------------
def _term_hit(t: Column, term: Term) -> Column:
    return has_word(t, term.term) if term.kind == "word" else t.contains(F.lit(term.term))


def label_scores(text, lex: Lexicon, normalised: bool = False) -> dict[str, Column]:
    """K1-K3: per-label score after boosts (every matching term adds its weight)."""
    t = F.col(text) if normalised else normalise(text)
    groups = {r.label: [(term.term, term.kind == "word", term.weight) for term in r.terms] for r in lex.labels}
    found = scan_terms(t, groups, sums=groups) if sum(map(len, groups.values())) >= SCAN_FROM else None
    out = {}
    for r in lex.labels:
        s = F.lit(0) if found is None else found[r.label]
        for term in r.terms if found is None else ():
            s = s + F.when(_term_hit(t, term), F.lit(term.weight)).otherwise(F.lit(0))
        if r.boost:
            gate = (s > 0) & (has_word(t, r.gate_word) if r.gate_word else F.lit(True))
            s = s + F.when(gate, F.lit(r.boost)).otherwise(F.lit(0))
        out[r.label] = s
    return out


def _score_col(label: str) -> str:
    return f"score_{label}"


def with_label_scores(df: DataFrame, text_col: str, lex: Lexicon, normalised: bool = False) -> DataFrame:
    return df.withColumns({_score_col(k): v for k, v in label_scores(text_col, lex, normalised).items()})


def classify(df: DataFrame, text_col: str = "text", lex: Lexicon = CLASSIFIER,
             override: bool = True, intent_col: str = "intent",
             confidence_col: str = "confidence", keep_scores: bool = False) -> DataFrame:
    """K6 (``override=True``) / K7 (``False``): adds intent and confidence columns."""
    # normalised text once as a column (the plan keeps it as one projection, not per term)
    scored = with_label_scores(df.withColumn("__t", normalise(text_col)), "__t", lex, normalised=True)
    t = F.col("__t")
    n = len(lex.labels)
    cand = {r.label: F.struct(F.col(_score_col(r.label)).alias("s"), F.lit(n - i).alias("o"),
                              F.lit(r.label).alias("l"))
            for i, r in enumerate(lex.labels)}
    best = F.array_max(F.array(*cand.values()))          # G6: max score, ties to declared order
    if override:
        for r in sorted((r for r in lex.labels if r.priority is not None), key=lambda r: r.priority,
                        reverse=True):
            cond = F.col(_score_col(r.label)) > 0
            if r.gate_word:
                cond = cond & has_word(t, r.gate_word)
            best = F.when(cond, cand[r.label]).otherwise(best)
    conf = F.least(F.lit(lex.cap), F.lit(lex.base) + F.col("__best.s").cast("double") * F.lit(lex.step))
    out = (scored.withColumn("__best", best)
           .withColumn(intent_col, F.when(F.col("__best.s") == 0, F.lit(lex.fallback))
                       .otherwise(F.col("__best.l")))
           .withColumn(confidence_col, F.when(F.col("__best.s") == 0, F.lit(lex.fallback_confidence))
                       .otherwise(conf))
           .drop("__best", "__t"))
    if not keep_scores:
        out = out.drop(*[_score_col(r.label) for r in lex.labels])
    return out


def first_match_label(text, fm: FirstMatch) -> Column:
    """K8/K9: ordered CASE WHEN over substring lists."""
    t = normalise(text, strip=fm.strip)
    groups = {f"g{i}": [(term, False, 1) for term in terms] for i, (_, terms) in enumerate(fm.rules)}
    found = scan_terms(t, groups) if sum(map(len, groups.values())) >= SCAN_FROM else None
    out = None
    for i, (label, terms) in enumerate(fm.rules):
        cond = contains_any(t, terms) if found is None else found[f"g{i}"] > 0
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(fm.fallback)) if out is not None else F.lit(fm.fallback)


def known_label(x, labels=LABEL_ORDER, fallback: str = GENERAL) -> Column:
    """Unknown or missing label -> fallback."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isin(*labels), c).otherwise(F.lit(fallback))


def lexicon_table(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """The lexicon as rows ``version, label, ord, term, match_kind, weight`` (+ label rules)."""
    rows = []
    for li, r in enumerate(lex.labels):
        for ti, t in enumerate(r.terms):
            rows.append((lex.version, r.label, li, ti, t.term, t.kind, t.weight, r.boost,
                         r.gate_word, r.priority))
        if not r.terms:                       # a label without terms (the fallback) keeps a row
            rows.append((lex.version, r.label, li, 0, None, None, None, r.boost, r.gate_word, r.priority))
    return spark.createDataFrame(rows, "version string, label string, label_ord int, ord int, term string, "
                                       "match_kind string, weight int, boost int, gate_word string, "
                                       "priority int")


def lexicon_from_rows(rows, version: str) -> Lexicon:
    """Inverse of ``lexicon_table`` from collected rows (a lexicon is a few hundred rows)."""
    by_label: dict[str, list] = {}
    meta: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["label_ord"], r["ord"])):
        by_label.setdefault(r["label"], [])
        if r["term"] is not None:
            by_label[r["label"]].append(Term(r["term"], r["match_kind"], r["weight"]))
        meta[r["label"]] = (r["label_ord"], r["boost"] or 0, r["gate_word"], r["priority"])
    labels = tuple(LabelRule(lb, tuple(ts), meta[lb][1], meta[lb][2], meta[lb][3])
                   for lb, ts in sorted(by_label.items(), key=lambda kv: meta[kv[0]][0]))
    return Lexicon(version, labels)


def label_distribution(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """value counts, count desc then label asc."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)


def majority_label(df: DataFrame, label_col: str) -> DataFrame:
    """the mode; ties go to the smallest label. One-row result.

    The grouped count is partial-aggregated map side; only one row per label is sorted.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label_col)).limit(1).select(
        F.col(label_col).alias("majority"), F.col("n").alias("majority_count"))
