"""SQL text for the DuckDB oracles, generated from the same lexicon / policy data.

The oracle is an independent formulation in SQL (RE2 regexes, CASE chains, window
functions); only the term tables and the lists of fixed texts are shared with the Spark
side. The patterns below are written anew, in RE2's own classes.
"""

from __future__ import annotations

import re

from supportflow.operators.lexicon import FirstMatch, Lexicon
from supportflow.operators.policy import Policy


BLANK = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"      # what Python's str.strip() and split() cut at
SOLID = r"[^\s\x0B\x1C-\x1F\x{85}\pZ]"
WORD = r"_\pL\pN"                          # inside a class
GAP = r"[\s\x0B]"                          # ASCII blanks
TERM_TOKEN = r"[_\pL\pN][_\pL\pN]+"       # two or more word characters
STRIP_RE = f"^{BLANK}+|{BLANK}+$"
LABELS = {"correctness": "correctness", "groundedness": "groundedness", "helpfulness": "helpfulness",
          "brand_consistency": "brand(?:[ _]?consistency)?", "safety": "safety", "overall": "overall"}


def quoted(term: str) -> str:
    """A literal inside a pattern: every ASCII character that is no letter or digit escaped."""
    return re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", term)


def prefixes(texts) -> str:
    return "^" + "".join(f"({quoted(t)}{BLANK}*)?" for t in texts)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(STRIP_RE)}, '', 'g')"


def norm(x: str, do_strip: bool = True) -> str:
    inner = f"coalesce({x}, '')"
    return f"lower({strip(inner) if do_strip else inner})"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(SOLID + '+')}))"


def has_word(x: str, w: str) -> str:
    return f"regexp_matches({x}, {lit(f'(^|[^{WORD}]){quoted(w)}([^{WORD}]|$)')})"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")" if terms else "false"


def count_of(x: str, terms) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {lit(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"


def label_score_sql(t: str, lex: Lexicon) -> dict[str, str]:
    out = {}
    for r in lex.labels:
        parts = [f"(CASE WHEN {has_word(t, x.term) if x.kind == 'word' else f'contains({t}, {lit(x.term)})'} "
                 f"THEN {x.weight} ELSE 0 END)" for x in r.terms]
        raw = "(" + " + ".join(parts) + ")" if parts else "0"
        if r.boost:
            gate = f" AND {has_word(t, r.gate_word)}" if r.gate_word else ""
            raw = f"({raw} + CASE WHEN {raw} > 0{gate} THEN {r.boost} ELSE 0 END)"
        out[r.label] = raw
    return out


def classify_sql(src: str, text_col: str, lex: Lexicon, override: bool, keep: list[str]) -> str:
    """SELECT keep..., intent, confidence FROM src (as a nested query)."""
    scores = label_score_sql("t", lex)
    cols = ", ".join(f"{v} AS \"s_{k}\"" for k, v in scores.items())
    labels = [r.label for r in lex.labels]
    g = "greatest(" + ", ".join(f'"s_{k}"' for k in labels) + ")"
    argmax = "CASE " + " ".join(f"WHEN \"s_{k}\" = {g} THEN {lit(k)}" for k in labels) + " END"
    chosen = argmax
    if override:
        pri = sorted((r for r in lex.labels if r.priority is not None), key=lambda r: r.priority)
        whens = []
        for r in pri:
            cond = f'"s_{r.label}" > 0' + (f" AND {has_word('t', r.gate_word)}" if r.gate_word else "")
            whens.append(f"WHEN {cond} THEN {lit(r.label)}")
        chosen = "CASE " + " ".join(whens) + f" ELSE {argmax} END"
    best_score = "CASE c.lbl " + " ".join(f"WHEN {lit(k)} THEN \"s_{k}\"" for k in labels) + " END"
    keep_s = ", ".join(keep)
    return f"""(SELECT {keep_s},
       CASE WHEN bs = 0 THEN {lit(lex.fallback)} ELSE lbl END AS intent,
       CASE WHEN bs = 0 THEN {lex.fallback_confidence}::DOUBLE
            ELSE least({lex.cap}::DOUBLE, {lex.base}::DOUBLE + bs::DOUBLE * {lex.step}::DOUBLE) END AS confidence
  FROM (SELECT c.*, {best_score} AS bs FROM (
          SELECT s.*, {chosen} AS lbl FROM (
            SELECT src.*, {cols} FROM (SELECT *, {norm(text_col)} AS t FROM {src}) src) s) c))"""


def first_match_sql(text_col: str, fm: FirstMatch) -> str:
    t = norm(text_col, fm.strip)
    whens = " ".join(f"WHEN {any_of(t, terms)} THEN {lit(label)}" for label, terms in fm.rules)
    return f"CASE {whens} ELSE {lit(fm.fallback)} END"


def decide_sql(policy: Policy, t: str, conf: str, n_hits: str, top: str) -> str:
    """CASE expression giving rule_id."""
    sets = policy.term_sets
    whens = []
    for r in policy.rules:
        k = r.kind
        if k == "any":
            c = any_of(t, sets[r.sets[0]])
        elif k == "any_and_any":
            c = f"{any_of(t, sets[r.sets[0]])} AND {any_of(t, sets[r.sets[1]])}"
        elif k == "count_at_least":
            c = f"{count_of(t, sets[r.sets[0]])} >= {int(r.threshold)}"
        elif k == "low_confidence":
            c = (f"{conf} < {float(r.threshold)}::DOUBLE AND {word_count(t)} >= {r.min_words} "
                 f"AND {any_of(t, sets[r.sets[0]])}")
        elif k == "max_words":
            c = f"{word_count(t)} <= {int(r.threshold)}"
        elif k == "no_evidence":
            c = f"coalesce({n_hits}, 0) = 0"
        elif k == "low_similarity":
            c = f"{top} < {float(r.threshold)}::DOUBLE"
        else:
            c = "true"
        whens.append(f"WHEN {c} THEN {lit(r.rule_id)}")
    return "CASE " + " ".join(whens) + " END"


def rule_lookup_sql(policy: Policy, rule_col: str, field: str) -> str:
    return ("CASE " + " ".join(f"WHEN {rule_col} = {lit(r.rule_id)} THEN {lit(getattr(r, field))}"
                               for r in policy.rules) + " END")


# ------------------------------------------------------------------------------
# Parsers (N2, H19-H24) as CTE chains
# ------------------------------------------------------------------------------
def _after(x: str, marker: str) -> str:
    return f"substr({x}, strpos({x}, {lit(marker)}) + {len(marker)})"


def _is_obj(x: str) -> str:
    return f"(starts_with({x}, '{{') AND ends_with({x}, '}}') AND coalesce(json_valid({x}), false))"


def _jstr(x: str, key: str) -> str:
    return f"json_extract_string(TRY_CAST({x} AS JSON), {lit('$.' + key)})"


def clean_replies_ctes(src: str, brand: str, out: str = "cleaned") -> str:
    """CTEs ending in ``out(id, reply, reject_reason)`` from ``src(id, raw)``."""
    from supportflow.functions.parsing import BAD_STARTS, FINAL_PREFIXES, REPLY_PREFIXES, reasoning_markers
    reply_object = f'(?s:{{{{.*?"reply"{GAP}*:{GAP}*".*?"{GAP}*}}}})'.replace("{{", r"\{").replace("}}", r"\}")
    bad = " OR ".join(f"starts_with(r1, {lit(b)})" for b in BAD_STARTS)
    mk = " OR ".join(f"contains(r1, {lit(m)})" for m in reasoning_markers(brand))
    return f"""{out}_a AS (SELECT id, {strip("coalesce(raw, '')")} AS raw FROM {src}),
{out}_b AS (SELECT *, {_is_obj('raw')} AS is_obj,
       CASE WHEN contains(raw, '</think>') THEN {strip(_after('raw', '</think>'))} ELSE raw END AS c1 FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN is_obj THEN {_jstr('raw', 'reply')} END AS jr,
       CASE WHEN contains(c1, '<think>') THEN {strip(_after('c1', '<think>'))} ELSE c1 END AS c2 FROM {out}_b),
{out}_d AS (SELECT *, regexp_extract_all(c2, {lit(reply_object)})[-1] AS cand FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN {_is_obj('cand')} THEN {_jstr('cand', 'reply')} END AS cr FROM {out}_d),
{out}_f AS (SELECT *, regexp_replace({strip("coalesce(CASE WHEN is_obj THEN jr WHEN coalesce(cr, '') <> '' THEN cr ELSE c2 END, '')")},
                                 {lit(prefixes(REPLY_PREFIXES))}, '') AS r1 FROM {out}_e),
{out}_g AS (SELECT *, CASE WHEN raw = '' THEN 'empty'
                      WHEN is_obj AND coalesce(jr, '') = '' THEN 'json_without_reply'
                      WHEN starts_with(r1, '{{') OR starts_with(r1, '[') THEN 'structured'
                      WHEN {bad} THEN 'reasoning_start'
                      WHEN {mk} THEN 'reasoning_marker'
                      WHEN length(r1) < 10 THEN 'too_short'
                      WHEN length(r1) > 1000 THEN 'too_long' END AS rr,
                 regexp_replace(r1, {lit(prefixes(FINAL_PREFIXES))}, '') AS r2 FROM {out}_f),
{out} AS (SELECT id, CASE WHEN rr IS NULL AND r2 <> '' THEN r2 END AS reply,
                 CASE WHEN rr IS NULL AND r2 = '' THEN 'empty' ELSE rr END AS reject_reason FROM {out}_g)"""


def judge_six_ctes(src: str, out: str = "six") -> str:
    """CTEs ending in ``out(id, six metrics, method, parsed)`` from ``src(id, raw)``."""
    from supportflow.functions.parsing import JUDGE_METRICS
    SP = GAP
    nb, na = f"(?:^|[^{WORD}])", f"(?:[^{WORD}]|$)"

    def first_score(v):
        d = f"regexp_extract({v}, {lit(f'(?:^|[^{WORD}])([1-5])(?:[^{WORD}]|$)')}, 1)"
        return f"CASE WHEN coalesce({d}, '') <> '' THEN CAST({d} AS INTEGER) ELSE 0 END"
    d = "([1-5])"
    pats = [nb + (SP + "+").join([d] * 6) + na, nb + (SP + "*," + SP + "*").join([d] * 6) + na,
            nb + r"\|".join([d] * 6) + na]
    keys = " AND ".join(f"coalesce(json_exists(TRY_CAST(js AS JSON), '$.{m}'), false)" for m in JUDGE_METRICS)
    jcols = ", ".join(f"{first_score(_jstr('js', m))} AS j_{m}" for m in JUDGE_METRICS)
    lcols = ", ".join(f"regexp_extract(tl, {lit(f'(?i){p}{SP}*[:=\\-]{SP}*([1-5])')}, 1) AS l_{m}"
                      for m, p in LABELS.items())
    scols = ", ".join(f"regexp_extract(t3, {lit(p)}, {i + 1}) AS s{pi}_{i}" for pi, p in enumerate(pats)
                      for i in range(6))
    json_ok = keys + " AND " + " AND ".join(f"j_{m} > 0" for m in JUDGE_METRICS)
    lab_ok = " AND ".join(f"l_{m} <> ''" for m in JUDGE_METRICS)
    seq_pick = []
    for i, m in enumerate(JUDGE_METRICS):
        seq_pick.append(f"CASE WHEN s0_0 <> '' THEN s0_{i} WHEN s1_0 <> '' THEN s1_{i} ELSE s2_{i} END")
    metric_cols = ", ".join(
        f"CASE method WHEN 'json' THEN j_{m} WHEN 'labelled' THEN CAST(l_{m} AS INTEGER) "
        f"WHEN 'sequence' THEN CAST({seq_pick[i]} AS INTEGER) ELSE 0 END AS {m}"
        for i, m in enumerate(JUDGE_METRICS))
    cands = f"list_filter(list_reverse(regexp_extract_all(t2, {lit(r'(?s)\{.*?\}')})), lambda x: {_is_obj('x')})[1]"
    return f"""{out}_a AS (SELECT id, coalesce(raw, '') AS raw, {strip("coalesce(raw, '')")} AS t FROM {src}),
{out}_b AS (SELECT *, contains(t, '</think>') AS has_end,
       CASE WHEN contains(t, '</think>') THEN {strip(_after('t', '</think>'))} ELSE '' END AS after,
       CASE WHEN contains(raw, '</think>') AND {strip(_after('raw', '</think>'))} <> '' THEN {_after('raw', '</think>')}
            ELSE raw END AS tl FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN has_end THEN after ELSE t END AS t2,
       CASE WHEN has_end AND after <> '' THEN after ELSE t END AS t3 FROM {out}_b),
{out}_d AS (SELECT *, coalesce(CASE WHEN {_is_obj('t')} THEN t END,
                             CASE WHEN has_end AND {_is_obj('after')} THEN after END,
                             {cands}) AS js FROM {out}_c),
{out}_e AS (SELECT *, {jcols}, {lcols}, {scols} FROM {out}_d),
{out}_f AS (SELECT *, CASE WHEN raw = '' THEN NULL WHEN {json_ok} THEN 'json' WHEN {lab_ok} THEN 'labelled'
                           WHEN s0_0 <> '' OR s1_0 <> '' OR s2_0 <> '' THEN 'sequence' END AS method
            FROM {out}_e),
{out} AS (SELECT id, {metric_cols}, method, method IS NOT NULL AS parsed FROM {out}_f)"""


def last_score_sql(x: str) -> str:
    a = strip(f"coalesce({x}, '')")
    a2 = f"CASE WHEN contains({a}, '<think>') AND contains({a}, '</think>') THEN {strip(_after(a, '</think>'))} ELSE {a} END"
    runs = f"regexp_extract_all({a2}, '[0-9]+')"
    return f"CAST(list_filter({runs}, lambda r: r IN ('1', '2', '3', '4', '5'))[-1] AS INTEGER)"
