"""DuckDB SQL oracles, one per registered query (same names, same column aliases).

Run over the driver's tables registered as views. Shared CTEs come from
``supportflow.plans.world``; lexicon / policy SQL from ``supportflow.plans.sqlgen``.
"""

from __future__ import annotations

from supportflow.operators import lexicon as L
from supportflow.operators import policy as P
from supportflow.plans import sqlgen as G
from supportflow.plans import world as Wd
from supportflow.plans.world import sql_with

ORACLES: dict[str, str] = {}

T, LK, CR, CS, MS, QV, CV, HT = Wd.ALL_WORLD

# ---------------------------------------------------------------- corpus
ORACLES["brand_replies"] = sql_with(T) + """
SELECT tweet_id, author_id, inbound, text, in_response_to_tweet_id FROM tweets
WHERE author_id = 'Brand' AND NOT inbound"""

ORACLES["linked_messages"] = sql_with(T, LK) + "\nSELECT * FROM linked"

ORACLES["linked_messages_reduced"] = ORACLES["linked_messages"]
ORACLES["first_in_file_order"] = """
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY r) AS k FROM d)
SELECT sha256(coalesce(text, '')) AS digest, doc_id, lang, source FROM f WHERE k = 1"""

ORACLES["build_cases"] = sql_with(T, LK, CR) + """
SELECT customer_tweet_id, created_at, customer_text, brand_reply_id, brand_reply FROM cases_raw
WHERE customer_text <> '' AND brand_reply <> ''"""

ORACLES["explode_reply_ids"] = sql_with(T.replace(
    "CAST(lead(conv_id * 1048576 + turn) OVER w AS VARCHAR) AS response_tweet_id",
    "concat_ws(',', CAST(lead(conv_id * 1048576 + turn) OVER w AS VARCHAR), "
    "CAST(lead(conv_id * 1048576 + turn, 3) OVER w AS VARCHAR)) AS response_tweet_id"), LK) + """
SELECT trim(u.rid) AS brand_reply_id, l.tweet_id AS customer_tweet_id, r.text AS brand_reply
FROM linked l, unnest(string_split(l.response_tweet_id, ',')) AS u(rid)
JOIN tweets r ON CAST(r.tweet_id AS VARCHAR) = trim(u.rid) AND r.author_id = 'Brand' AND NOT r.inbound"""

ORACLES["csv_exchange"] = sql_with(T) + """
SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id FROM tweets"""

ORACLES["corpus_audit"] = sql_with(T, LK, CR) + """
SELECT 'total_tweets' AS stage, count(*)::BIGINT AS rows FROM tweets
UNION ALL SELECT 'inbound_tweets', count(*) FILTER (WHERE inbound) FROM tweets
UNION ALL SELECT 'brand_replies', count(*) FILTER (WHERE author_id = 'Brand' AND NOT inbound) FROM tweets
UNION ALL SELECT 'linked_messages', count(*) FROM linked
UNION ALL SELECT 'cases', count(*) FROM cases_raw WHERE customer_text <> '' AND brand_reply <> ''"""

# ---------------------------------------------------------------- classification
_scores = G.label_score_sql("t", L.STAND_IN)
ORACLES["lexicon_scores"] = sql_with(MS) + "\nSELECT tweet_id, " + ", ".join(
    f"{v} AS score_{k}" for k, v in _scores.items()) + f"\nFROM (SELECT tweet_id, {G.norm('text')} AS t FROM messages)"

ORACLES["classify_intent"] = sql_with(MS) + "\nSELECT * FROM " + G.classify_sql(
    "messages", "text", L.STAND_IN, True, ["tweet_id"])
ORACLES["classify_intent_v1"] = sql_with(MS) + "\nSELECT * FROM " + G.classify_sql(
    "messages", "text", L.STAND_IN, False, ["tweet_id"])

ORACLES["weak_labels"] = (f"SELECT doc_id, {G.first_match_sql('text', L.WEAK_LABELS)} AS intent, "
                          f"{G.first_match_sql('text', L.STAND_IN_WEAK)} AS stand_in_intent FROM documents")

ORACLES["relabel"] = (f"SELECT doc_id, {G.first_match_sql('text', L.WEAK_LABELS)} AS intent, "
                      f"{G.first_match_sql('text', L.RELABEL)} AS intent_v2, "
                      f"CASE WHEN lang IN ({', '.join(G.lit(x) for x in L.LABEL_ORDER)}) THEN lang "
                      f"ELSE 'general_support' END AS lang_as_label FROM documents")

_cls = "SELECT * FROM " + G.classify_sql("messages", "text", L.STAND_IN, True, ["tweet_id"])
ORACLES["intent_distribution"] = sql_with(MS) + f"\nSELECT intent, count(*)::BIGINT AS n FROM ({_cls}) GROUP BY intent"
ORACLES["majority_label"] = sql_with(MS) + f"""
SELECT intent AS majority, n AS majority_count FROM (
  SELECT intent, count(*)::BIGINT AS n FROM ({_cls}) GROUP BY intent) ORDER BY n DESC, intent LIMIT 1"""

# ---------------------------------------------------------------- policy
_SCORED = f"""scored AS (
  SELECT c.tweet_id, c.intent, c.confidence, m.text,
         coalesce(h.n_hits, 0)::BIGINT AS n_hits, h.top_score
  FROM ({_cls}) c JOIN messages m USING (tweet_id)
  LEFT JOIN (SELECT qid, count(*) AS n_hits, max(score) AS top_score FROM hits GROUP BY qid) h
    ON h.qid = c.tweet_id)"""


def _decide_sql(policy: P.Policy) -> str:
    rid = G.decide_sql(policy, G.norm("text"), "confidence", "n_hits", "top_score")
    return (sql_with(T, LK, CR, CS, MS, QV, CV, HT, _SCORED) + f"""
SELECT tweet_id, intent, confidence, n_hits, round(top_score, 6) AS top_score, rule_id,
       {G.rule_lookup_sql(policy, 'rule_id', 'decision')} AS decision,
       {G.rule_lookup_sql(policy, 'rule_id', 'reason')} AS reason
FROM (SELECT *, {rid} AS rule_id FROM scored)""")


ORACLES["escalation_decisions"] = _decide_sql(P.stand_in_v2())
ORACLES["escalation_v1"] = _decide_sql(P.stand_in_v1())

_v1 = G.decide_sql(P.stand_in_v1(), G.norm("text"), "confidence", "n_hits", "top_score")
_v2 = G.decide_sql(P.stand_in_v2(), G.norm("text"), "confidence", "n_hits", "top_score")
ORACLES["policy_diff"] = sql_with(T, LK, CR, CS, MS, QV, CV, HT, _SCORED) + f"""
SELECT {G.rule_lookup_sql(P.stand_in_v1(), 'r1', 'decision')} AS old_decision,
       {G.rule_lookup_sql(P.stand_in_v2(), 'r2', 'decision')} AS new_decision,
       count(*)::BIGINT AS n, count(*) FILTER (WHERE r1 <> r2)::BIGINT AS rule_changed
FROM (SELECT {_v1} AS r1, {_v2} AS r2 FROM scored) GROUP BY ALL"""


from supportflow.plans.woven import SQL_WOVEN  # noqa: E402

ORACLES["classify_real"] = sql_with(SQL_WOVEN) + f"""
SELECT c.id, c.intent, c.confidence, {G.first_match_sql('c.text', L.WEAK_LABELS)} AS weak_label,
       {G.first_match_sql('c.text', L.RELABEL)} AS relabelled
FROM """ + G.classify_sql("woven", "text", L.CLASSIFIER, True, ["id", "text"]) + " c"


def _real_sql(policy: P.Policy) -> str:
    rid = G.decide_sql(policy, G.norm("text"), "confidence", "n_hits", "top_score")
    return sql_with(SQL_WOVEN) + f"""
SELECT id, intent, rule_id, {G.rule_lookup_sql(policy, 'rule_id', 'decision')} AS decision,
       {G.rule_lookup_sql(policy, 'rule_id', 'reason')} AS reason
FROM (SELECT *, {rid} AS rule_id FROM """ + G.classify_sql(
        "woven", "text", L.CLASSIFIER, True, ["id", "text", "n_hits", "top_score"]) + ")"


ORACLES["escalation_real"] = _real_sql(P.policy_v2())
ORACLES["escalation_real_v1"] = _real_sql(P.policy_v1())


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- threads and hold-out
GD, RT = Wd.SQL_GOLDEN, Wd.SQL_ROOTS
_HELD = """held AS (
  SELECT t.tweet_id, r.root AS conversation_root FROM tweets t JOIN roots r ON r.id = t.tweet_id
  WHERE r.root IN (SELECT coalesce(r2.root, g.tweet_id) FROM golden g LEFT JOIN roots r2 ON r2.id = g.tweet_id))"""
_SAFE = """safe AS (
  SELECT * FROM cases
  WHERE customer_tweet_id NOT IN (SELECT tweet_id FROM held)
    AND brand_reply_id NOT IN (SELECT CAST(tweet_id AS VARCHAR) FROM held))"""
_HOLD = (T, LK, CR, CS, MS, GD, RT, _HELD, _SAFE)

ORACLES["conversation_roots"] = sql_with(T, RT, recursive=True) + \
    "\nSELECT id AS tweet_id, root AS conversation_root FROM roots"
ORACLES["holdout_expand"] = sql_with(*_HOLD, recursive=True) + "\nSELECT tweet_id, conversation_root FROM held"
ORACLES["leakage_safe_cases"] = sql_with(*_HOLD, recursive=True) + \
    "\nSELECT case_id, customer_tweet_id, brand_reply_id FROM safe"
ORACLES["leakage_safe_reduced"] = ORACLES["leakage_safe_cases"]
ORACLES["holdout_audit"] = sql_with(*_HOLD, recursive=True) + """
SELECT 'tweets' AS stage, count(*)::BIGINT AS rows FROM tweets
UNION ALL SELECT 'held_out_conversations', count(DISTINCT conversation_root) FROM held
UNION ALL SELECT 'held_out_tweets', count(*) FROM held
UNION ALL SELECT 'cases', count(*) FROM cases
UNION ALL SELECT 'leakage_safe_cases', count(*) FROM safe"""
ORACLES["row_level_holdout"] = sql_with(*_HOLD, recursive=True) + """
SELECT case_id, customer_tweet_id FROM cases WHERE customer_tweet_id NOT IN (SELECT tweet_id FROM golden)"""

_QV_SAFE = QV.replace("qvec AS (", "qvec_g AS (").replace(
    "FROM messages m)", "FROM messages m WHERE m.tweet_id IN (SELECT tweet_id FROM golden))")
assert _QV_SAFE.count("golden") == 1
_CV_SAFE = CV.replace("cvec AS (", "cvec_s AS (").replace("FROM cases c", "FROM safe c")
_HT_SAFE = HT.replace("hits AS (", "hits_s AS (").replace("FROM qvec q, cvec c", "FROM qvec_g q, cvec_s c")
ORACLES["topk_safe"] = sql_with(*_HOLD, _QV_SAFE, _CV_SAFE, _HT_SAFE, recursive=True) + \
    "\nSELECT qid, rank, case_id, round(score, 6) AS score FROM hits_s"

# ---------------------------------------------------------------- retrieval
_unit = Wd._norm_vec("embedding")
ORACLES["vector_normalise"] = f"""
SELECT vec_id, label, len(embedding)::INTEGER AS dim,
       round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6) AS norm_in,
       round(sqrt(list_sum(list_transform(u, lambda y: y * y))), 6) AS norm_out,
       round(list_sum(u), 6) AS checksum
FROM (SELECT *, {_unit} AS u FROM embeddings)"""

_WORLD = (T, LK, CR, CS, MS, QV, CV, HT)
ORACLES["case_vectors"] = sql_with(T, LK, CR, CS, CV) + """
SELECT case_id, len(v)::INTEGER AS dim, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm,
       round(list_sum(v), 6) AS checksum FROM cvec"""
ORACLES["case_vectors_refreshed"] = ORACLES["case_vectors"]
ORACLES["topk_retrieval"] = sql_with(*_WORLD) + "\nSELECT qid, rank, case_id, round(score, 6) AS score FROM hits"

ORACLES["evidence_strings"] = sql_with(*_WORLD) + f"""
SELECT qid, string_agg(ev, ' || ' ORDER BY rank) AS evidence, count(*)::BIGINT AS n_evidence FROM (
  SELECT h.qid, h.rank,
         printf('Similarity %.4f | Customer: %s | Brand: %s', h.score,
                {G.strip("coalesce(c.customer_text, '')")}, {G.strip("coalesce(c.brand_reply, '')")}) AS ev
  FROM hits h JOIN cases c USING (case_id)) GROUP BY qid"""

ORACLES["evidence_scores"] = sql_with(*_WORLD) + """
SELECT h.qid, CAST(printf('%.4f', max(h.score) FILTER (WHERE h.rank = 1)) AS DOUBLE) AS similarity
FROM hits h JOIN cases c USING (case_id) GROUP BY h.qid"""
ORACLES["top_score_stats"] = sql_with(*_WORLD) + """
SELECT round(avg(ts), 4) AS mean_top, round(min(ts), 4) AS min_top, round(max(ts), 4) AS max_top,
       count(*)::BIGINT AS n_queries
FROM (SELECT m.tweet_id, coalesce(max(h.score), 0.0) AS ts FROM messages m
      LEFT JOIN hits h ON h.qid = m.tweet_id GROUP BY m.tweet_id)"""

# ---------------------------------------------------------------- metrics
_KNN = f"""evec AS (SELECT vec_id, label, {Wd._norm_vec('embedding')} AS v FROM embeddings),
knn AS (
  SELECT qid, CAST(tl AS VARCHAR) AS true_label, CAST(pl AS VARCHAR) AS pred_label FROM (
    SELECT q.vec_id AS qid, q.label AS tl, c.label AS pl,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rn
    FROM evec q, evec c WHERE q.vec_id <> c.vec_id) WHERE rn = 1)"""
_PL = """pairs AS (SELECT true_label AS y, pred_label AS p, count(*) AS n FROM knn GROUP BY ALL),
per_label AS (
  SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(support)::BIGINT AS support
  FROM (SELECT y AS label, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS fp,
               CASE WHEN y IS DISTINCT FROM p THEN n ELSE 0 END AS fn, n AS support FROM pairs
        UNION ALL
        SELECT p, 0, CASE WHEN y IS DISTINCT FROM p THEN n ELSE 0 END, 0, 0 FROM pairs) GROUP BY label),
pl AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
            CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM per_label)"""
_MET = (_KNN, _PL)
ORACLES["accuracy"] = sql_with(*_MET) + \
    "\nSELECT count(*)::BIGINT AS n, round(avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM knn"
ORACLES["macro_f1"] = sql_with(*_MET) + \
    "\nSELECT count(*)::BIGINT AS n_labels, round(avg(f1), 4) AS macro_f1 FROM pl"
ORACLES["classification_report"] = sql_with(*_MET) + """
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pl
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 4), sum(support)::BIGINT FROM pl
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM pl
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
                 round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
                 sum(support)::BIGINT FROM pl"""
ORACLES["confusion_matrix"] = sql_with(*_MET) + """
SELECT a.x AS true_label, b.x AS pred_label, coalesce(p.n, 0)::BIGINT AS n
FROM (SELECT y AS x FROM pairs UNION SELECT p FROM pairs) a CROSS JOIN (SELECT y AS x FROM pairs UNION SELECT p FROM pairs) b
LEFT JOIN pairs p ON p.y = a.x AND p.p = b.x"""
ORACLES["binary_f1"] = """
SELECT tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1
FROM (SELECT count(*) FILTER (WHERE y AND p)::BIGINT AS tp, count(*) FILTER (WHERE NOT y AND p)::BIGINT AS fp,
             count(*) FILTER (WHERE y AND NOT p)::BIGINT AS fn, count(*) FILTER (WHERE NOT y AND NOT p)::BIGINT AS tn
      FROM (SELECT coalesce(quality = 1, false) AS y, coalesce(toxic = 0, false) AS p FROM labels))"""
ORACLES["binary_confusion"] = """
SELECT y AS truth, count(*) FILTER (WHERE NOT p)::BIGINT AS pred_false, count(*) FILTER (WHERE p)::BIGINT AS pred_true
FROM (SELECT y, p FROM (SELECT coalesce(quality = 1, false) AS y, coalesce(toxic = 0, false) AS p FROM labels)
      UNION ALL SELECT false, NULL UNION ALL SELECT true, NULL)
GROUP BY y"""

# ---------------------------------------------------------------- sampling
ORACLES["seeded_sample"] = """
SELECT doc_id, lang, n_chars FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 50"""
ORACLES["stratified_split"] = """
SELECT doc_id, quality, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, quality,
             row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
ORACLES["head_n"] = "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 20"
ORACLES["message_positions"] = sql_with(MS) + "\nSELECT tweet_id, n FROM messages"


# ---------------------------------------------------------------- replies and agent
from supportflow.operators import replies as RPx  # noqa: E402

RR, J6, J1 = Wd.SQL_RAW_REPLIES, Wd.SQL_JUDGE_SIX, Wd.SQL_JUDGE_ONE
_CLEAN = G.clean_replies_ctes("raw_first", "Brand")
_RAWF = "raw_first AS (SELECT id, arg_min(raw, attempt) AS raw FROM raw_responses GROUP BY id)"

ORACLES["clean_replies"] = sql_with(RR, G.clean_replies_ctes("raw_responses", "Brand")) + \
    "\nSELECT id, reply, reject_reason FROM cleaned"

_tmpl = RPx.prompt_template("Brand", "Brand")
_block = RPx.evidence_block("Brand")
_CLS = f"cls AS ({_cls})"
_PROMPTS = f"""prompts AS (
  SELECT c.tweet_id, coalesce(e.n_cases, 0)::BIGINT AS n_cases, coalesce(e.n_blocks, 0)::BIGINT AS n_blocks,
         CASE WHEN e.n_blocks > 0 THEN printf({G.lit(_tmpl)}, {G.strip("coalesce(m.text, '')")}, c.intent, e.ev) END AS prompt
  FROM cls c JOIN messages m USING (tweet_id)
  LEFT JOIN (
    SELECT qid, count(*) AS n_cases, count(*) FILTER (WHERE br <> '') AS n_blocks,
           string_agg(CASE WHEN br <> '' THEN printf({G.lit(_block)}, rank, {G.strip("coalesce(customer_text, '')")}, br,
                                                     printf('%.4f', score)) ELSE '' END, '' ORDER BY rank) AS ev
    FROM (SELECT h.*, c2.customer_text, {G.strip("coalesce(c2.brand_reply, '')")} AS br
          FROM hits h JOIN cases c2 USING (case_id)) GROUP BY qid) e ON e.qid = c.tweet_id)"""
_AG = (T, LK, CR, CS, MS, QV, CV, HT, _CLS, _PROMPTS)
ORACLES["prompt_table"] = sql_with(*_AG) + "\nSELECT tweet_id, n_cases, n_blocks, prompt FROM prompts"

_EVID = f"""evid AS (
  SELECT qid, string_agg(ev, ' || ' ORDER BY rank) AS evidence FROM (
    SELECT h.qid, h.rank, printf('Similarity %.4f | Customer: %s | Brand: %s', h.score,
           {G.strip("coalesce(c.customer_text, '')")}, {G.strip("coalesce(c.brand_reply, '')")}) AS ev
    FROM hits h JOIN cases c USING (case_id)) GROUP BY qid)"""
_handle = RPx.HANDLE_RE
_FINAL = f"""agent AS (
  SELECT p.tweet_id, m.text, c.intent, c.confidence, coalesce(hs.n_hits, 0)::BIGINT AS n_hits, hs.top_score,
         coalesce(ev.evidence, '') AS evidence,
         CASE WHEN p.n_cases = 0 THEN {G.lit(RPx.fallback_no_cases('Brand'))}
              WHEN p.n_blocks = 0 THEN {G.lit(RPx.fallback_no_evidence('Brand'))}
              WHEN cl.reply IS NOT NULL THEN cl.reply
              WHEN {G.strip(f"regexp_replace({G.strip('coalesce(t1.brand_reply, ' + chr(39) * 2 + ')')}, {G.lit(_handle)}, '')")} <> ''
                THEN {G.strip(f"regexp_replace({G.strip('coalesce(t1.brand_reply, ' + chr(39) * 2 + ')')}, {G.lit(_handle)}, '')")}
              ELSE {G.lit(RPx.fallback_no_cases('Brand'))} END AS reply
  FROM prompts p JOIN messages m USING (tweet_id) JOIN cls c USING (tweet_id)
  LEFT JOIN (SELECT qid, count(*) AS n_hits, max(score) AS top_score FROM hits GROUP BY qid) hs ON hs.qid = p.tweet_id
  LEFT JOIN (SELECT h.qid, c3.brand_reply FROM hits h JOIN cases c3 USING (case_id) WHERE h.rank = 1) t1 ON t1.qid = p.tweet_id
  LEFT JOIN cleaned cl ON cl.id = p.tweet_id
  LEFT JOIN evid ev ON ev.qid = p.tweet_id)"""
_AGENT = (*_AG, RR, _RAWF, _CLEAN, _EVID, _FINAL)
ORACLES["fallback_reply"] = sql_with(*_AGENT) + "\nSELECT tweet_id, reply FROM agent"
_pol = P.stand_in_v2()
_rid = G.decide_sql(_pol, G.norm("text"), "confidence", "n_hits", "top_score")
ORACLES["agent_batch"] = sql_with(*_AGENT) + f"""
SELECT tweet_id,
       CASE WHEN text IS NOT NULL THEN intent ELSE 'ERROR' END AS intent,
       CASE WHEN text IS NOT NULL THEN confidence ELSE 0.0 END AS confidence,
       CASE WHEN text IS NOT NULL THEN reply ELSE '' END AS reply,
       CASE WHEN text IS NOT NULL THEN {G.rule_lookup_sql(_pol, 'rule_id', 'decision')} ELSE 'ERROR' END AS decision,
       CASE WHEN text IS NOT NULL THEN {G.rule_lookup_sql(_pol, 'rule_id', 'reason')} ELSE 'message text missing' END AS reason,
       CASE WHEN text IS NOT NULL THEN rule_id END AS rule_id,
       round(coalesce(top_score, 0.0), 6) AS top_similarity, evidence,
       CASE WHEN text IS NOT NULL THEN 'OK' ELSE 'ERROR' END AS status
FROM (SELECT *, {_rid} AS rule_id FROM agent)"""

from supportflow.operators import judge as Jx  # noqa: E402

_t6 = Jx.six_metric_template("Brand")
_t1 = Jx.one_score_template("Brand")
ORACLES["judge_prompts"] = sql_with(T, LK, CR, CS, MS, QV, CV, HT, _CLS, _EVID) + f"""
SELECT c.tweet_id,
       printf({G.lit(_t6)}, substring(coalesce(m.text, ''), 1, 500), substring(coalesce(c.intent, ''), 1, 100),
              substring(coalesce(r.reply, ''), 1, 600), substring(coalesce(e.evidence, ''), 1, 700)) AS prompt_six,
       printf({G.lit(_t1)}, coalesce(m.text, ''), coalesce(e.evidence, ''), coalesce(r.reply, '')) AS prompt_one
FROM cls c JOIN messages m USING (tweet_id)
LEFT JOIN (SELECT trunc(TRY_CAST(in_response_to_tweet_id AS DOUBLE))::BIGINT AS tweet_id, text AS reply FROM tweets
           WHERE in_response_to_tweet_id IS NOT NULL) r USING (tweet_id)
LEFT JOIN evid e ON e.qid = c.tweet_id"""

# ---------------------------------------------------------------- judging
_SIX = G.judge_six_ctes("judge_raw")
ORACLES["judge_scores_six"] = sql_with(J6, _SIX) + """
SELECT id, correctness, groundedness, helpfulness, brand_consistency, safety, overall, method, parsed,
       CASE WHEN parsed THEN 'Scored by the judge.' ELSE 'Judge output could not be parsed.' END AS reason FROM six"""
_ONE = f"one AS (SELECT id, attempt, {G.last_score_sql('raw')} AS llm_overall FROM judge_raw1)"
ORACLES["judge_score_last"] = sql_with(J1, _ONE) + "\nSELECT id, attempt, llm_overall FROM one"
_RETRY = """retry AS (
  SELECT id, arg_min(llm_overall, attempt) FILTER (WHERE llm_overall IS NOT NULL) AS llm_overall,
         count(*)::BIGINT AS attempts FROM one GROUP BY id)"""
ORACLES["judge_retry"] = sql_with(J1, _ONE, _RETRY) + "\nSELECT id, llm_overall, attempts FROM retry"
_mets = ["correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "overall"]
ORACLES["judge_summary"] = sql_with(J6, _SIX) + "\nSELECT count(*)::BIGINT AS n_total, " + \
    "count(*) FILTER (WHERE overall > 0)::BIGINT AS n_valid, count(*) FILTER (WHERE NOT overall > 0)::BIGINT AS n_failed, " + \
    ", ".join(f"round(avg({m}) FILTER (WHERE overall > 0), 4) AS mean_{m}" for m in _mets) + \
    ", round(count(*) FILTER (WHERE overall > 0 AND overall >= 4) / nullif(count(*) FILTER (WHERE overall > 0), 0), 4)" \
    " AS share_overall_ge4 FROM six"
ORACLES["judge_summary_one"] = sql_with(J1, _ONE, _RETRY) + """
SELECT count(*)::BIGINT AS n_total, count(llm_overall)::BIGINT AS n_success,
       count(*) FILTER (WHERE llm_overall IS NULL)::BIGINT AS n_failed, round(avg(llm_overall), 4) AS mean_score FROM retry"""
ORACLES["judge_vs_human"] = sql_with(J6, _SIX) + """
SELECT count(*)::BIGINT AS n, round(avg(abs(j - h)), 4) AS mean_abs_diff,
       round(avg(CASE WHEN j = h THEN 1.0 ELSE 0.0 END), 4) AS exact_share, round(corr(j::DOUBLE, h::DOUBLE), 4) AS corr
FROM (SELECT s.overall AS j, 1 + 2 * l.quality + 2 * (1 - l.toxic) AS h
      FROM six s JOIN labels l ON l.doc_id = s.id WHERE s.overall > 0)"""


# ---------------------------------------------------------------- features and baselines
_TOK = G.TERM_TOKEN


def _tfidf_sql(min_df: int, max_features: int, sublinear: bool) -> str:
    tfw = "(1 + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {G.lit(_TOK)}) AS t FROM documents),
grams AS (SELECT doc_id, unnest(t) AS term FROM toks
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
          WHERE len(t) >= 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM (
            SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term) WHERE df >= {min_df}
          ORDER BY total DESC, term LIMIT {max_features}),
w AS (SELECT doc_id, term, {tfw} * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


ORACLES["tfidf"] = _tfidf_sql(2, 100000, True)
ORACLES["tfidf_top10k"] = _tfidf_sql(1, 10000, False)
ORACLES["tfidf_100k"] = _tfidf_sql(2, 100000, False)

_SPLIT = """split AS (
  SELECT doc_id, quality, toxic, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r,
               count(*) OVER (PARTITION BY quality) AS n FROM labels))"""
ORACLES["tfidf_logreg_check"] = "WITH " + _SPLIT + f""",
toks AS (SELECT d.doc_id, regexp_extract_all(lower(coalesce(d.text, '')), {G.lit(_TOK)}) AS t
         FROM documents d JOIN split s ON s.doc_id = d.doc_id WHERE s.split = 'train'),
grams AS (SELECT doc_id, unnest(t) AS term FROM toks
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
          WHERE len(t) >= 2),
vocab AS (SELECT term FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 2)
SELECT (SELECT count(*) FROM toks)::BIGINT AS n_train,
       (SELECT count(*) FROM split JOIN documents USING (doc_id) WHERE split = 'test')::BIGINT AS n_test,
       least((SELECT count(*) FROM vocab), 100000)::BIGINT AS n_terms,
       true AS gradient_vanishes, true AS beats_majority_loss, true AS predicts_labels"""
ORACLES["stored_model"] = "WITH " + _SPLIT + """
SELECT doc_id, quality, true AS agrees FROM split JOIN documents USING (doc_id) WHERE split = 'test'"""
ORACLES["svd_check"] = f"""
WITH toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {G.lit(_TOK)}) AS t FROM documents),
grams AS (SELECT doc_id, unnest(t) AS term FROM toks
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
          WHERE len(t) >= 2),
vocab AS (SELECT term FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 2)
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_docs, least((SELECT count(*) FROM vocab), 20000)::BIGINT AS n_terms,
       true AS orthonormal, true AS in_order, true AS values_are_the_vectors, true AS no_more_than_all"""
ORACLES["majority_baseline"] = "WITH " + _SPLIT + """
SELECT doc_id, quality, (SELECT quality FROM split WHERE split = 'train' GROUP BY quality
                         ORDER BY count(*) DESC, quality LIMIT 1) AS prediction
FROM split WHERE split = 'test'"""

# ---------------------------------------------------------------- review and flags
_SW = G.first_match_sql("text", L.STAND_IN_WEAK)
ORACLES["review_queue"] = f"""
SELECT doc_id, CASE WHEN s IN ({', '.join(G.lit(x) for x in L.LABEL_ORDER)}) THEN s ELSE 'general_support' END AS suggested_label
FROM (SELECT doc_id, {_SW} AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
ORACLES["next_review"] = ORACLES["review_queue"] + " ORDER BY doc_id LIMIT 5"
ORACLES["review_progress"] = """
SELECT total, reviewed, total - reviewed AS remaining,
       round(CASE WHEN total > 0 THEN reviewed / total ELSE 0.0 END, 4) AS progress
FROM (SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels))::BIGINT AS reviewed
      FROM documents)"""
_LBL = ", ".join(G.lit(x) for x in L.LABEL_ORDER)
ORACLES["apply_reviews"] = f"""
WITH dec AS (
  SELECT doc_id, 0 AS pass, 'general_support' AS intent, toxic = 1 AS escalate, 'first pass' AS reason FROM labels
  UNION ALL
  SELECT doc_id, 1, CASE WHEN toxic = 1 THEN 'account_purchase_issue' ELSE 'not_a_label' END, toxic = 1, 'second pass'
  FROM labels WHERE quality = 0),
last AS (SELECT doc_id, arg_max(intent, pass) AS i, arg_max(escalate, pass) AS e, arg_max(reason, pass) AS r
         FROM dec GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN l.doc_id IS NOT NULL THEN (CASE WHEN l.i IN ({_LBL}) THEN l.i ELSE 'general_support' END)
            ELSE {_SW} END AS intent,
       CASE WHEN l.doc_id IS NOT NULL THEN l.e ELSE false END AS escalate,
       CASE WHEN l.doc_id IS NOT NULL AND l.e THEN l.r ELSE '' END AS escalation_reason,
       l.doc_id IS NOT NULL AS reviewed
FROM documents d LEFT JOIN last l USING (doc_id)"""
ORACLES["append_ratings"] = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 1 + 2 * quality + 2 * (1 - toxic) END AS rating,
       CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS rated_at FROM labels"""
ORACLES["fill_defaults"] = """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, false AS reviewed,
       length(coalesce(d.text, ''))::INTEGER AS text_len
FROM documents d LEFT JOIN labels l USING (doc_id)"""
ORACLES["normalise_flags"] = """
SELECT doc_id, coalesce(toxic = 1, false) AS toxic_flag, coalesce(quality = 1, false) AS quality_flag,
       coalesce(toxic = 1, false) AS escalate_flag FROM labels"""
ORACLES["split_valid_failed"] = sql_with(J6, _SIX, J1, _ONE) + """
SELECT CASE WHEN overall > 0 THEN 'valid' ELSE 'failed' END AS status, count(*)::BIGINT AS n, 'six' AS judge
FROM six GROUP BY ALL
UNION ALL
SELECT CASE WHEN llm_overall IS NOT NULL THEN 'valid' ELSE 'failed' END, count(*)::BIGINT, 'one' FROM one GROUP BY ALL"""

ORACLES["agent_error_split"] = """
SELECT CASE WHEN text IS NULL THEN 'error' ELSE 'valid' END AS status, count(*)::BIGINT AS n
FROM conversations WHERE role = 'user' GROUP BY ALL"""


# ---------------------------------------------------------------- streaming
from supportflow.streaming.scoring import text_rules as _text_rules  # noqa: E402

ORACLES["stream_judge_retry"] = ORACLES["judge_retry"]
ORACLES["message_quarantine"] = sql_with(MS) + """
SELECT outcome, count(*)::BIGINT AS n, sum(chars)::BIGINT AS characters FROM (
  SELECT CASE tweet_id % 13 WHEN 1 THEN 'missing_id' WHEN 2 THEN 'unreadable_id+missing_text' WHEN 3 THEN 'missing_text'
              WHEN 4 THEN 'corrupt_record' ELSE CASE WHEN trim(text, ' ') = '' THEN 'missing_text' ELSE 'valid' END END AS outcome,
         CASE WHEN tweet_id % 13 IN (2, 3) THEN 1 ELSE length(text) END AS chars
  FROM messages) GROUP BY outcome"""
_tp = _text_rules(P.stand_in_v2())
_trid = G.decide_sql(_tp, G.norm("text"), "confidence", "NULL", "NULL")
ORACLES["stream_scoring"] = sql_with(MS) + f"""
SELECT tweet_id, intent, confidence, rule_id, {G.rule_lookup_sql(_tp, 'rule_id', 'decision')} AS decision
FROM (SELECT c.*, m.text, {_trid.replace('text', 'm.text')} AS rule_id
      FROM ({_cls}) c JOIN messages m USING (tweet_id)
      WHERE {G.strip("coalesce(m.text, '')")} <> '')"""
ORACLES["stream_agent"] = ORACLES["agent_batch"]
