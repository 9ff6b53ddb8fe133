"""Derived tables shared by the registered queries (stand-in mapping of SURVEY §7.4).

* tweets: ``conversations`` as a tweet dump (``sources.adapters``).
* messages: user turns (a pruned, filtered scan; cheaper to re-read than to write out).
  Their number ``n`` in (conv_id, turn) order is the G4 query ``message_positions`` only.
* cases: the case corpus built from the tweets, keyed by ``case_id = customer_tweet_id``
  (unique after keep-first), so no global ordering is needed to key it.
* vectors: every message and every case gets the J1 text vector of its (customer) text,
  L2-normalised (J2), so retrieval covers all messages against the whole corpus. (The
  ``embeddings`` table is too small to give each message and case a vector of its own; it
  feeds J2 and the leave-one-out neighbour metrics instead.)
* hits: exact top-``K`` of message vectors against case vectors (J4).

Each function mirrors a SQL CTE in ``SQL_*`` below, used by the DuckDB oracles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.operators import cases as C
from supportflow.operators import features as FT
from supportflow.operators import retrieval as R
from supportflow.operators.sampling import with_position
from supportflow.session import delete_on_exit, ensure_checkpoint_dir
from supportflow.sources.adapters import BRAND, customer_messages, tweet_id, tweets_from_conversations
from supportflow.sources import snapshots
from supportflow.sources.tables import read_table, read_vectors, write_vectors

K = 5


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return tweets_from_conversations(read_table(spark, sf, "conversations"), BRAND)


def _materialize(df: DataFrame) -> DataFrame:
    """A table several consumers read: written once to the shared checkpoint folder
    (as a pipeline writes its case table) instead of being rebuilt per consumer."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """``tweet_id, conv_id, turn, text``."""
    return customer_messages(read_table(spark, sf, "conversations"))


def message_positions(spark: SparkSession, sf: str) -> DataFrame:
    """``tweet_id, n``: message number in (conv_id, turn) order, from 0."""
    return with_position(messages(spark, sf), ["conv_id", "turn"], name="n").select("tweet_id", "n")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case corpus with ``case_id`` (written once: several consumers read it)."""
    tw = _materialize(tweets(spark, sf))                 # read three times below
    cs = C.build_cases(C.linked_messages(tw, BRAND), tw, BRAND)
    return _materialize(cs.withColumn("case_id", F.col("customer_tweet_id")))


GOLDEN_N = 50
GOLDEN_SEED = 42


def golden(spark: SparkSession, sf: str, msgs: DataFrame | None = None) -> DataFrame:
    """Evaluation set: a seeded sample of ``GOLDEN_N`` messages."""
    from supportflow.operators.sampling import seeded_sample
    msgs = msgs if msgs is not None else messages(spark, sf)
    return seeded_sample(msgs, GOLDEN_N, "tweet_id", GOLDEN_SEED)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def message_vectors(spark: SparkSession, sf: str, msgs: DataFrame | None = None) -> DataFrame:
    """``qid`` (= tweet_id), ``qvec``: the unit text vector of every message (J1 + J2)."""
    msgs = msgs if msgs is not None else messages(spark, sf)
    q = FT.text_vectors(msgs.select(F.col("tweet_id").alias("qid"), "text"), "text", "qvec")
    return R.l2_normalise(q.select("qid", "qvec"), "qvec")


def case_vectors(spark: SparkSession, sf: str, cs: DataFrame | None = None) -> DataFrame:
    """``case_id, vec``: the unit text vector of every case's customer text (J1 + J2, J3)."""
    cs = cs if cs is not None else cases(spark, sf)
    v = FT.text_vectors(cs.select("case_id", "customer_text"), "customer_text", "vec")
    return R.l2_normalise(v.select("case_id", "vec"), "vec")


def stored_case_vectors(spark: SparkSession, sf: str, cs: DataFrame) -> DataFrame:
    """The vector table of a corpus (J3), written once to the shared folder and read (A5)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    write_vectors(case_vectors(spark, sf, cs), path)
    return read_vectors(spark, path)


def update_case_vectors(cs: DataFrame, path: str, seen=None) -> int:
    """Brings the versioned vector table at ``path`` up to the cases ``case_id, customer_text``: only
    new cases and those with another text are vectorised (``seen`` gets them), cases that are gone
    go. Returns the version."""
    def compute(rows: DataFrame) -> DataFrame:
        if seen is not None:
            seen(rows)
        v = FT.text_vectors(rows, "customer_text", "vec").select("case_id", "text_print", "vec")
        return R.l2_normalise(v, "vec")
    printed = cs.select("case_id", "customer_text",
                        F.xxhash64(F.coalesce("customer_text", F.lit(""))).alias("text_print"))
    return snapshots.refresh(printed, path, "case_id", "text_print", compute)


def hits(spark: SparkSession, sf: str, k: int = K, msgs: DataFrame | None = None,
         cs: DataFrame | None = None) -> DataFrame:
    return R.top_k(message_vectors(spark, sf, msgs), case_vectors(spark, sf, cs), k=k)


# ------------------------------------------------------------------------------
# SQL counterparts (DuckDB). ``norm_vec`` mirrors J2 in double precision.
# ------------------------------------------------------------------------------
def _norm_vec(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}::DOUBLE[], lambda y: y * y)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({v}::DOUBLE[], lambda x: x / {n}) ELSE {v}::DOUBLE[] END"


SQL_TWEETS = """tweets AS (
  SELECT conv_id * 1048576 + turn AS tweet_id,
         CASE WHEN role = 'assistant' THEN 'Brand' ELSE 'user_' || CAST(conv_id AS VARCHAR) END AS author_id,
         role <> 'assistant' AS inbound,
         CAST(NULL AS VARCHAR) AS created_at,
         text,
         CAST(lead(conv_id * 1048576 + turn) OVER w AS VARCHAR) AS response_tweet_id,
         CAST(lag(conv_id * 1048576 + turn) OVER w AS VARCHAR) AS in_response_to_tweet_id
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

SQL_LINKED = """linked AS (
  SELECT * FROM tweets
  WHERE inbound AND tweet_id IN (
    SELECT DISTINCT trunc(TRY_CAST(in_response_to_tweet_id AS DOUBLE))::BIGINT FROM tweets
    WHERE author_id = 'Brand' AND NOT inbound AND TRY_CAST(in_response_to_tweet_id AS DOUBLE) IS NOT NULL))"""

SQL_CASES_RAW = f"""cases_raw AS (
  SELECT customer_tweet_id, created_at,
         regexp_replace(customer_text, '{{strip}}', '', 'g') AS customer_text,
         brand_reply_id,
         regexp_replace(brand_reply, '{{strip}}', '', 'g') AS brand_reply
  FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_tweet_id ORDER BY brand_reply_id, brand_reply,
                                 customer_text, created_at) AS rn
    FROM (SELECT l.tweet_id AS customer_tweet_id, l.created_at, l.text AS customer_text,
                 CAST(l.response_tweet_id AS VARCHAR) AS brand_reply_id, r.text AS brand_reply
          FROM linked l JOIN (SELECT CAST(tweet_id AS VARCHAR) AS rid, text FROM tweets
                              WHERE author_id = 'Brand' AND NOT inbound) r
            ON CAST(l.response_tweet_id AS VARCHAR) = r.rid
          WHERE l.text IS NOT NULL AND r.text IS NOT NULL) j) d
  WHERE rn = 1)"""

SQL_CASES = f"""cases AS (
  SELECT *, customer_tweet_id AS case_id
  FROM cases_raw WHERE customer_text <> '' AND brand_reply <> '')"""

SQL_MESSAGES = """messages AS (
  SELECT conv_id * 1048576 + turn AS tweet_id, conv_id, turn, text,
         row_number() OVER (ORDER BY conv_id, turn) - 1 AS n
  FROM conversations WHERE role = 'user')"""

def _buckets(text: str) -> str:
    """J1 in SQL, step 1: the md5 bucket of every token."""
    from supportflow.plans.sqlgen import TERM_TOKEN as tok
    return (f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{tok}'), "
            f"lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {FT.VECTOR_DIM})::INTEGER)")


def _counts(b: str) -> str:
    """J1 in SQL, step 2: counts per bucket of the bucket list ``b``."""
    return f"list_transform(range({FT.VECTOR_DIM}), lambda i: len(list_filter({b}, lambda x: x = i))::DOUBLE)"


SQL_QVEC = f"""qvec AS (
  SELECT qid, {_norm_vec('raw_v')} AS v
  FROM (SELECT qid, {_counts('b')} AS raw_v
        FROM (SELECT m.tweet_id AS qid, {_buckets('m.text')} AS b FROM messages m)))"""

SQL_CVEC = f"""cvec AS (
  SELECT case_id, {_norm_vec('raw_v')} AS v
  FROM (SELECT case_id, {_counts('b')} AS raw_v
        FROM (SELECT c.case_id, {_buckets('c.customer_text')} AS b FROM cases c)))"""

SQL_HITS = f"""hits AS (
  SELECT qid, rank, case_id, score FROM (
    SELECT q.qid, c.case_id, list_inner_product(q.v, c.v) AS score,
           row_number() OVER (PARTITION BY q.qid ORDER BY list_inner_product(q.v, c.v) DESC, c.case_id) AS rank
    FROM qvec q, cvec c) WHERE rank <= {K})"""


SQL_GOLDEN = f"""golden AS (
  SELECT * FROM messages ORDER BY md5(CAST(tweet_id AS VARCHAR) || ':{GOLDEN_SEED}'), tweet_id LIMIT {GOLDEN_N})"""

SQL_ROOTS = """edges AS (
  SELECT tweet_id AS id, min(trunc(TRY_CAST(in_response_to_tweet_id AS DOUBLE))::BIGINT) AS parent
  FROM tweets GROUP BY tweet_id),
walk(id, cur, depth) AS (
  SELECT id, id, 0 FROM edges
  UNION ALL
  SELECT w.id, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.id = w.cur
  WHERE e.parent IS NOT NULL AND w.depth < 100000),
roots AS (SELECT id, arg_max(cur, depth) AS root FROM walk GROUP BY id)"""


def sql_with(*parts: str, recursive: bool = False) -> str:
    from supportflow.plans.sqlgen import STRIP_RE
    body = ",\n".join(parts).replace("{strip}", STRIP_RE.replace("'", "''"))
    return ("WITH RECURSIVE " if recursive else "WITH ") + body


ALL_WORLD = (SQL_TWEETS, SQL_LINKED, SQL_CASES_RAW, SQL_CASES, SQL_MESSAGES, SQL_QVEC, SQL_CVEC, SQL_HITS)


# ------------------------------------------------------------------------------
# Stand-in model output, derived from the driver tables (the model server is not called).
# ------------------------------------------------------------------------------
def json_escape(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def raw_replies(spark: SparkSession, sf: str) -> DataFrame:
    """``raw_responses(id, attempt, raw)``: for the message before each assistant turn, the
    assistant text wrapped in one of eight shapes chosen by ``conv_id % 8``."""
    conv = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    a = F.coalesce(F.col("text"), F.lit(""))
    e = json_escape(a)
    shape = F.pmod(F.col("conv_id"), F.lit(8))
    raw = (F.when(shape == 0, F.concat(F.lit('{"reply": "'), e, F.lit('"}')))
           .when(shape == 1, F.concat(F.lit("<think>draft</think>"), a))
           .when(shape == 2, F.concat(F.lit("Reply: "), a))
           .when(shape == 3, F.concat(F.lit('{"answer": "'), e, F.lit('"}')))
           .when(shape == 4, F.concat(F.lit('[{"reply": "'), e, F.lit('"}]')))
           .when(shape == 5, F.concat(F.lit('{"reply": "'), e, F.lit('"} Hope this helps')))
           .when(shape == 6, F.concat(F.lit("We need to reply. "), a))
           .otherwise(a))
    return conv.select((tweet_id() - 1).alias("id"),
                       F.lit(1).alias("attempt"), raw.alias("raw"))


def _scores(i: int):
    return (F.lit(1) + F.pmod(F.col("doc_id") + F.lit(i), F.lit(5))).cast("string")


def judge_raw_six(spark: SparkSession, sf: str) -> DataFrame:
    """Six-metric judgements for each document, spelled six ways by ``doc_id % 6``; every
    way carries the whole document text (as reasoning, before the scores, or alone)."""
    docs = read_table(spark, sf, "documents")
    s = [_scores(i) for i in range(6)]
    names = ["correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "overall"]
    js = F.concat(F.lit("{"), *sum([[F.lit(('' if i == 0 else ', ') + f'"{n}": '), s[i]]
                                    for i, n in enumerate(names)], []), F.lit("}"))
    labelled = F.concat(*sum([[F.lit(('' if i == 0 else '\n') + lab + ": "), s[i]] for i, lab in enumerate(
        ["Correctness", "Groundedness", "Helpfulness", "Brand consistency", "Safety", "Overall"])], []))
    way = F.pmod(F.col("doc_id"), F.lit(6))
    text = F.coalesce(F.col("text"), F.lit(""))
    think = F.concat(F.lit("<think>"), text, F.lit("</think>"))
    raw = (F.when(way == 0, F.concat(text, F.lit("\n"), js))
           .when(way == 1, F.concat(think, js))
           .when(way == 2, F.concat(think, labelled))
           .when(way == 3, F.concat(think, F.concat_ws(" ", *s)))
           .when(way == 4, F.concat(think, F.concat_ws(", ", *s)))
           .otherwise(text))
    return docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("attempt"), raw.alias("raw"))


def judge_raw_one(spark: SparkSession, sf: str) -> DataFrame:
    """One-score judgements, two attempts per document: the first spelled five ways by
    ``doc_id % 5`` (some fail), the second a bare digit after the text as reasoning; every
    attempt carries the whole document text."""
    docs = read_table(spark, sf, "documents")
    s = _scores(5)
    text = F.coalesce(F.col("text"), F.lit(""))
    way = F.pmod(F.col("doc_id"), F.lit(5))
    think = F.concat(F.lit("<think>"), text, F.lit("</think>"))
    first = (F.when(way == 0, F.concat(think, s))
             .when(way == 1, F.concat(think, F.lit(" Score: "), s))
             .when(way == 2, F.concat(think, F.lit("I would rate it "), s, F.lit("/5")))
             .when(way == 3, text)
             .otherwise(think))
    a1 = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("attempt"), first.alias("raw"))
    a2 = docs.select(F.col("doc_id").alias("id"), F.lit(2).alias("attempt"), F.concat(think, s).alias("raw"))
    return a1.unionByName(a2)


def _esc_sql(x: str) -> str:
    out = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


def _q(s: str) -> str:
    s = s.replace("'", "''")
    if "\n" in s or "\r" in s or "\t" in s:
        return " || ".join("chr(%d)" % ord(ch) if ch in "\n\r\t" else f"'{ch}'" for ch in s)
    return f"'{s}'"


SQL_RAW_REPLIES = f"""raw_responses AS (
  SELECT conv_id * 1048576 + turn - 1 AS id, 1 AS attempt,
    CASE conv_id % 8
      WHEN 0 THEN '{{"reply": "' || {_esc_sql("coalesce(text, '')")} || '"}}'
      WHEN 1 THEN '<think>draft</think>' || coalesce(text, '')
      WHEN 2 THEN 'Reply: ' || coalesce(text, '')
      WHEN 3 THEN '{{"answer": "' || {_esc_sql("coalesce(text, '')")} || '"}}'
      WHEN 4 THEN '[{{"reply": "' || {_esc_sql("coalesce(text, '')")} || '"}}]'
      WHEN 5 THEN '{{"reply": "' || {_esc_sql("coalesce(text, '')")} || '"}} Hope this helps'
      WHEN 6 THEN 'We need to reply. ' || coalesce(text, '')
      ELSE coalesce(text, '') END AS raw
  FROM conversations WHERE role = 'assistant')"""


def _s_sql(i: int) -> str:
    return f"CAST(1 + (doc_id + {i}) % 5 AS VARCHAR)"


_NAMES = ["correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "overall"]
_LABS = ["Correctness", "Groundedness", "Helpfulness", "Brand consistency", "Safety", "Overall"]
_JS_SQL = "'{' || " + " || ".join(f"'{'' if i == 0 else ', '}\"{n}\": ' || {_s_sql(i)}"
                                   for i, n in enumerate(_NAMES)) + " || '}'"
_LAB_SQL = " || ".join((f"chr(10) || " if i else "") + f"'{lab}: ' || {_s_sql(i)}" for i, lab in enumerate(_LABS))

SQL_JUDGE_SIX = f"""judge_raw AS (
  SELECT doc_id AS id, 1 AS attempt,
    CASE doc_id % 6
      WHEN 0 THEN coalesce(text, '') || chr(10) || {_JS_SQL}
      WHEN 1 THEN '<think>' || coalesce(text, '') || '</think>' || {_JS_SQL}
      WHEN 2 THEN '<think>' || coalesce(text, '') || '</think>' || {_LAB_SQL}
      WHEN 3 THEN '<think>' || coalesce(text, '') || '</think>' || concat_ws(' ', {', '.join(_s_sql(i) for i in range(6))})
      WHEN 4 THEN '<think>' || coalesce(text, '') || '</think>' || concat_ws(', ', {', '.join(_s_sql(i) for i in range(6))})
      ELSE coalesce(text, '') END AS raw
  FROM documents)"""

SQL_JUDGE_ONE = f"""judge_raw1 AS (
  SELECT doc_id AS id, 1 AS attempt,
    CASE doc_id % 5
      WHEN 0 THEN '<think>' || coalesce(text, '') || '</think>' || {_s_sql(5)}
      WHEN 1 THEN '<think>' || coalesce(text, '') || '</think> Score: ' || {_s_sql(5)}
      WHEN 2 THEN '<think>' || coalesce(text, '') || '</think>I would rate it ' || {_s_sql(5)} || '/5'
      WHEN 3 THEN coalesce(text, '')
      ELSE '<think>' || coalesce(text, '') || '</think>' END AS raw
  FROM documents
  UNION ALL
  SELECT doc_id, 2, '<think>' || coalesce(text, '') || '</think>' || {_s_sql(5)} FROM documents)"""
