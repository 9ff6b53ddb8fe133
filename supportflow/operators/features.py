"""TF-IDF features (L1) as a DataFrame job.

Tokens are maximal runs of two or more word characters of the lower-cased text; terms are
unigrams and bigrams of neighbouring tokens. ``idf = ln((1 + n) / (1 + df)) + 1``
(smoothed), ``tf`` raw counts or ``1 + ln(tf)`` (sublinear), rows L2-normalised. The
vocabulary keeps terms in at least ``min_df`` documents, then the ``max_features`` most
frequent (total count desc, term asc).

Plan: a document is one row, so its terms are counted inside the row and no text is ever
shuffled. The JVM finds the tokens; a task works on the bytes of a whole batch: numpy hashes
every token and neighbouring pair (64 bits), and sorts instead of looking up strings. The first
pass sums document frequency and total per term and task and shuffles only those sums (strings
are cut out of the text once per distinct term); the second weighs each document's terms against
the vocabulary, which is sent to the tasks, hashed, while it has at most ``VOCABULARY_ROWS`` rows.
Beyond that the terms are joined to it instead, and norms are taken per row number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.functions import textkit as K
from supportflow.functions.text import WORD
from supportflow.operators.sampling import with_position
from supportflow.session import spread, written

TOKEN_RE = f"[{WORD}]{{2,}}"
VOCABULARY_ROWS = 1_000_000
FLUSH = 250_000                                   # distinct terms that a task holds


def tokens(text: Column) -> Column:
    """The tokens of a text, one per line (a token holds no line feed)."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), 0), "\n")


_TOKEN = np.ones(256, bool)
_TOKEN[0x0A] = False


class Grams:
    """The unigrams and bigrams of a chunk of rows (tokens one per line): ``hash``, ``row`` and the
    byte range of each, which for a bigram holds the line feed between its tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = K.Words(data, offsets, _TOKEN, lower=False)
        one = w.hashes()
        pair = np.flatnonzero(w.row[1:] == w.row[:-1]) if len(one) > 1 else np.zeros(0, np.int64)
        two = K.mix(one[pair] * K.GRAM + one[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
        self.data = data
        self.hash = np.concatenate([one, two])
        self.row = np.concatenate([w.row, w.row[pair]])
        self.start = np.concatenate([w.start, w.start[pair]])
        self.end = np.concatenate([w.end, w.end[pair + 1]]) if len(pair) else np.concatenate([w.end, np.zeros(0, np.int64)])

    def terms(self, at: np.ndarray) -> pa.StringArray:
        """The strings of some grams."""
        size = self.end[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self.start[at], size)
        raw = self.data[where]
        raw[raw == 0x0A] = 0x20
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _chunks(column: pa.Array):
    """``(first row, rows, grams)`` of a batch, bounded by the largest text."""
    data, offsets = K.text_bytes(column)
    for i, j in K.chunks(offsets):
        yield i, j - i, Grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def term_hashes(terms: pa.Array) -> np.ndarray:
    """The hash that ``Grams`` gives to each term."""
    data, offsets = K.text_bytes(terms)
    data = np.where(data == 0x20, np.uint8(0x0A), data)        # a token holds no space
    out = np.zeros(len(terms), np.uint64)
    for i, j in K.chunks(offsets):
        g = Grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        out[i + g.row] = g.hash                                # a term's only bigram comes last
    return out


def _row_counts(g: Grams, n_rows: int, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(row, key, count)``: distinct grams per row, sorted. ``key`` is the place in the sorted
    hashes ``known``, others left out; or without them in the chunk's own, returned as well with
    a gram of each."""
    if known is None:
        values, first, key = np.unique(g.hash, return_index=True, return_inverse=True)
        row = g.row
    else:
        key = np.minimum(np.searchsorted(known, g.hash), max(0, len(known) - 1))
        hit = known[key] == g.hash if len(known) else np.zeros(len(g.hash), bool)
        key, row, values, first = key[hit], g.row[hit], known, None
    both, count = np.unique(row * max(1, len(values)) + key, return_counts=True)
    return both // max(1, len(values)), both % max(1, len(values)), count, values, first


def term_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df, total`` over whole texts, summed per task before the shuffle."""
    def run(batches):
        parts: list[tuple] = []

        def merged():
            hashes = np.concatenate([p[0] for p in parts])
            u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(u)).astype(np.int64) for k in (1, 2)]
            return u, *sums, pa.concat_arrays([p[3] for p in parts]).take(pa.array(first))

        def out():
            _, df, total, terms = parts[0]
            return pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(total)], names=["term", "df", "total"])
        for b in batches:
            for _, n_rows, g in _chunks(b.column(0)):
                if not len(g.hash):
                    continue
                _, key, count, values, first = _row_counts(g, n_rows)
                parts.append((values, np.bincount(key, minlength=len(values)), np.bincount(key, count, len(values)), g.terms(first)))
                if sum(len(p[0]) for p in parts) > 2 * FLUSH:
                    parts = [merged()]
                    if len(parts[0][0]) > FLUSH:
                        yield out()
                        parts = []
        if parts:
            parts = [merged()]
            yield out()

    return (spread(docs.select(text_col)).select(tokens(F.col(text_col)))
            .mapInArrow(run, "term string, df long, total long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))


def top_terms(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``stats(term, total, ...)`` with the largest ``total`` (ties: smaller
    ``term``); all rows when there are fewer.

    Exact, and no task ever holds ``n`` rows from every partition (``orderBy().limit(n)``
    funnels ``n`` rows per partition into one task): terms are counted per distinct total, a
    running count over that table finds the one total that straddles ``n``, and only its terms
    are ranked, through distributed positions. The per-total table is small by construction:
    d distinct totals need at least 1 + 2 + ... + d occurrences, so d <= sqrt(2 * occurrences).
    """
    per_total = stats.groupBy("total").agg(F.count(F.lit(1)).alias("c"))
    above = per_total.withColumn("above", F.coalesce(F.sum("c").over(
        Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = above.filter(F.col("above") < n).orderBy("total").first()
    if last is None:
        return stats.limit(0)
    if last["above"] + last["c"] <= n:
        return stats.filter(F.col("total") >= last["total"])
    cut = (with_position(stats.filter(F.col("total") == last["total"]), ["term"], name="__p")
           .filter(F.col("__p") < n - last["above"]).drop("__p"))
    return stats.filter(F.col("total") > last["total"]).unionByName(cut)


def vocabulary(docs: DataFrame, min_df: int, max_features: int, text_col: str = "text") -> DataFrame:
    """Written: ``term, df, total, idf`` of the kept terms."""
    n_docs = docs.count()
    kept = written(term_stats(docs, text_col).filter(F.col("df") >= min_df), "terms")
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return written(top_terms(kept, max_features).withColumn("idf", idf), "vocabulary")


def _tf(n, sublinear: bool):
    return 1.0 + np.log(n) if sublinear else n


def tfidf(docs: DataFrame, min_df: int = 2, max_features: int = 100000, sublinear: bool = True,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, weight`` for vocabulary terms (documents without one give no rows)."""
    vocab = vocabulary(docs, min_df, max_features, text_col)
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, weight double"
    if vocab.count() > VOCABULARY_ROWS:
        return _tfidf_by_join(rows, vocab, sublinear, schema)
    kept = vocab.select("term", "idf").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(hashed_vocabulary(kept["term"], kept["idf"].to_numpy()))

    def run(batches):
        known, idf, terms = sent.value
        for b in batches:
            for i, n_rows, g in _chunks(b.column(1)):
                row, key, count, *_ = _row_counts(g, n_rows, known)
                if not len(row):
                    continue
                weight = _weights(row, count, idf[key], sublinear)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + row)), terms.take(pa.array(key)), pa.array(weight)],
                                                 names=["doc_id", "term", "weight"])
    return rows.mapInArrow(run, schema)


def hashed_vocabulary(terms, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A vocabulary for the tasks: sorted hashes, the values and the terms in that order."""
    terms = pa.concat_arrays(terms.chunks) if isinstance(terms, pa.ChunkedArray) and terms.num_chunks else pa.array(
        [] if isinstance(terms, pa.ChunkedArray) else terms, pa.string())
    h = term_hashes(terms)
    order = np.argsort(h, kind="stable")
    return h[order], values[order], terms.take(pa.array(order))


def _weights(row: np.ndarray, count: np.ndarray, idf: np.ndarray, sublinear: bool) -> np.ndarray:
    """Weights of ``(row, term)`` pairs sorted by row, each row of unit length."""
    w = _tf(count.astype(float), sublinear) * idf
    return w / np.sqrt(np.bincount(row, w * w))[row]


def _tfidf_by_join(rows: DataFrame, vocab: DataFrame, sublinear: bool, schema: str) -> DataFrame:
    """The same for a vocabulary too large to send: one row per document and term, joined."""
    def run(batches):
        for b in batches:
            for i, n_rows, g in _chunks(b.column(2)):
                row, key, count, values, first = _row_counts(g, n_rows)
                if len(row):
                    at = pa.array(i + row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), g.terms(first).take(pa.array(key)), pa.array(count)],
                        names=["doc_id", "row", "term", "n"])
    counts = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "t").mapInArrow(
        run, schema.replace("term string, weight double", "row long, term string, n long"))
    tf = F.lit(1.0) + F.log(F.col("n").cast("double")) if sublinear else F.col("n").cast("double")
    w = counts.join(vocab.select("term", "idf"), "term").withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row")))
    return w.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def sparse_rows(docs: DataFrame, vocab: pa.Table, sublinear: bool, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``idx`` (ascending) and ``val``: the TF-IDF row of each document against a
    vocabulary ``term, number, idf`` of at most ``VOCABULARY_ROWS`` terms."""
    if vocab.num_rows > VOCABULARY_ROWS:
        raise ValueError(f"a vocabulary of {vocab.num_rows} terms is too large to send to every task")
    rows = docs.select(*keep, tokens(F.col(text_col)).alias("__t"))
    number, idf = vocab["number"].to_numpy(), vocab["idf"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((*hashed_vocabulary(vocab["term"], np.arange(len(number)))[:2], number, idf))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches):
        known, place, number, idf = sent.value
        for b in batches:
            for i, n_rows, g in _chunks(b.column(len(keep))):
                row, key, count, *_ = _row_counts(g, n_rows, known)
                at = place[key]
                order = np.lexsort((number[at], row))
                row, at = row[order], at[order]
                val = _weights(row, count[order], idf[at], sublinear) if len(row) else np.zeros(0)
                ends = pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, n_rows) for c in b.columns[:len(keep)]),
                     pa.ListArray.from_arrays(ends, pa.array(number[at].astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(val))], names=[*keep, "idx", "val"])
    return rows.mapInArrow(run, f"{schema}idx array<int>, val array<double>")


# ------------------------------------------------------------------------------------------
# Text -> dense vector (the stand-in for a sentence encoder)
# ------------------------------------------------------------------------------------------
VECTOR_DIM = 256


def token_buckets(text: Column, dim: int = VECTOR_DIM) -> Column:
    """The bucket of every token of a text: the first 32 bits of the token's md5, mod ``dim``
    (md5 so that any SQL engine can reproduce the vector)."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), 0)
    return F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                              F.lit(dim)).cast("int"))


def _bincount(dim: int):
    @F.pandas_udf("array<double>")
    def count(b: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x, dtype=np.int64), minlength=dim).astype(np.float64)
                          for x in b])
    return count


def text_vectors(df: DataFrame, text_col: str, out_col: str, dim: int = VECTOR_DIM) -> DataFrame:
    """``out_col`` = token counts over ``dim`` hashed buckets (not normalised; J2 does).

    A projection, no shuffle: bucket ids are computed in the JVM, and one Arrow-batched
    ``bincount`` per batch turns them into dense vectors (counting per bucket with SQL
    higher-order functions would hash every token ``dim`` times)."""
    return (df.withColumn("__b", token_buckets(F.col(text_col), dim))
            .withColumn(out_col, _bincount(dim)(F.col("__b"))).drop("__b"))
