"""Substring dedup by unit hashing: normalise lines, group their digests over the whole corpus,
keep the earliest occurrence and remove the rest, original offsets kept.

Units are the lines of a text; a line that holds several sentences (``.``, ``!`` or ``?`` before
white space) counts sentence by sentence, so that a passage inside a longer paragraph is found.
A unit's digest is 128 bits of its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased: layout, case and ASCII punctuation do not matter. The earliest occurrence is the
one with the smallest id, then row, then place. Units that are not the earliest and follow each
other form a stretch, and a stretch of at least ``min_words`` words is removed: shorter ones are
set phrases, not passages.

Plan: one numpy pass writes a narrow table of units. Digests are grouped with partial
aggregation, so a unit that a third of all documents share is one row per task; only repeated
digests are joined back (skewed on the units' side only, which AQE splits). Stretches are built
per document, over its repeated units alone.

Defined results: null and empty texts and units without a word have no units; a null id ranks
last; a unit repeated inside one document is removed like any other; equal rows keep the first;
an empty table gives no rows; extra columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm import textkit as K
from supportflow.llm.common import in_batches, prepare, stored

MIN_WORDS = 20
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SECOND = np.uint64(0xA24BAED4963EE407)


def batch_units(column: pa.Array) -> dict[str, np.ndarray]:
    """Per unit with a word: ``row`` of the batch, ``at`` (place in the text), ``start`` and
    ``end`` (code points), ``words``, ``a`` and ``b`` (the digest)."""
    data, offsets = K.text_bytes(column)
    parts = []
    for i, j in K.chunks(offsets):
        at = offsets[i:j + 1] - offsets[i]
        raw = data[offsets[i]:offsets[j]]
        w = K.Words(raw, at, K.ALNUM, lower=True)
        if not len(w.start):
            continue
        h = w.hashes()
        feed = raw == 0x0A
        feed[:-1] |= _STOP[raw[:-1]] & K.SPACES[raw[1:]]
        feeds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(feed, out=feeds[1:])
        new = np.ones(len(h), bool)         # a word that starts a unit
        new[1:] = (feeds[w.start[1:]] != feeds[w.start[:-1]]) | (w.row[1:] != w.row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        up, down = K.powers(len(h) + 1)
        digest = []
        for x in (h, K.mix(h ^ _SECOND)):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * up[:len(h)], out=total[1:])
            digest.append(K.mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_LEAD[raw], out=lead[1:])
        row = w.row[first]
        base = lead[at[row]]
        opens = np.ones(len(first), bool)
        opens[1:] = row[1:] != row[:-1]
        place = np.arange(len(first)) - np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0))
        # a unit ends with its last word and the punctuation that follows it
        stop = w.end[last].copy()
        for _ in range(3):
            more = (stop < at[row + 1]) & ~K.SPACES[raw[np.minimum(stop, len(raw) - 1)]]
            stop[more] += 1
        while True:                         # never inside a character
            inner = (stop < len(raw)) & ~_LEAD[raw[np.minimum(stop, len(raw) - 1)]]
            if not inner.any():
                break
            stop[inner] += 1
        stop = np.minimum(stop, np.append(w.start[first[1:]], len(raw)))
        parts.append({"row": row + i, "at": place, "start": lead[w.start[first]] - base, "end": lead[stop] - base,
                      "words": last - first + 1, "a": digest[0].view(np.int64), "b": digest[1].view(np.int64)})
    names = ("row", "at", "start", "end", "words", "a", "b")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The written table of units: ``id, row, at, start, end, words, a, b``."""
    prepare(docs.sparkSession)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           *(T.StructField(n, T.LongType()) for n in ("row", "at", "start", "end", "words", "a", "b"))])

    def make():
        def run(batch):
            u = batch_units(batch.column(2))
            at = pa.array(u.pop("row"))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x) for x in u.values())],
                names=[f.name for f in schema.fields])
        return run
    return stored(in_batches(rows, make, schema), "units")


def repeats(all_units: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The stretches to remove: ``id, row, start, end, n_words, n_units, first_id`` (the id that
    keeps the stretch's first unit)."""
    rank = F.struct(F.col("id").isNull().alias("n"), "id", "row", "at")
    # written, so that the join below reads two plain shuffles, which AQE can split at a hot unit
    kept = stored(all_units.groupBy("a", "b").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") > 1).select(F.col("a").alias("ka"), F.col("b").alias("kb"), "first"), "kept")
    again = (all_units.join(kept, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))
             .filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at"))))
    by_row = Window.partitionBy("row").orderBy("at")
    runs = (again.select("id", "row", "at", "start", "end", "words", F.col("first.id").alias("first_id"))
            .withColumn("run", F.col("at") - F.row_number().over(by_row)))
    return (runs.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum("words").alias("n_words"), F.count(F.lit(1)).alias("n_units"), F.min_by("first_id", "at").alias("first_id"))
        .filter(F.col("n_words") >= min_words).drop("run"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """``id, start, end, n_words, n_units, first_id`` of every stretch to remove (code points)."""
    return repeats(units(docs, id_col, text_col), min_words).drop("row")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """``docs`` with the stretches cut out of the texts and ``removed`` (after ``prefix``; array
    of ``start, end`` in the original text). The rows are written once with a number of their own, so that the
    stretches find their row again whatever its id."""
    prepare(docs.sparkSession)
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    cut = (repeats(units(numbered, id_col, text_col, "__row"), min_words).groupBy(F.col("row").alias("__r"))
           .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut")))
    out = numbered.join(cut, F.col("__row") == F.col("__r"), "left")

    @F.pandas_udf("string")
    def without(texts, stretches):
        import pandas as pd

        def one(t, spans):
            if t is None or spans is None or not len(spans):
                return t
            pieces, at = [], 0
            for s in spans:
                pieces.append(t[at:s["start"]])
                at = s["end"]
            return "".join([*pieces, t[at:]])
        return pd.Series([one(t, s) for t, s in zip(texts, stretches)], dtype=object)

    text = F.when(F.col("__cut").isNotNull(), without(F.col(text_col), F.col("__cut"))).otherwise(F.col(text_col))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.withColumn("__new", text).select(
        *[F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce("__cut", none).alias(prefix + "removed"))
