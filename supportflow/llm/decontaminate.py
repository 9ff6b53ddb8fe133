"""Benchmark decontamination: a broadcast set of normalised test n-grams, a scan of every
training window, verified hits, removal of spans or documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is
``size`` consecutive words of an item; an item with fewer words, but not none, is one window.
A document word inside any occurrence of a window is hit.

Plan: the windows are computed and de-duplicated by Spark and broadcast to one narrow pass over
the documents. More than ``block_rows`` (window, item) rows are dealt into blocks: each has a
plan of its own that holds no other block and writes the hits of the distinct texts that have
some; these meet the documents by the text's digest, and a last pass joins each text's hits.
The driver and a task hold one block at a time, whatever the benchmark's size. Windows are
compared by a 64-bit hash first and then by their bytes.

Defined results: a null or empty text has no words and no hits; a null item text has no
windows; a null item id counts as the empty string; repeated items count once, as items are
told apart by id; repeated documents have equal results; an empty benchmark leaves every document
clean; extra columns of documents pass through, and the four added columns take the caller's
``prefix``: without it, a column of one of their names raises.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm import textkit as K
from supportflow.llm.common import in_batches, prepare, small_side, stored

SIZE = 10
BLOCK_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """Distinct ``(window, length, item)``: a window is its words joined by one space."""
    words = (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                          F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER),
                                               F.lit(WORD), 0).alias("w"))
             .filter(F.size("w") > 0)
             .withColumn("length", F.least(F.size("w"), F.lit(size))))
    return (words.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1))
                         .alias("at"))
            .select(F.concat_ws(" ", F.slice("w", F.col("at"), F.col("length"))).alias("window"), "length", "item")
            .distinct())


def blocks(windows: DataFrame, block_rows: int = BLOCK_ROWS):
    """The windows as lists of at most about ``block_rows`` rows, one at a time."""
    k = max(1, -(-windows.count() // block_rows))
    if k == 1:
        yield windows.collect()
        return
    dealt = windows.withColumn("b", F.pmod(F.xxhash64("window", "item"), F.lit(2 * k)))
    for b in range(2 * k):
        yield dealt.filter(F.col("b") == b).drop("b").collect()


class Lookup:
    """A block's windows by length: a bitmap and sorted hashes in front of the exact windows."""

    BITS = 20

    def __init__(self, rows: list[tuple]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for window, _, item in rows:
            self.items[window.encode()].append(item)
        self.by_length = {}
        lengths = defaultdict(list)
        for window, length in {(r[0], r[1]) for r in rows}:
            lengths[length].append(window)
        for length, texts in lengths.items():
            data, offsets = K.text_bytes(pa.array(texts, pa.string()))
            w = K.Words(data, offsets, K.ALNUM, lower=False)
            gram, _ = K.windows(w.hashes(), w.row, length)
            table = np.unique(gram[w.first])
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[table >> np.uint64(64 - self.BITS)] = True
            self.by_length[length] = (table, bitmap)

    def find(self, w: K.Words):
        """Yields ``(first word, length, items)`` of every occurrence of a window."""
        h = w.hashes()
        for length, (table, bitmap) in self.by_length.items():
            gram, valid = K.windows(h, w.row, length)
            at = np.flatnonzero(bitmap[gram >> np.uint64(64 - self.BITS)] & valid)
            near = np.minimum(np.searchsorted(table, gram[at]), len(table) - 1)
            for i in at[table[near] == gram[at]]:
                text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i:i + length], w.end[i:i + length]))
                if text in self.items:
                    yield int(i), length, self.items[text]


def _scan(text_index: int, block, first: bool):
    """A pass over record batches: adds words, hit words, spans and items by the broadcast
    ``block``, or (not ``first``) works them out from the spans and items in the last columns."""
    def make():
        lookup = Lookup(block.value if first else [])

        def run(batch):
            old = batch.columns if first else batch.columns[:-4]
            data, offsets = K.text_bytes(batch.column(text_index))
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list[int]] = [[] for _ in range(n)] if first else batch.columns[-2].to_pylist()
            items: list[set] = [set() for _ in range(n)] if first else [set(x) for x in batch.columns[-1].to_pylist()]
            for i, j in K.chunks(offsets):
                at = offsets[i:j + 1] - offsets[i]
                w = K.Words(data[offsets[i]:offsets[j]], at, K.ALNUM, lower=True)
                n_words[i:j] = w.per_row
                steps = np.zeros(len(w.start) + 1, np.int32)
                for p, length, found in lookup.find(w):
                    steps[p] += 1
                    steps[p + length] -= 1
                    items[i + w.row[p]].update(found)
                for r in range(i, j):
                    for s, e in zip(spans[r][::2], spans[r][1::2]):
                        a, b = np.searchsorted(w.start, [at[r - i] + s, at[r - i] + e])
                        steps[a] += 1
                        steps[b] -= 1
                hit = np.cumsum(steps[:-1]) > 0
                n_hit[i:j] = np.bincount(w.row[hit], minlength=j - i)
                edge = np.flatnonzero(hit)
                if len(edge):
                    new = (np.diff(edge, prepend=-2) != 1) | (np.diff(w.row[edge], prepend=-1) != 0)
                    last = np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)
                    for r in np.unique(w.row[edge]):
                        spans[i + r] = []
                    for a, b in zip(edge[new], edge[last]):
                        r = w.row[a]
                        spans[i + r] += [int(w.start[a] - at[r]), int(w.end[b] - at[r])]
            more = [pa.array(n_words), pa.array(n_hit), pa.array(spans, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*old, *more], names=[f"c{c}" for c in range(len(old) + 4)])
        return run
    return make


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", block_rows: int = BLOCK_ROWS, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (flat list of byte offsets start, end of
    the merged hit stretches in the text) and ``item_ids`` (items with occurring windows,
    sorted as strings), each name after ``prefix``."""
    prepare(docs.sparkSession)
    fields = docs.schema.fields
    at = docs.columns.index(text_col)
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", T.ArrayType(T.LongType())),
             ("item_ids", T.ArrayType(T.StringType()))]
    types = [*(f.dataType for f in fields), *(t for _, t in added)]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    if clash := {prefix + n for n, _ in added} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; set prefix")
    send = docs.sparkSession.sparkContext.broadcast
    windows = stored(item_windows(items, size, item_id, item_text), "windows")
    rows = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    names = [*docs.columns, *[prefix + n for n, _ in added]]
    parts = blocks(windows, block_rows)
    block, another = next(parts), next(parts, None)
    if another is None:
        return in_batches(rows, _scan(at, send([tuple(r) for r in block]), True), schema).toDF(*names)

    narrow = docs.select(F.col(text_col).alias("c0"))
    one = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([T.StringType(), *types[len(fields):]])])
    hits = []
    for block in itertools.chain([block, another], parts):
        sent = send([tuple(r) for r in block])
        found = in_batches(narrow, _scan(0, sent, True), one).filter(F.col("c2") > 0)
        hits.append(stored(found.groupBy(F.md5("c0").alias("x")).agg(F.first("c3").alias("spans"), F.first("c4").alias("items")),
                           "hits"))                         # equal texts have equal hits
        sent.unpersist()
    every = reduce(DataFrame.unionByName, hits).groupBy("x").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    every = small_side(stored(every, "hits"))
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    joined = (rows.withColumn("x_", F.md5(f"c{at}")).join(every, F.col("x_") == F.col("x"), "left")
              .select(*rows.columns, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                      F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")))
    return in_batches(joined, _scan(at, None, False), schema).toDF(*names)


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """The text without the stretches of ``spans``; the words around a cut stay apart, as the
    characters between words are kept."""
    raw, n = F.encode(text, "UTF-8"), F.size(spans)
    half = (n / 2).cast("int")

    def piece(i):
        start = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, 2 * i))
        end = F.when(i == half, F.octet_length(text)).otherwise(F.try_element_at(spans, 2 * i + 1))
        return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int"))

    pieces = F.transform(F.sequence(F.lit(0), half), piece)
    joined = F.aggregate(pieces, F.lit(b""), lambda a, b: F.concat(a, b))
    return F.when(n > 0, F.decode(joined, "UTF-8")).otherwise(text)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "document", text_col: str = "text",
                  **options) -> DataFrame:
    """The columns of ``docs``; ``mode="document"`` drops every document with a hit word,
    ``mode="span"`` keeps all documents and cuts the hit stretches out of their texts."""
    found = scan(docs, items, text_col=text_col, prefix="__hit_", **options)
    if mode == "document":
        kept = found.filter(F.col("__hit_n_hit") == 0)
    elif mode == "span":
        kept = found.withColumn(text_col, without_spans(F.col(text_col), F.col("__hit_spans")))
    else:
        raise ValueError(f"mode {mode!r}: 'document' or 'span'")
    return kept.select(*docs.columns)
