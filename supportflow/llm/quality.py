"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` makes one pass over whole texts (numpy over Arrow batches) and adds counts and
shape features per document. ``fit`` boosts histogram trees on labelled rows; ``Trees`` holds
them flattened into numpy node arrays and scores a whole batch at once, one gather per level.
Features named in ``MONOTONE`` can only lower the score as they grow (more symbols, repeats or
duplicate lines never make a document better): a split that would break the order is refused
and the children's values are bounded by the split's middle.

Counts (words are ``[^\\x20\\x09-\\x0D]+``):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
  ``#*$%&|<>``), ``n_dup_lines`` (``\\n``-split lines with a word, equal to an earlier one),
  ``n_repeat_words`` (words in 5-word windows found twice or more in the text).
* ``base_failed``: ``n_words < 10`` or ``100 * n_repeat_words > 20 * n_words``.

The model is fitted on at most about ``max_rows`` labelled documents (a documented bound; a
hash of the document picks them, so reruns agree). Everything else covers all documents.

Defined results: a null or empty text has zero counts and fails the base rule; null labels or
label ids are ignored, a document id labelled more than once counts as good if at least half
of its labels are 1; without labels of both classes the verdict is the base rule alone;
repeated rows are scored row by row; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm import textkit as K
from supportflow.llm.common import in_batches, prepare, stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "punct_share", "line_words", "distinct_share", "short_share", "ending_share"]
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
MAX_ROWS = 20_000

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def repeated_words(w: K.Words, h: np.ndarray, rows: int, size: int = 5) -> np.ndarray:
    """Per row, the words inside windows of ``size`` words that occur twice or more in it."""
    gram, valid = K.windows(h, w.row, size)
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(rows, np.int64)
    key = gram[at] ^ K.mix(w.row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    twice = np.append(same, False) | np.insert(same, 0, False)
    hit = K.covered(len(w.start), at[twice], size)
    return np.bincount(w.row[hit], minlength=rows)


def batch_statistics(column: pa.Array) -> np.ndarray:
    """``COUNTS`` then ``FEATURES``, one row per text."""
    data, offsets = K.text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS) + len(FEATURES)))
    for i, j in K.chunks(offsets):
        at = offsets[i:j + 1] - offsets[i]
        raw = data[offsets[i]:offsets[j]]
        w = K.Words(raw, at, K.NON_SPACE, lower=False)
        h = w.hashes()
        words = w.per_row
        chars = _per_row(_LEAD[raw], at)
        word_chars = _per_row(_LEAD[raw] & w.inside, at)
        symbols = _per_row(_SYMBOL[raw], at)
        repeats = repeated_words(w, h, j - i)
        lines, dups, ends = (np.zeros(j - i, np.int64) for _ in range(3))
        for r in range(j - i):
            seen: set[bytes] = set()
            for line in raw[at[r]:at[r + 1]].tobytes().split(b"\n"):
                if line and line.strip(b" \t\n\x0b\x0c\r"):
                    lines[r] += 1
                    ends[r] += line[-1:] in b".!?"
                    if line in seen:
                        dups[r] += 1
                    else:
                        seen.add(line)
        order = np.lexsort((h, w.row))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
        distinct = np.bincount(w.row[order][first], minlength=j - i)
        short = np.bincount(w.row[(w.end - w.start) <= 3], minlength=j - i)
        nw, nc, nl = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
        out[i:j] = np.column_stack([
            words, word_chars, symbols, dups, repeats,
            np.log1p(words), word_chars / nw, symbols / nc, dups / nl, repeats / nw, _per_row(_UPPER[raw], at) / nc,
            _per_row(_DIGIT[raw], at) / nc, _per_row(_PUNCT[raw], at) / nc, words / nl, distinct / nw, short / nw,
            ends / nl])
    return out


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
               prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default: all) with the counts (long) and features (double)."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields[:-1])]
                          + [T.StructField(f"s{c}", T.LongType()) for c in COUNTS]
                          + [T.StructField(f"s{c}", T.DoubleType()) for c in FEATURES])
    names = [f.name for f in schema.fields]

    def make():
        def run(batch):
            x = batch_statistics(batch.column(batch.num_columns - 1))
            n = len(COUNTS)
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x[:, k].astype(np.int64)) for k in range(n)),
                 *(pa.array(x[:, k]) for k in range(n, x.shape[1]))], names=names)
        return run
    return in_batches(rows, make, schema).toDF(*keep, *[prefix + c for c in COUNTS + FEATURES])


@dataclass
class Trees:
    """Boosted trees as flat node arrays; ``feature < 0`` marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, min_leaf: int = 20, l2: float = 1.0) -> Trees:
    """Logistic gradient boosting with histogram splits and monotonic constraints."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(p / (1 - p)))
    raw = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []

    def grow(rows, grad, hess, level, low, high):
        g, h = grad[rows].sum(), hess[rows].sum()
        me = len(nodes)
        value = float(np.clip(-g / (h + l2), low, high))
        nodes.append([-1, 0.0, 0, 0, value * rate])
        best = None
        if level < depth and len(rows) >= 2 * min_leaf:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b, k = binned[rows, f], len(c) + 1
                gl = np.cumsum(np.bincount(b, grad[rows], k))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], k))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
                vl = np.clip(-gl / (hl + l2), low, high)
                vr = np.clip(-(g - gl) / (h - hl + l2), low, high)
                gain = gl ** 2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g ** 2 / (h + l2)
                gain[(nl < min_leaf) | (len(rows) - nl < min_leaf)] = -1
                if monotone[f]:
                    gain[(vr - vl) * monotone[f] < 0] = -1
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, vl[at], vr[at])
        if best:
            _, f, at, vl, vr = best
            go = binned[rows, f] <= at
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)),
                      0: ((low, high), (low, high))}[monotone[f]]
            nodes[me][:2] = [f, float(cuts[f][at])]
            nodes[me][2] = grow(rows[go], grad, hess, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~go], grad, hess, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        done = _pack(nodes, roots[-1:], 0.0, depth)
        raw += done.raw(x)
    return _pack(nodes, roots, bias, depth)


def _pack(nodes, roots, bias, depth) -> Trees:
    a = np.array(nodes)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4],
                 np.array(roots), bias, depth)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          max_rows: int = MAX_ROWS, prefix: str = "") -> Trees | None:
    """The model of at most about ``max_rows`` labelled rows of ``stats``; None unless both
    classes occur. Ids are compared as text."""
    good = (labels.select(F.col(id_col).cast("string").alias("__id"), F.col(label_col).cast("double").alias("__y"))
            .dropna().groupBy("__id").agg((F.avg("__y") >= 0.5).cast("int").alias("__y")))
    rows = stats.select(F.col(id_col).cast("string").alias("__id"), *[prefix + c for c in FEATURES]).join(good, "__id")
    n = good.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    got = rows.drop("__id").limit(2 * max_rows).toPandas().to_numpy(float)
    y = got[:, -1] if len(got) else np.zeros(0)
    if len(np.unique(y)) < 2:
        return None
    got = got[np.lexsort(got.T)]
    return fit(got[:, :-1], got[:, -1], [MONOTONE.get(f, 0) for f in FEATURES])


def score(stats: DataFrame, model: Trees | None, prefix: str = "", out: str = "quality_score") -> DataFrame:
    """``stats`` with the model's probability of good quality (1.0 without a model)."""
    if model is None:
        return stats.withColumn(out, F.lit(1.0))

    @F.pandas_udf("double")
    def run(*cols):
        import pandas as pd
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in cols])))
    return stats.withColumn(out, run(*[F.col(prefix + c) for c in FEATURES]))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.5, max_rows: int = MAX_ROWS, keep: list[str] | None = None,
                  prefix: str = "") -> DataFrame:
    """``keep`` columns (default: all) with the counts, ``base_failed``, ``quality_score`` and
    ``kept`` (false if the base rule fails, else score >= ``threshold``)."""
    keep = docs.columns if keep is None else keep
    stats = stored(statistics(docs, text_col, keep, prefix="__q_"), "statistics")
    model = train(stats, labels, id_col, max_rows=max_rows, prefix="__q_")
    scored = score(stats, model, prefix="__q_", out="__q_score")
    failed = (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))
    return scored.select(*keep, *[F.col("__q_" + c).alias(prefix + c) for c in COUNTS],
                         failed.alias(prefix + "base_failed"), F.col("__q_score").alias(prefix + "quality_score"),
                         (~failed & (F.col("__q_score") >= threshold)).alias(prefix + "kept"))
