"""Learned dense text vectors (J1): a randomised singular value decomposition of the TF-IDF rows.

``A`` has one sparse row per text (L1, unit length) and a column per term. Its best rank-``k``
right factors ``V`` turn a sparse row ``a`` into the dense vector ``a V``.

1. Range finder. ``Q`` starts as a random matrix (terms x ``k + OVERSAMPLE``, from a seed) and is
   replaced ``passes`` times by an orthonormal basis of ``A' (A Q)``. In a pass every task
   multiplies its rows with ``Q`` and adds up its part of the product, so a row is read once and
   only sums per term and task are shuffled.
2. ``A Q`` is factorised by a tree of QR steps: a task reduces its rows to one triangle, groups of
   ``FAN`` triangles are stacked and reduced again until one is left. The singular values of the
   last triangle are those of ``A Q``, and its right factors turn ``Q`` into ``V``.

The driver and each task hold one matrix of terms x ``k + OVERSAMPLE`` doubles (``max_terms`` is
checked: 200,000 terms at 42 columns are 67 MB); rows, texts and products over rows stay distributed.

Defined results: a text without a known term is the zero vector; fewer rows or terms than ``k``
give fewer columns' worth of information and zeros in the rest; no rows give zero factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.operators import features as FT
from supportflow.session import written

OVERSAMPLE, FAN, MAX_TERMS = 10, 32, 200_000
TERMS = 1 << 17                                    # of the rows that a task multiplies at a time


def _slices(idx, val):
    """The rows of a batch in slices of about ``TERMS`` terms (a longer row is a slice of its own), so
    that a task's products are bounded by that, not by the batch."""
    ends = np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < len(idx):
        done = ends[s - 1] if s else 0
        n = max(1, int(np.searchsorted(ends, done + TERMS, "right")) - s)
        yield idx.slice(s, n), val.slice(s, n)
        s += n


def _products(idx, val, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, value, rows times Q)`` of a batch of sparse rows."""
    n = len(idx)
    width = idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, term = np.repeat(np.arange(n), width), idx.flatten().to_numpy()
    value = val.flatten().to_numpy()
    y = np.zeros((n, Q.shape[1]))
    filled = np.flatnonzero(width)
    if len(filled):
        starts = (np.cumsum(width) - width)[filled]
        y[filled] = np.add.reduceat(value[:, None] * Q[term], starts, axis=0)
    return row, term, value, y


def _gram_pass(rows: DataFrame, Q: np.ndarray) -> np.ndarray:
    """``A' (A Q)``: sums per term, combined in the task and then by Spark."""
    n, l = Q.shape
    sent = rows.sparkSession.sparkContext.broadcast(Q)
    names = [f"z{j}" for j in range(l)]

    def run(batches):
        q = sent.value
        z = np.zeros_like(q)
        for b in batches:
            for idx, val in _slices(b.column(0), b.column(1)):
                row, term, value, y = _products(idx, val, q)
                order = np.argsort(term, kind="stable")
                seen, starts = np.unique(term[order], return_index=True)
                if len(seen):
                    z[seen] += np.add.reduceat(value[order, None] * y[row[order]], starts, axis=0)
        at = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(z[at, j]) for j in range(l))], names=["term", *names])
    sums = (rows.select("idx", "val").mapInArrow(run, "term int, " + ", ".join(f"{c} double" for c in names))
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow())       # one row per term at most
    sent.unpersist()
    out = np.zeros((n, l))
    if sums.num_rows:
        out[sums["term"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in names])
    return out


def _triangle(blocks: np.ndarray) -> np.ndarray:
    """The triangle of a QR step, with as many rows as columns."""
    r = np.linalg.qr(blocks, mode="r")
    return np.vstack([r, np.zeros((max(0, blocks.shape[1] - len(r)), blocks.shape[1]))])


def _tree_triangle(rows: DataFrame, Q: np.ndarray) -> np.ndarray:
    """The triangle of ``A Q``, by a tree of QR steps over the cluster."""
    l = Q.shape[1]
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(Q)
    schema = "part long, r array<double>"

    def local(batches):
        from pyspark import TaskContext
        r = np.zeros((0, l))
        for b in batches:
            for idx, val in _slices(b.column(0), b.column(1)):
                r = _triangle(np.vstack([r, _products(idx, val, sent.value)[3]]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.ravel()])], names=["part", "r"])

    def merge(key, parts):
        stacked = np.vstack([np.array(x).reshape(-1, l) for x in parts["r"].to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_triangle(stacked).ravel()], pa.list_(pa.float64()))})
    level = written(rows.select("idx", "val").mapInArrow(local, schema), "triangles")
    while (n := level.count()) > FAN:
        level = written(level.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, schema), "triangles")
    last = [np.array(r["r"]).reshape(-1, l) for r in level.orderBy("part").collect()]         # at most FAN triangles
    return _triangle(np.vstack(last)) if n else np.zeros((l, l))


@dataclass
class Factors:
    """``vocab`` (``term, number, idf``), right factors (terms x k) and singular values."""

    vocab: pa.Table
    right: np.ndarray
    values: np.ndarray
    sublinear: bool

    def vectors(self, docs: DataFrame, text_col: str, keep: list[str], out_col: str = "vec") -> DataFrame:
        """``keep`` with the dense vector of each text (not normalised; J2 does)."""
        rows = FT.sparse_rows(docs, self.vocab, self.sublinear, text_col, keep)
        sent = docs.sparkSession.sparkContext.broadcast(self.right)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)])

        def run(batches):
            for b in batches:
                y = np.vstack([np.zeros((0, sent.value.shape[1])), *(
                    _products(idx, val, sent.value)[3] for idx, val in _slices(b.column(len(keep)), b.column(len(keep) + 1)))])
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))],
                                                 names=[*keep, out_col])
        return rows.mapInArrow(run, f"{fields}, `{out_col}` array<double>")


def decompose(rows: DataFrame, n_terms: int, k: int, passes: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(right factors, singular values)`` of written sparse rows ``idx, val``."""
    if n_terms > MAX_TERMS:
        raise ValueError(f"{n_terms} terms; keep at most {MAX_TERMS} (max_features)")
    l = max(1, min(k + OVERSAMPLE, n_terms))
    Q = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(1, n_terms), l)))[0]
    for _ in range(passes):
        z = _gram_pass(rows, Q)
        if not z.any():
            break
        Q = np.linalg.qr(z)[0]
    _, s, w = np.linalg.svd(_tree_triangle(rows, Q))
    right = (Q @ w.T)[:n_terms, :k]
    values = s[:k]
    return np.pad(right, ((0, 0), (0, k - right.shape[1]))), np.pad(values, (0, k - len(values)))


def fit(docs: DataFrame, k: int = 32, text_col: str = "text", min_df: int = 2, max_features: int = 20_000,
        sublinear: bool = True, passes: int = 4) -> Factors:
    """The factors of the TF-IDF rows of ``docs`` (vocabulary cut and numbered as in L1)."""
    terms = FT.vocabulary(docs, min_df, max_features, text_col).orderBy(F.desc("total"), "term").toArrow()
    vocab = pa.table({"term": terms["term"], "number": np.arange(terms.num_rows), "idf": terms["idf"]})
    rows = written(FT.sparse_rows(docs, vocab, sublinear, text_col, []), "rows")
    return Factors(vocab, *decompose(rows, vocab.num_rows, k, passes), sublinear)
