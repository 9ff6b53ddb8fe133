"""Exact vector retrieval.

A corpus of at most ``block_rows`` rows and ``BLOCK_BYTES`` is one block: it is counted, sent to
the tasks once, and the queries are scored where they lie, without a shuffle.

For a larger one, queries and corpus are packed (``PACK`` rows with their non-zero components in
one binary), packs are dealt into blocks of at most ``CELL_BYTES``, and every pair of a query block
and a corpus block is a cell, which one task scores. The packs are what is copied and shuffled: a
query once per corpus block, a case once per query block. A cell multiplies in single precision, a
tile at a time; whatever lies within twice the rounding error of a query's ``k``-th score is scored
again in double precision, in the order of the components, so results are exact, and equal vectors
have equal scores wherever they lie.

Behind the first tile a cell multiplies folded rows, of half the components: the lengths of groups
of components, whose product is no less than the score (Cauchy-Schwarz in each group). Only pairs
whose bound reaches the ``k``-th score so far are scored. A tile where many do meets whole rows; where
such tiles are not rare, as with dense vectors, the cell goes back to whole rows. All products of a
batch of queries go to one room that fits a core's cache. The work is every pair, at the speed of
the matrix product.

With ``pivots`` the corpus is grouped around as many of its own vectors instead, so that most
blocks need not be read where vectors lie in tight groups (hashed texts do not):

* every corpus vector goes to its nearest pivot; the pivots are the leaves of a tree of two
  levels, whose top is the square root of them. Both levels keep their rows' largest angle to
  the pivot and extreme norms (one summary row per leaf, at most ``MAX_PIVOTS``);
* a query's score in a group can be no better than ``|q| * norm * cos(angle(q, pivot) -
  largest angle)``; each query first visits its most promising leaves and so learns a k-th
  score that any better hit must reach;
* it then visits just the leaves whose bound reaches that score; a top pivot whose bound doesn't
  rules out all leaves below it. The result is exact.

Groups are cut into parts of at most ``block_rows``. What a group costs follows from a histogram
of the visits: a part is copied once per ``block_rows`` queries that visit its own group, never
for queries that go elsewhere. A task multiplies one part with one block of its visitors by numpy
and keeps the best ``k`` per query; a final window over ``qid`` (at most ``k`` rows per visited
part) picks the global top ``k``. Ties go to the smaller ``case_id``. No cross join; only the
pivots and their summaries are sent to the tasks, which handle ``CHUNK`` vectors at a time.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.functions.text import fmt_fixed, py_strip
from supportflow.session import ensure_checkpoint_dir, spread, written

HITS_SCHEMA = "qid long, rank int, case_id long, score double"


def vector_norm(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(df: DataFrame, vec_col: str, out_col: str | None = None) -> DataFrame:
    """Unit length in double precision; a zero vector stays zero."""
    out_col = out_col or vec_col
    return (df.withColumn("__norm", vector_norm(vec_col))
            .withColumn(out_col, F.transform(
                F.col(vec_col), lambda x: F.when(F.col("__norm") > 0, x.cast("double") / F.col("__norm"))
                .otherwise(x.cast("double"))))
            .drop("__norm"))


def _topk_rows(S: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the best ``k`` per row of ``S``: score desc, then id asc.

    ``argpartition`` finds candidates in linear time; rows whose k-th score is tied with
    an excluded column fall back to a full stable sort, so ties are broken exactly.
    """
    n = S.shape[1]
    if k >= n:
        return np.lexsort((np.broadcast_to(ids, S.shape), -S), axis=-1)
    part = np.argpartition(-S, k - 1, axis=1)[:, :k]
    vals = np.take_along_axis(S, part, axis=1)
    kth = vals.min(axis=1)
    tied = (S >= kth[:, None]).sum(axis=1) > k
    order = np.lexsort((ids[part], -vals), axis=-1)
    out = np.take_along_axis(part, order, axis=1)
    for r in np.flatnonzero(tied):
        out[r] = np.lexsort((ids, -S[r]))[:k]
    return out


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as one matrix."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    n = sum(map(len, arrays))
    flat = [a.flatten().to_numpy(zero_copy_only=False) for a in arrays]
    return np.concatenate(flat).astype(np.float64, copy=False).reshape(n, -1) if n else np.zeros((0, 0))


def _best_of_block(qids: np.ndarray, Q: np.ndarray, ids: np.ndarray, C: np.ndarray, k: int, exclude_self: bool) -> pa.Table:
    """The best ``k`` of the block per query; scores of ``CHUNK`` queries at a time."""
    kk, out = min(k, len(ids)), []
    for s in range(0, len(Q), CHUNK):
        S = Q[s:s + CHUNK] @ C.T
        own = qids[s:s + CHUNK]
        if exclude_self:                           # a row never retrieves itself
            S[own[:, None] == ids[None, :]] = -np.inf
        top = _topk_rows(S, ids, kk)
        score = np.take_along_axis(S, top, axis=1).reshape(-1)
        columns = np.repeat(own, kk), np.tile(np.arange(1, kk + 1, dtype=np.int32), len(own)), ids[top].reshape(-1), score
        out.append([c[np.isfinite(score)] for c in columns] if exclude_self else columns)
    kinds = (np.int64, np.int32, np.int64, np.float64)
    return pa.table([pa.array(np.concatenate([np.zeros(0, t), *(o[i] for o in out)])) for i, t in enumerate(kinds)],
                    names=["qid", "rank", "case_id", "score"])


def _block_topk(k: int, exclude_self: bool):
    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        ids, qids = (t[n].to_numpy().astype(np.int64) for t, n in ((c, "case_id"), (q, "qid")))
        if not len(ids) or not len(qids):
            qids, Q, C = qids[:0], np.zeros((0, 1)), np.zeros((len(ids), 1))
        else:
            Q, C = _matrix(q["qvec"]), _matrix(c["vec"])
        return _best_of_block(qids, Q, ids, C, k, exclude_self)
    return run


def _sizes(queries: DataFrame, corpus: DataFrame) -> tuple[int, int, int]:
    """Rows of both sides, and the length of the corpus vectors. Rows are counted without making
    their vectors: all of a corpus have the length of the first, unless that is null."""
    rows = (queries.select(F.lit("q").alias("side")).unionByName(corpus.select(F.lit("c").alias("side")))
            .groupBy("side").count().collect())
    n = {r["side"]: r["count"] for r in rows}
    first = corpus.select("vec").take(1) if n.get("c") else []
    dim = len(first[0][0]) if first and first[0][0] is not None else corpus.agg(F.max(F.size("vec"))).first()[0] or 0
    return n.get("q", 0), n.get("c", 0), dim


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("case_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


MAX_PIVOTS = 4096
CHUNK = 128                                        # vectors that a task handles at a time
BLOCK_BYTES = 64 << 20                             # of a corpus that is sent to the tasks whole


class PivotTree:
    """Directions in two levels that group a corpus, with each group's bounds (numpy, sent to the
    tasks). Leaf ``len(leaves)`` holds vectors without a direction (zeros): their score is 0.

    No step holds more than ``CHUNK`` cosines per pivot (4 MB); a query meets the leaves of a top
    pivot only if that one's bound lets it."""

    def __init__(self, directions: np.ndarray):
        self.leaves = directions
        top = directions[:math.isqrt(len(directions)) or len(directions)]
        nearest = np.array([int((top @ v).argmax()) for v in directions], np.int64)
        used, self.parent = np.unique(nearest, return_inverse=True)      # equal directions: some have no leaf
        self.top = top[used]
        self.below = [np.flatnonzero(self.parent == t) for t in range(len(used))]
        self.summary(np.zeros((0, 6)))

    def summary(self, rows: np.ndarray) -> None:
        """``g, n, largest angle, largest angle to the top pivot, smallest norm, largest norm``."""
        n, m = len(self.leaves) + 1, len(self.top)
        self.rows, self.angle, self.low, self.high = (np.zeros(n) for _ in range(4))
        self.top_angle, self.top_high, self.top_low = np.zeros(m), np.full(m, -np.inf), np.full(m, np.inf)
        for g, size, angle, top_angle, low, high in rows:
            g = int(g)
            self.rows[g], self.angle[g], self.low[g], self.high[g] = size, angle, low, high
            if g < len(self.leaves):
                t = self.parent[g]
                self.top_angle[t] = max(self.top_angle[t], top_angle)
                self.top_high[t], self.top_low[t] = max(self.top_high[t], high), min(self.top_low[t], low)

    @staticmethod
    def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        return vectors / np.where(norm > 0, norm, 1)[:, None], norm

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(leaf, angle, angle to the top pivot, norm)`` of corpus vectors."""
        out = []
        for s in range(0, len(vectors), CHUNK):
            unit, norm = self.units(vectors[s:s + CHUNK])
            cosine = np.clip(unit @ self.leaves.T, -1, 1)
            leaf = cosine.argmax(axis=1)
            angle = np.arccos(cosine[np.arange(len(unit)), leaf])
            top_angle = np.arccos(np.clip((unit * self.top[self.parent[leaf]]).sum(axis=1), -1, 1))
            zero = norm == 0
            out.append((np.where(zero, len(self.leaves), leaf), np.where(zero, 0.0, angle), np.where(zero, 0.0, top_angle), norm))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))

    @staticmethod
    def bound(cosine, norm, angle, low, high) -> np.ndarray:
        best = np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - angle))
        return norm[:, None] * np.where(best >= 0, best * high, best * low) + 1e-9

    def leaf_bounds(self, unit: np.ndarray, norm: np.ndarray, t: int) -> np.ndarray:
        own = self.below[t]
        bound = self.bound(unit @ self.leaves[own].T, norm, self.angle[own], self.low[own], self.high[own])
        return np.where(self.rows[own] > 0, bound, -np.inf)

    def top_bounds(self, unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return np.zeros((len(unit), 0))
        filled = np.isfinite(self.top_high)
        bound = self.bound(unit @ self.top.T, norm, self.top_angle, np.where(filled, self.top_low, 0),
                           np.where(filled, self.top_high, 0))
        return np.where(filled, bound, -np.inf)

    def first(self, vectors: np.ndarray, k: int) -> list[np.ndarray]:
        """The leaves with the best bounds, as many as it takes to hold ``k`` rows."""
        out = [np.array([len(self.leaves)])] * len(vectors)
        filled = np.flatnonzero(self.rows[:-1])
        for s in range(0, len(vectors) if len(filled) else 0, CHUNK):
            unit, norm = self.units(vectors[s:s + CHUNK])
            bound = self.bound(unit @ self.leaves[filled].T, norm, self.angle[filled], self.low[filled], self.high[filled])
            order = np.argsort(-bound, axis=1, kind="stable")
            sizes = self.rows[filled][order]
            for i, o, n in zip(range(s, s + len(unit)), order, (np.cumsum(sizes, axis=1) - sizes < k).sum(axis=1)):
                out[i] = filled[o[:n]]
        return out

    def reached(self, vectors: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """Per query the leaves that may hold a score of at least ``least``."""
        out: list[list[np.ndarray]] = [[] for _ in vectors]
        zeros = np.array([len(self.leaves)])
        for s in range(0, len(vectors), CHUNK):
            unit, norm = self.units(vectors[s:s + CHUNK])
            bar = least[s:s + CHUNK]
            open_ = self.top_bounds(unit, norm) >= bar[:, None]
            for x in range(len(self.top)):
                at = np.flatnonzero(open_[:, x])
                if len(at) and np.isfinite(self.top_high[x]):
                    bounds = self.leaf_bounds(unit[at], norm[at], x)
                    for i, row in zip(at, (bounds >= bar[at, None]) & np.isfinite(bounds)):
                        out[s + i].append(self.below[x][row])
            if self.rows[len(self.leaves)]:
                for i in np.flatnonzero(bar <= 1e-9):
                    out[s + i].append(zeros)
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _grouped_corpus(corpus: DataFrame, block_rows: int, n_pivots: int) -> tuple[DataFrame, DataFrame, PivotTree]:
    """The corpus with ``g, part`` (written once), its groups ``g, parts``, and the pivots."""
    unit = corpus.filter(vector_norm("vec") > 0).orderBy(F.xxhash64("case_id"), "case_id").limit(n_pivots)
    sample = _matrix(unit.select("vec").toArrow()["vec"])                             # at most MAX_PIVOTS rows
    tree = PivotTree(PivotTree.units(sample)[0] if len(sample) else np.zeros((0, 1)))
    sent = corpus.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("g int, angle double, top double, norm double")
    def place(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float)
        if not len(sent.value.leaves):
            return pd.DataFrame({"g": np.zeros(len(x), int), "angle": 0.0, "top": 0.0, "norm": 0.0})
        return pd.DataFrame(dict(zip(("g", "angle", "top", "norm"), sent.value.place(x))))

    placed = written(corpus.select(F.col("case_id").cast("long"), "vec", place("vec").alias("p"))
                     .select("case_id", "vec", "p.*"), "corpus")
    groups = written(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a"), F.max("top").alias("t"),
                                             F.min("norm").alias("l"), F.max("norm").alias("h")), "groups")
    tree.summary(np.array([tuple(r) for r in groups.collect()], float).reshape(-1, 6))     # one row per leaf
    groups = F.broadcast(groups.select(F.col("g").alias("group"), F.ceil(F.col("n") / block_rows).alias("parts")))
    parted = (placed.join(groups, F.col("g") == F.col("group"))
              .select("case_id", "vec", "g", F.pmod(F.xxhash64("case_id"), "parts").alias("part")))
    return parted, groups, tree


def _visit(queries: DataFrame, corpus: DataFrame, groups: DataFrame, k: int, block_rows: int, exclude_self: bool,
           histogram: list | None = None) -> DataFrame:
    """Hits of ``queries(qid, qvec, to)`` in the groups ``to`` that they visit, part by part. A part
    has a copy per ``block_rows`` visits of its own group."""
    going = queries.select("qid", "qvec", F.explode("to").alias("g"))
    visits = written(going.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "visits")
    if histogram is not None:
        histogram += [(r["g"], r["n"], math.ceil(r["n"] / block_rows)) for r in visits.collect()]
    copies = F.broadcast(visits.join(groups, F.col("g") == F.col("group"))           # one row per group
                         .select(F.col("g").alias("v"), "parts", F.ceil(F.col("n") / block_rows).alias("copies")))
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))     # noqa: E731
    q = (going.join(copies, F.col("g") == F.col("v"))
         .select("qid", "qvec", "g", to("parts").alias("part"), F.pmod(F.xxhash64("qid"), "copies").alias("qb")))
    c = (corpus.join(copies, F.col("g") == F.col("v"))
         .select("case_id", "vec", F.col("g").alias("g"), "part", to("copies").alias("qb")))
    return (q.groupBy("g", "part", "qb").cogroup(c.groupBy("g", "part", "qb"))
            .applyInArrow(_block_topk(k, exclude_self), HITS_SCHEMA))


def _pruned_top_k(queries: DataFrame, corpus: DataFrame, k: int, nq: int, block_rows: int,
                  n_pivots: int, exclude_self: bool, visits: dict | None) -> DataFrame:
    c, groups, tree = _grouped_corpus(corpus, block_rows, n_pivots)
    sent = queries.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("array<int>")
    def first_group(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.first(np.stack(v.to_numpy()).astype(float), k))

    @F.pandas_udf("array<int>")
    def other_groups(v: pd.Series, done: pd.Series, least: pd.Series) -> pd.Series:
        reach = sent.value.reached(np.stack(v.to_numpy()).astype(float), least.to_numpy())
        return pd.Series([np.setdiff1d(r, d) for r, d in zip(reach, done)])

    histogram = None if visits is None else []
    q = written(queries.select(F.col("qid").cast("long"), "qvec", first_group("qvec").alias("to")), "queries")
    first = written(_best(_visit(q, c, groups, k, block_rows, exclude_self, histogram), k), "hits")
    least = first.groupBy(F.col("qid").alias("lid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    more = written(q.join(least, F.col("qid") == F.col("lid"), "left")
                   .withColumn("to", other_groups("qvec", "to", F.coalesce("least", F.lit(float("-inf")))))
                   .select("qid", "qvec", "to"), "queries")
    hits = first.unionByName(_visit(more, c, groups, k, block_rows, exclude_self, histogram))
    if visits is not None:
        visits["visited"] = sum(n for _, n, _ in histogram)
        visits["all"] = nq * int((tree.rows > 0).sum())
        visits["copies"] = histogram
    return _best(hits, k)


def _sent_whole(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Every query against a corpus of one block, which is sent to the tasks."""
    rows = corpus.select(F.col("case_id").cast("long").alias("case_id"), "vec").toArrow()
    sent = queries.sparkSession.sparkContext.broadcast((rows["case_id"].to_numpy(), _matrix(rows["vec"])))

    def run(batches):
        ids, C = sent.value
        for b in batches:
            if b.num_rows and len(ids):
                yield from _best_of_block(b.column(0).to_numpy(), _matrix(b.column(1)), ids, C, k, exclude_self).to_batches()
    return spread(queries.select(F.col("qid").cast("long").alias("qid"), "qvec")).mapInArrow(run, HITS_SCHEMA)


PACK, TILE, PAIRS = 2048, 1024, 1 << 16            # rows of a pack and a tile, pairs scored at a time
ROWS = 1024                                        # queries that meet a tile at once: 4 MB of scores
CELL_BYTES = 48 << 20                              # of a block, in single precision
HELD = 1 << 20                                     # pairs that a task holds before it cuts them to k
FOLD = 2                                           # components of a row per component of a folded one
FEW = 24                                           # a tile has few pairs to score if at most one in FEW
WAITING = 32                                       # pairs per row that wait to be scored together
CELLS_PER_CORE = 8
NO_ID = -(1 << 63)                                 # a null id


def _packed(df: DataFrame, what: str) -> DataFrame:
    """Written: ``pack, n, body`` of ``(id, vector)`` rows; a body holds the ids, the dimension and
    the rows' non-zero components in order."""
    def run(batches):
        from pyspark import TaskContext
        pack = TaskContext.get().partitionId() << 33
        for b in batches:
            for s in range(0, b.num_rows, PACK):
                ids, X = b.column(0).slice(s, PACK).fill_null(NO_ID).to_numpy(), _matrix(b.column(1).slice(s, PACK))
                row, at = np.nonzero(X)
                body = pickle.dumps((ids, X.shape[1], np.bincount(row, minlength=len(X)).astype(np.int32), at.astype(np.int32), X[row, at]), 5)
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([len(X)], pa.int64()), pa.array([body], pa.binary())],
                                                 names=["pack", "n", "body"])
                pack += 1
    return written(df.mapInArrow(run, "pack long, n long, body binary"), what)


def _dealt(packs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``packs`` with ``block``, about ``rows`` rows in each, and the number of blocks."""
    order = packs.select("pack", "n").orderBy("pack").toArrow()                       # one row per PACK rows
    n = order["n"].to_numpy()
    block = (np.cumsum(n) - n) // max(1, rows)
    at = packs.sparkSession.createDataFrame(pa.table({"pack": order["pack"], "block": pa.array(block, pa.int64())}))
    return packs.join(F.broadcast(at), "pack"), int(block[-1]) + 1 if len(n) else 0


class _Vectors:
    """The rows of some packs: ``ids``, and per row the ``count`` components from ``start``."""

    def __init__(self, bodies: list[bytes]):
        ids, dims, count, at, val = zip(*map(pickle.loads, bodies))
        self.ids, self.count, self.at, self.val = (np.concatenate(x) for x in (ids, count, at, val))
        self.dim = max(dims)
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count

    def norms(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.ids)), self.count)
        return np.sqrt(np.bincount(row, self.val * self.val, len(self.ids)))

    def dense(self, rows: np.ndarray, kind=np.float64, scale=1.0) -> np.ndarray:
        out = np.zeros((len(rows), self.dim), kind)
        count = self.count[rows]
        row = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[rows], count)
        out[row, self.at[at]] = self.val[at] * scale
        return out

    def by_print(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose print no other row has, and the rest, equal ones among them."""
        mix = (self.val.view(np.uint64) ^ self.at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mix = (mix ^ mix >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        filled, prints = np.flatnonzero(self.count), np.zeros(len(self.ids), np.uint64)
        if len(filled):
            prints[filled] = np.add.reduceat(mix, self.start[filled])
        _, group, size = np.unique(prints, return_inverse=True, return_counts=True)
        return np.flatnonzero(size[group] == 1), np.flatnonzero(size[group] > 1)

    def needed(self, k: int) -> np.ndarray:
        """The rows that may be among a query's best ``k``: of equal vectors the ``k`` smallest ids."""
        keep, alike = (x.tolist() for x in self.by_print())
        seen: dict[bytes, tuple[int, int]] = {}
        for i in sorted(alike, key=self.ids.tolist().__getitem__):
            a, b = self.start[i], self.start[i] + self.count[i]
            key = self.at[a:b].tobytes() + self.val[a:b].tobytes()
            n, last = seen.get(key, (0, None))
            new = n + (self.ids[i] != last or last is None)
            if new <= k:
                keep.append(i)
                seen[key] = new, self.ids[i]
        return np.sort(np.array(keep, np.int64))


class _Folded:
    """Corpus rows as the lengths of ``dim // FOLD`` groups of their components: ``rows(Q) @ C.T``
    bounds the scores from above. Groups are of about equal weight, heavy components alone."""

    def __init__(self, C: np.ndarray):
        n, weight = max(1, C.shape[1] // FOLD), np.abs(C).sum(axis=0)
        self.groups = np.zeros((C.shape[1], n), np.float32)
        heap = [(0.0, g) for g in range(n)]
        for j in np.argsort(-weight, kind="stable"):
            total, g = heap[0]
            self.groups[j, g] = 1
            heapq.heapreplace(heap, (total + float(weight[j]), g))
        self.C = np.concatenate([self.rows(C[s:s + TILE]) for s in range(0, len(C), TILE)])
        self.few, self.many = 0, 0                 # tiles, by the pairs whose bound reached the k-th score

    def rows(self, X: np.ndarray) -> np.ndarray:
        return np.sqrt((X * X) @ self.groups)

    def helps(self) -> bool:
        return self.many < 3 + self.few // 4


def _pair_scores(unit: np.ndarray, C: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The scores of pairs in single precision; ``row`` is sorted."""
    out = np.empty(len(row), np.float32)
    ends = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]])) + 1 if len(row) else []
    a = 0
    for b in ends:
        for s in range(a, b, TILE):
            np.dot(C[col[s:min(b, s + TILE)]], unit[row[a]], out=out[s:min(b, s + TILE)])
        a = b
    return out


def _where(flags: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a table with few set flags: 64 at a time."""
    flags = flags.reshape(-1)
    n = len(flags) // 64 * 64
    eights = flags[:n].view(np.uint64) != 0
    some = np.flatnonzero(eights.view(np.uint64))
    at = np.flatnonzero(flags[:n].reshape(-1, 64)[some])
    return np.concatenate([some[at >> 6] * 64 + (at & 63), np.flatnonzero(flags[n:]) + n])


def _ranks(row: np.ndarray) -> np.ndarray:
    """The place of each entry within its row, from 0; ``row`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def _scores(Q: np.ndarray, c: _Vectors, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The inner products of pairs in double precision, summed in the order of the components."""
    out = [np.zeros(0)]
    for s in range(0, len(row), PAIRS):
        r, start, count = row[s:s + PAIRS], c.start[col[s:s + PAIRS]], c.count[col[s:s + PAIRS]]
        total = np.zeros(len(r))
        for j in range(int(count.max(initial=0))):
            some = np.flatnonzero(count > j)
            at = start[some] + j
            total[some] += Q[r[some], c.at[at]] * c.val[at]
        out.append(total)
    return np.concatenate(out)


def _best_in_cell(q: _Vectors, rows: np.ndarray, c: _Vectors, used: np.ndarray, C: np.ndarray, k: int, exclude_self: bool,
                  folded: _Folded | None = None):
    """``(row, corpus row, score)`` of the best ``k`` of a corpus block for some query rows, best
    first; ``C`` holds the corpus rows ``used`` in single precision, none longer than 1."""
    Q, norm = q.dense(rows), q.norms()[rows]
    unit = (Q / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
    slack = np.float32(2 * (q.dim + 16) * 2.0 ** -24)                  # twice the error of a product of such rows
    own, ids = q.ids[rows], c.ids[used]
    short = folded.rows(unit) if folded and folded.helps() else None
    best, bar = np.full((len(rows), k), -np.inf, np.float32), np.full(len(rows), -np.inf, np.float32)
    held: list[tuple[np.ndarray, ...]] = []

    def cut():
        """The held pairs, each row's best ``k`` of them in order."""
        row, col, score = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in range(3))
        near = score >= bar[row] - slack
        row, col, score = row[near], col[near], score[near]
        exact = _scores(Q, c, row, used[col])
        order = np.lexsort((ids[col], -exact, row))
        order = order[_ranks(row[order]) < k]
        return row[order], col[order], score[order], exact[order]

    def take(row, col, score):
        """Hold some pairs; the best ``k`` scores rise with them."""
        nonlocal held, best, bar
        held.append((row, col, score))
        up = score > bar[row]
        r, v = row[up], score[up]
        order = np.lexsort((-v, r))
        r, v = r[order], v[order]
        place = _ranks(r)
        more = np.full((len(rows), k), -np.inf, np.float32)
        more[r[place < k], place[place < k]] = v[place < k]
        best = np.partition(np.hstack([best, more]), k, axis=1)[:, k:]
        bar = best.min(axis=1)
        if sum(len(h[0]) for h in held) > HELD:
            held = [cut()[:3]]

    room, flags = np.empty(len(rows) * TILE, np.float32), np.empty(len(rows) * TILE, bool)

    def product(left, right):
        out = room[:len(left) * len(right)].reshape(len(left), len(right))
        return np.dot(left, right.T, out=out)

    def reaching(scores):
        """The places of scores that reach their row's bar."""
        return _where(np.greater_equal(scores, (bar - slack)[:, None], out=flags[:scores.size].reshape(scores.shape)))

    waiting: list[tuple[np.ndarray, np.ndarray]] = []                  # pairs whose bound reaches the bar
    for s in range(0, len(used), TILE):
        width = min(TILE, len(used) - s)
        whole = not s or short is None
        if not whole:
            at = reaching(product(short, folded.C[s:s + TILE]))
            whole = len(at) * FEW > len(rows) * width
            folded.few, folded.many = folded.few + (not whole), folded.many + whole
            if not whole:
                row, col = np.divmod(at, width)
                waiting.append((row, col + s))
            elif not folded.helps():
                short = None
        if whole:
            S = product(unit, C[s:s + TILE])
            if exclude_self:                       # a row never retrieves itself
                S[own[:, None] == ids[None, s:s + TILE]] = -np.inf
            if s == 0 and width > k:
                bar = np.partition(S, width - k, axis=1)[:, -k:].min(axis=1)
            at = reaching(S)
            row, col = np.divmod(at, width)
            score = S.reshape(-1)[at]
            if not s:
                bar = np.full(len(rows), -np.inf, np.float32)
            real = np.isfinite(score)
            take(row[real], col[real] + s, score[real])
        if waiting and (s + width == len(used) or short is None or sum(len(w[0]) for w in waiting) > WAITING * len(rows)):
            row, col = (np.concatenate([w[i] for w in waiting]) for i in range(2))
            order = np.argsort(row, kind="stable")
            row, col, waiting = row[order], col[order], []
            score = _pair_scores(unit, C, row, col)
            real = score >= (bar - slack)[row]
            if exclude_self:
                real &= own[row] != ids[col]
            take(row[real], col[real], score[real])
    row, col, _, exact = cut()
    return row, used[col], exact


def _cell_topk(k: int, exclude_self: bool):
    def run(key, qs: pa.Table, cs: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and cs.num_rows:
            c = _Vectors(cs["body"].to_pylist())
            used = c.needed(k + exclude_self)
            longest = c.norms().max(initial=0)
            plain = not np.isfinite(longest) or not np.isfinite(c.val).all()
            C = None if plain else c.dense(used, np.float32, 1 / longest if longest > 0 else 1.0)
            folded = None if plain or len(used) <= TILE or c.dim < 16 * FOLD else _Folded(C)
            smallest = used[np.argsort(c.ids[used], kind="stable")[:2 * k + 2]]
            for body in qs["body"]:
                q = _Vectors([body.as_py()])
                if plain or not np.isfinite(q.norms()).all():
                    for s in range(0, len(c.ids), PACK):
                        part = np.arange(s, min(s + PACK, len(c.ids)))
                        t = _best_of_block(q.ids, q.dense(np.arange(len(q.ids))), c.ids[part], c.dense(part), k, exclude_self)
                        out.append(tuple(t[i].to_numpy() for i in range(4)))
                    continue
                zero = np.flatnonzero(q.count == 0)                    # every score is 0: the smallest ids
                row, col = np.repeat(zero, len(smallest)), np.tile(smallest, len(zero))
                if exclude_self:
                    other = q.ids[row] != c.ids[col]
                    row, col = row[other], col[other]
                first = _ranks(row) < k
                found = [(row[first], col[first], np.zeros(int(first.sum())))]
                filled = np.flatnonzero(q.count)
                for s in range(0, len(filled), ROWS):
                    rows = filled[s:s + ROWS]
                    row, col, score = _best_in_cell(q, rows, c, used, C, k, exclude_self, folded)
                    found.append((rows[row], col, score))
                for row, col, score in found:
                    out.append((q.ids[row], (_ranks(row) + 1).astype(np.int32), c.ids[col], score))
        kinds = (np.int64, np.int32, np.int64, np.float64)
        columns = [np.concatenate([np.zeros(0, t), *(o[i] for o in out)]) for i, t in enumerate(kinds)]
        return pa.table([pa.array(x, mask=x == NO_ID if i in (0, 2) else None) for i, x in enumerate(columns)],
                        names=["qid", "rank", "case_id", "score"])
    return run


def _cells_top_k(queries: DataFrame, corpus: DataFrame, k: int, nq: int, nc: int, dim: int, block_rows: int | None,
                 exclude_self: bool) -> DataFrame:
    """Every query block against every corpus block, a cell each."""
    block = max(1, CELL_BYTES // (4 * max(1, dim)))
    c, n_c = _dealt(_packed(corpus.select(F.col("case_id").cast("long"), "vec"), "corpus"), min(block, block_rows or block))
    cells = CELLS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    rows = min(block, max(PACK, -(-nq * max(1, n_c) // cells)), block_rows or block)
    q, n_q = _dealt(_packed(spread(queries.select(F.col("qid").cast("long"), "qvec")), "queries"), rows)
    tasks = max(1, min(20_000, 3 * n_q * n_c))                          # more than cells: few tasks get two
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long")))     # noqa: E731
    qs = q.select(F.col("block").alias("qb"), every(n_c).alias("cb"), "body").repartition(tasks, "qb", "cb")
    cs = c.select(every(n_q).alias("qb"), F.col("block").alias("cb"), "body").repartition(tasks, "qb", "cb")
    hits = qs.groupBy("qb", "cb").cogroup(cs.groupBy("qb", "cb")).applyInArrow(_cell_topk(k, exclude_self), HITS_SCHEMA)
    return _best(hits, k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, block_rows: int = 20000, pivots: int | None = None,
          materialize: bool = True, exclude_self: bool = False, visits: dict | None = None) -> DataFrame:
    """``queries(qid, qvec)`` x ``corpus(case_id, vec)`` -> ``qid, rank, case_id, score``.

    Fewer than ``k`` corpus rows give fewer hits (no padding). The hits (``k`` rows per query)
    are checkpointed into the cluster's checkpoint folder unless ``materialize`` is off: every
    consumer then reads them instead of re-running the search. With ``exclude_self`` a query
    never retrieves the corpus row of the same id (leave-one-out). ``visits`` receives how many
    (query, group) visits were made, how many there are in all, and the copies of each group
    per round: ``(group, visits, copies)``.
    """
    nq, nc, dim = _sizes(queries, corpus)
    if pivots or visits is not None:
        block = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, dim))))
        n = min(MAX_PIVOTS, pivots or 2 * math.ceil(nc / block))
        out = _pruned_top_k(queries, corpus, k, nq, block, n, exclude_self, visits)
    elif nc > block_rows or 8 * nc * dim > BLOCK_BYTES:
        out = _cells_top_k(queries, corpus, k, nq, nc, dim, block_rows if block_rows < 20000 else None, exclude_self)
    else:
        out = _sent_whole(queries, corpus, k, exclude_self)
    if materialize:
        ensure_checkpoint_dir(out.sparkSession)
        out = out.checkpoint()
    return out


def hit_summary(queries: DataFrame, hits: DataFrame, key: str = "qid") -> DataFrame:
    """J8 inputs / F15: per query ``n_hits`` and ``top_score`` (0 hits -> null score)."""
    agg = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("top_score"))
    return (queries.join(agg.withColumnRenamed("qid", key), key, "left")
            .withColumn("n_hits", F.coalesce(F.col("n_hits"), F.lit(0))))


def evidence_line(brand: str) -> Column:
    """``Similarity s | Customer: ... | <brand>: ...`` of a hit row joined to its case."""
    return F.format_string(f"Similarity %s | Customer: %s | {brand.replace('%', '%%')}: %s",
                           fmt_fixed("score", 4), py_strip(F.coalesce("customer_text", F.lit(""))),
                           py_strip(F.coalesce("brand_reply", F.lit(""))))


def evidence_strings(hits: DataFrame, cases: DataFrame, brand: str) -> DataFrame:
    """J9 + C7 + F14: hit rows joined to case text by ``case_id`` (never by position), one
    ``Similarity s | Customer: ... | <brand>: ...`` string per hit, and the ordered
    ``" || "`` join per query (at most k strings per query)."""
    ev = (hits.join(cases.select("case_id", "customer_text", "brand_reply"), "case_id")
          .withColumn("evidence", evidence_line(brand)))
    return (ev.groupBy("qid")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))),
                                          lambda s: s["evidence"]), " || ").alias("evidence"),
                 F.count(F.lit(1)).alias("n_evidence")))


def similarity_from_evidence(x) -> Column:
    """Read the score back from the first evidence string (0.0 when absent)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.regexp_extract(c, r"^Similarity\s+([-0-9.]+)", 1).try_cast("double"), F.lit(0.0))


def score_stats(summary: DataFrame) -> DataFrame:
    """mean / min / max of the top similarity, rounded to 4."""
    return summary.agg(F.round(F.avg("top_score"), 4).alias("mean_top"),
                       F.round(F.min("top_score"), 4).alias("min_top"),
                       F.round(F.max("top_score"), 4).alias("max_top"),
                       F.count(F.lit(1)).alias("n_queries"))
