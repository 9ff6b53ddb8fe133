"""Hard negatives by coordinate pruning of inner products over length buckets.

Vectors are integers; a row's score is its inner product with the anchor, exact. For every anchor
and each of its best same-label rows (its positives), the best different-label rows whose score
lies in a window below the positive's are returned.

* Rows are dealt into buckets of similar length (``STEPS`` per doubling) and these into parts of
  at most ``BLOCK_BYTES``. A part holds its rows' directions as one sorted list per coordinate.
* An anchor needs rows that score at least ``least``. In a bucket whose rows have length at most
  ``l`` that means a cosine of at least ``least / (|anchor| * l)``, an angle of at most ``g``. A
  row within that angle has, in every coordinate, a value within ``g`` of the anchor's own, as
  angles: a feasible range. On the anchor's ``FOCUS`` largest coordinates the ranges are slices
  of the sorted lists; only rows in all of them are verified, by exact inner products.
* Each search has two rounds. An anchor first visits one part of its most promising bucket and so
  learns a score that better rows must reach; then it visits the parts whose length bound
  reaches that score. Positives are sought in the lists of the anchor's own label, negatives in
  lists over all rows, each with its own windows' least score.

A task holds one part and at most about ``ANCHORS`` visiting anchors: a part is copied once per
that many visits of its own, counted first, so a hot label or a very common vector only means
more parts. Hits are at most ``k`` per anchor, window and visited part. Nothing is collected.

Defined results (``mine``): rows with a null label, a null vector or a null component take no
part; vectors shorter than the longest one are padded with zeros; a row is its own row whatever
its id, so repeated rows are each other's positives, and repeated anchors each have their rows;
a null id ranks last among ties; scores beyond 64 bits raise; an anchor without positives, or a
positive with a negative score or without rows in its window, has no rows; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.llm.common import prepare, small_side, stored

FOCUS, STEPS = 4, 8
BLOCK_BYTES, ANCHORS, CHUNK = 4 << 20, 1024, 64
SLACK = 1e-6


def quantised(vec: str) -> Column:
    """``floor(256 * x)`` of every component; null if the vector is null or a component is null or
    not finite."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


# -- inside a task -------------------------------------------------------------------------------

class CoordinateLists:
    """One part of a length bucket: exact vectors, and their directions as sorted lists."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        self.longest, self.shortest = (length.max(), length.min()) if len(length) else (0.0, 0.0)
        self.order = np.argsort(unit, axis=0, kind="stable").T.copy()            # a list per coordinate
        self.value = np.take_along_axis(unit.T, self.order, axis=1)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(unit))[None, :], axis=1)

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray:
        """Rows in the feasible ranges of all focus coordinates; every row that scores at least
        ``least`` is among them."""
        everything = np.arange(len(self.vectors))
        bound = length * (self.longest if least > 0 else self.shortest)
        if bound == 0:                                     # scores of zero, or no bound at all
            return everything if least <= 0 else everything[:0]
        cosine = least / bound
        if cosine > 1 + SLACK:
            return everything[:0]
        if cosine <= -1:
            return everything
        angle = np.arccos(min(cosine, 1.0)) + SLACK
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
        high = np.cos(np.maximum(0, own - angle)) + SLACK
        ranges = sorted(((np.searchsorted(self.value[f], lo, "left"), np.searchsorted(self.value[f], hi, "right"), f)
                         for f, lo, hi in zip(focus, low, high)), key=lambda r: r[1] - r[0])
        first, last, f = ranges[0]
        rows = self.order[f, first:last]
        for first, last, f in ranges[1:]:                  # intersect: places within the other lists' slices
            if last - first < len(everything):
                at = self.place[f, rows]
                rows = rows[(at >= first) & (at < last)]
        return rows

    def scores(self, anchors: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The exact inner products of each anchor with its candidate rows."""
        used = np.zeros(len(self.vectors), bool)
        for r in rows:
            used[r] = True
        at = np.cumsum(used) - 1
        some = self.vectors if used.all() else self.vectors[used]
        most = self.longest * float(np.sqrt((anchors.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
        if most < 2 ** 53:
            products = (some.astype(float) @ anchors.astype(float).T).astype(np.int64)
        elif most < 2 ** 63:
            products = some @ anchors.T
        else:
            raise ArithmeticError("a score does not fit into 64 bits")
        return [products[at[r], i] for i, r in enumerate(rows)]


def _best(score: np.ndarray, missing: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: score descending, id ascending (null last), then row."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((row[at], ident[at], missing[at], -score[at]))][:k]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dim)


HITS = "a long, w int, id long, row long, score long"


def _search(k: int, dim: int, same_label: bool):
    """Visits of one part: ``anchors(a, label_hash, vec, low, high, least)`` against rows
    ``(row, id, label_hash, vec)``. Window ``w`` of an anchor takes scores from ``low[w]`` to
    ``high[w]``, of which only those of at least ``least[w]`` are of use (null: no bound)."""
    def run(anchors: pa.Table, part: pa.Table) -> pa.Table:
        out = {"a": [], "w": [], "at": [], "score": []}
        lists = CoordinateLists(_matrix(part["vec"], dim))
        ident = part["id"].fill_null(0).to_numpy()
        missing = part["id"].is_null().to_numpy().astype(np.int8)
        row, label = part["row"].to_numpy(), part["label"].to_numpy()
        vectors = _matrix(anchors["vec"], dim)
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        key, own = anchors["a"].to_numpy(), anchors["label"].to_numpy()
        windows = [anchors[c].to_pylist() for c in ("low", "high", "least")]
        for s in range(0, len(vectors), CHUNK):
            block = range(s, min(s + CHUNK, len(vectors)))
            found = [lists.candidates(vectors[i], length[i], float(min(windows[2][i]))) for i in block]
            for i, rows, score in zip(block, found, lists.scores(vectors[s:s + CHUNK], found)):
                fits = (label[rows] == own[i]) if same_label else (label[rows] != own[i])
                fits &= (row[rows] != key[i]) & (score >= min(windows[2][i]))
                rows, score = rows[fits], score[fits]
                for w, (low, high, least) in enumerate(zip(*(x[i] for x in windows))):
                    inside = np.flatnonzero((score >= max(low, least)) & (score <= high))
                    best = inside[_best(score[inside], missing[rows[inside]], ident[rows[inside]], row[rows[inside]], k)]
                    out["a"].append(np.full(len(best), key[i]))
                    out["w"].append(np.full(len(best), w, np.int32))
                    out["at"].append(rows[best])
                    out["score"].append(score[best])
        joined = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        at = joined["at"].astype(np.int64)
        return pa.table({"a": pa.array(joined["a"], pa.int64()), "w": pa.array(joined["w"], pa.int32()),
                         "id": part["id"].combine_chunks().take(pa.array(at)), "row": pa.array(row[at], pa.int64()),
                         "score": pa.array(joined["score"], pa.int64())})

    def visited(key, anchors: pa.Table, part: pa.Table) -> pa.Table:
        if not anchors.num_rows or not part.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("a", "w", "id", "row", "score"),
                                                                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})
        return run(anchors, part)
    return visited


# -- the two rounds ------------------------------------------------------------------------------

def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visit(visits: DataFrame, rows: DataFrame, search) -> DataFrame:
    """Each visited part meets its visitors, copied once per ``ANCHORS`` visits of its own."""
    keys = ["list", "bucket", "part"]
    counts = small_side(stored(visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "visits")
                        .select(*[F.col(c).alias(f"v_{c}") for c in keys], F.ceil(F.col("n") / ANCHORS).alias("copies")))
    on = [F.col(c) == F.col(f"v_{c}") for c in keys]
    left = visits.join(counts, on).withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")))
    right = rows.join(counts, on).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    named = lambda *names: [F.col(c).alias(c) for c in names]     # noqa: E731  both sides come from one table
    left = left.select(*named(*keys, "copy", "a", "label", "vec", "low", "high", "least"))
    right = right.select(*named(*keys, "copy", "row", "id", "label", "vec"))
    return left.groupBy(*keys, "copy").cogroup(right.groupBy(*keys, "copy")).applyInArrow(search, HITS)


def _two_rounds(anchors: DataFrame, rows: DataFrame, block: int, k: int, search) -> DataFrame:
    """The best ``k`` per anchor and window. ``anchors(a, list, label, vec, norm, low, high)``;
    ``rows(list, bucket, row, id, label, vec, norm)``: an anchor searches the rows of its list."""
    sizes = rows.groupBy("list", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    promise = Window.partitionBy("list").orderBy(F.desc(F.col("n") * F.col("longest")), "bucket")
    groups = stored(sizes.withColumn("parts", F.ceil(F.col("n") / block))
                    .withColumn("first", F.row_number().over(promise) == 1), "groups")
    parts = groups.select(F.col("list").alias("g_list"), F.col("bucket").alias("g_bucket"), "parts")
    placed = (rows.join(small_side(parts), (F.col("list") == F.col("g_list")) & (F.col("bucket") == F.col("g_bucket")))
              .withColumn("part", F.pmod(F.col("row"), F.col("parts"))))
    group = small_side(groups.select(F.col("list").alias("g_list"), "bucket", "parts", "first", "longest"))
    start = anchors.join(group.filter("first"), F.col("list") == F.col("g_list"))
    first = stored(_top(_visit(start.withColumn("part", F.pmod(F.col("a"), F.col("parts")))
                               .withColumn("least", F.col("low")), placed, search), k), "first")
    reached = (first.groupBy("a", "w").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("s"))
               .groupBy(F.col("a").alias("r_a")).agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("s")))
    least = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at(F.col("s"), w), low)))
    later = (anchors.join(reached, F.col("a") == F.col("r_a"), "left").withColumn("least", least)
             .join(group, F.col("list") == F.col("g_list"))
             .filter(F.col("norm") * F.col("longest") * (1 + SLACK) + SLACK >= F.array_min("least"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .filter(~F.col("first") | (F.col("part") != F.pmod(F.col("a"), F.col("parts")))))
    return _top(first.drop("rank").unionByName(_visit(later, placed, search)), k)


LOWEST, HIGHEST = -(1 << 62), 1 << 62


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "id", label_col: str = "label", vec_col: str = "vec", anchor_col: str = "anchor") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each
    anchor row and each of its best ``positives`` other rows of its label, the best ``negatives``
    rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``. Vectors are arrays of long."""
    prepare(rows.sparkSession)
    vec = F.col(vec_col)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(-1).cast("int")
    kept = rows.filter(F.col(label_col).isNotNull() & vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    named = kept.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col)).alias("label"),
                        vec.cast("array<long>").alias("vec"),
                        F.coalesce(F.col(anchor_col), F.lit(False)).alias("anchor"))
    dim = named.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = named.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), dim - F.size("vec"))))
    table = stored(padded.withColumn("norm", norm).withColumn("bucket", bucket)
                   .withColumn("row", F.monotonically_increasing_id()), "vectors")    # written: numbers stay
    block = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    bounds = (F.array(F.lit(LOWEST).cast("long")).alias("low"), F.array(F.lit(HIGHEST).cast("long")).alias("high"))
    anchors = table.filter("anchor").select(F.col("row").alias("a"), F.col("id").alias("anchor_id"), "label", "vec", "norm")

    near = stored(_two_rounds(anchors.select("a", F.col("label").alias("list"), "label", "vec", "norm", *bounds),
                              table.withColumn("list", F.col("label")), block, positives, _search(positives, dim, True)),
                  "positives")
    score = F.col("score")
    near = near.filter(score >= 0).select("a", "rank", F.col("id").alias("positive_id"), score.alias("positive_score"))
    pairs = near.select("*", F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
                        F.expr(f"({high} * positive_score) div 100").alias("high"))
    windows = pairs.groupBy(F.col("a").alias("p_a")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("p"))
    seekers = (anchors.join(windows, F.col("a") == F.col("p_a"))          # at most `positives` windows per anchor
               .select("a", F.lit(0).cast("long").alias("list"), "label", "vec", "norm",
                       F.transform("p", lambda x: x["low"]).alias("low"), F.transform("p", lambda x: x["high"]).alias("high")))
    far = _two_rounds(seekers, table.withColumn("list", F.lit(0).cast("long")), block, negatives,
                      _search(negatives, dim, False))
    hits = far.select(F.col("a").alias("h_a"), F.col("w").alias("h_w"), F.col("rank").cast("int").alias("h_rank"),
                      F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("a").alias("n_a"), "anchor_id")
    return (hits.join(pairs.select("a", F.col("rank").alias("p_rank"), "positive_id", "positive_score"),
                      (F.col("h_a") == F.col("a")) & (F.col("h_w") + 1 == F.col("p_rank")))
            .join(names, F.col("a") == F.col("n_a"))
            .select("anchor_id", "positive_id", F.col("h_rank").alias("rank"), "negative_id", "positive_score", "negative_score"))
