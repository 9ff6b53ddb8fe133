"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

A document's set is its distinct ``SHINGLE``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; fewer words: the whole sequence as one). Documents are linked if
``100 * |A & B| >= 85 * |A | B|``; a component's smallest id names it.

1. One numpy pass writes a signature per document: the set's size and 128-bit digest, the keys of
   ``bands(percent)`` bands of ``ROWS`` MinHash samples, and the odd sketch of all samples, a bitmap of
   ``SKETCH_BITS`` bits in which each sample flips one. Equal sets become one class.
2. Classes that share a band key are candidates. Inside a bucket the XOR population counts of
   the sketches estimate similarities; pairs that may reach the threshold (six standard
   deviations of slack) put their classes into one cluster. A linked pair shares no bucket with
   probability ``(1 - 0.85**4)**32 < 1e-10`` (``bands`` follows the threshold).
3. Only members of clusters have their full sets computed, from whole texts, and every pair of a
   cluster that is not connected yet is compared exactly.
4. Components of the confirmed links, by contraction, in the cluster.

Groups are never collected whole or turned into pairs. A task holds at most ``BLOCK`` members (or
``BLOCK_BYTES`` of them) and returns at most one link per member: the links that join what was
not joined. A larger group is dealt into blocks that all meet the same ``HUBS`` members; what then
still lies outside the group's main component is compared with every block, so no link is lost,
and the cost is linear as long as most members hang together.

Defined results: a null text or one without words has an empty set and is linked with nothing; a
null id ranks last and is never a component's id unless all are null; repeated rows are copies,
of which one is kept; an empty table gives no rows; extra columns pass through ``dedup``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm import textkit as K
from supportflow.llm.common import in_batches, prepare, small_side, stored

SHINGLE, PERCENT = 3, 85
ROWS, SKETCH_BITS, MISS = 4, 512, 1e-10
BLOCK, BLOCK_BYTES, HUBS = 2048, 32 << 20, 64


def bands(percent: int = PERCENT) -> int:
    """So many that a pair at the threshold shares none with a probability of at most ``MISS``
    (32 at 85 %, 44 at 80 %)."""
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-(min(percent, 99) / 100) ** ROWS))))


@lru_cache(maxsize=4)
def _sampling(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return (rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, samples, dtype=np.uint32))


_SECOND = np.uint64(0xA24BAED4963EE407)


# -- sets and signatures (numpy, inside tasks) ------------------------------------------------

def batch_sets(column: pa.Array, size: int):
    """Yields ``(first row, [sorted distinct shingle hashes per row])`` per chunk of a batch."""
    data, offsets = K.text_bytes(column)
    for i, j in K.chunks(offsets):
        w = K.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], K.NON_SPACE, lower=True)
        h = w.hashes()
        gram, _ = K.windows(h, w.row, size)
        sets = []
        for a, n in zip(w.first, w.per_row):
            if n >= size:
                sets.append(np.unique(gram[a:a + n - size + 1]))
            elif n:
                sets.append(K.windows(h[a:a + n], np.zeros(n, np.int64), int(n))[0] ^ np.uint64(n))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, sets


def digests(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that name a set (one row per non-empty set)."""
    return np.column_stack([np.add.reduceat(K.mix(flat), starts), np.add.reduceat(K.mix(flat ^ _SECOND), starts)])


def signatures(flat: np.ndarray, starts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """``(band keys, odd sketches)`` of non-empty sets that lie one after the other."""
    x = (flat >> np.uint64(32)).astype(np.uint32)
    n_bands = bands(percent)
    n = n_bands * ROWS
    factors, flips = _sampling(n)
    samples = np.empty((len(starts), n), np.uint32)
    buffer = np.empty_like(x)
    for k in range(n):
        np.bitwise_xor(x, flips[k], out=buffer)
        np.multiply(buffer, factors[k], out=buffer)
        samples[:, k] = np.minimum.reduceat(buffer, starts)
    tagged = K.mix(samples.astype(np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32)))
    keys = tagged.reshape(len(starts), n_bands, ROWS).copy()
    for r in range(ROWS):
        keys[:, :, r] *= np.uint64(2 * r + 3)
    keys = K.mix(keys.sum(axis=2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64) * K.GRAM)
    bits = (tagged % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((len(starts), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(parity, (np.repeat(np.arange(len(starts)), n), bits.ravel()), 1)
    return keys.view(np.int64), np.packbits(parity, axis=1)


def most_flips(percent: int = PERCENT) -> int:
    """The largest XOR count of two sketches that a pair at the threshold can plausibly have:
    the mean number of differing samples plus six standard deviations, two bits each."""
    p = 1 - percent / 100
    n = bands(percent) * ROWS
    return int(2 * (n * p + 6 * np.sqrt(n * p * (1 - p)) + 1))


class Sketches:
    """Candidates by sketch: few enough flips. ``1 - n/4k ln(1 - 2x/n)`` falls with the XOR
    count ``x``, so the bound on the estimate is a bound on the count."""

    def __init__(self, bodies: list[bytes], percent: int):
        self.bits = np.frombuffer(b"".join(bodies), np.uint64).reshape(len(bodies), -1)
        self.most = most_flips(percent)

    def near(self, y: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] ^ self.bits[y]).sum(axis=1) <= self.most


class Sets:
    """Exact similarity of full sets: shingles get dense numbers, one member's are marked, and
    the marks are summed over each other member."""

    def __init__(self, bodies: list[bytes], percent: int):
        self.size = np.array([len(b) // 8 for b in bodies])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        values, codes = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_inverse=True)
        self.codes, self.mark, self.percent = codes, np.zeros(len(values), np.int8), percent

    def near(self, y: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.size[others], self.size[y]), np.maximum(self.size[others], self.size[y])
        able = np.flatnonzero(100 * small >= self.percent * large)
        out = np.zeros(len(others), bool)
        if not len(able):
            return out
        own = self.codes[self.start[y]:self.start[y + 1]]
        self.mark[own] = 1
        at = others[able]
        if len(at) * 4 < len(self.size):
            both = np.array([self.mark[self.codes[self.start[o]:self.start[o + 1]]].sum(dtype=np.int64) for o in at])
        else:
            both = np.add.reduceat(self.mark[self.codes], self.start[:-1], dtype=np.int64)[at]
        self.mark[own] = 0
        out[able] = 100 * both >= self.percent * (self.size[at] + self.size[y] - both)
        return out


def joining_links(rows: np.ndarray, labels: np.ndarray, probes: np.ndarray, bodies: list[bytes], kind,
                  percent: int) -> list[tuple[int, int]]:
    """Links that join members of different labels; every probing member is compared with all
    members it is not yet joined with. At most one link per join is returned."""
    judge = kind(bodies, percent)
    component = np.unique(labels, return_inverse=True)[1]
    links = []
    for y in np.flatnonzero(probes):
        others = np.flatnonzero(component != component[y])
        if not len(others):
            continue
        hit = others[judge.near(int(y), others)]
        if len(hit):
            found, first = np.unique(component[hit], return_index=True)
            links += [(int(rows[y]), int(rows[o])) for o in hit[first]]
            component[np.isin(component, found)] = component[y]
    return links


# -- groups of members, in Spark --------------------------------------------------------------

def _group_links(members: DataFrame, kind, percent: int) -> DataFrame:
    """``a, b`` from ``g, i, j, row, label, probe, body``: one group of bounded size at a time,
    streamed from rows that are sorted by group."""
    def run(batches):
        open_key, parts = None, []

        def close(parts):
            if sum(len(p[0]) for p in parts) < 2:
                return []
            rows, labels, probes = (np.concatenate([p[k] for p in parts]) for k in range(3))
            return joining_links(rows, labels, probes, [b for p in parts for b in p[3]], kind, percent)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            row, label, probe = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            body = batch.column(6).to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            links = []
            for s, e in zip([0, *cuts], [*cuts, len(key)]):
                if open_key is None or (key[s] != open_key).any():
                    links += close(parts)
                    open_key, parts = key[s], []
                parts.append((row[s:e], label[s:e], probe[s:e], body[s:e]))
            yield _pairs(links)
        yield _pairs(close(parts))

    dealt = members.select("g", "i", "j", "row", "label", "probe", "body")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                       pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def joined_members(members: DataFrame, kind, percent: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
                   hubs: int = HUBS) -> DataFrame:
    """Links ``a, b`` that connect exactly what all near pairs inside the groups of
    ``members(g, row, body)`` connect. ``members`` should be a written table."""
    size = F.octet_length("body")
    groups = stored(members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"))
                    .filter(F.col("m") > 1)
                    .withColumn("nb", F.greatest(F.ceil(F.col("m") / block), F.least(
                        F.ceil(F.col("bytes") / block_bytes), F.col("m"))).cast("long")), "groups")
    all_rows = members.join(groups.select("g", "m", "nb"), "g").withColumn("home", F.pmod(F.xxhash64("row"), "nb"))
    hub = (F.col("nb") > 1) & (F.pmod(F.xxhash64(F.lit(3), "row"), "m") < hubs)
    first = (all_rows.withColumn("j", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("nb") - 1))
                                                 .otherwise(F.array("home"))))
             .select("g", F.lit(0).cast("long").alias("i"), "j", "row", F.col("row").alias("label"),
                     F.lit(True).alias("probe"), "body"))
    links = stored(_group_links(first, kind, percent).distinct(), "links")
    if not groups.filter("nb > 1").head(1):
        return links
    large = all_rows.filter(F.col("nb") > 1)
    label = components(links).select(F.col("v").alias("row"), F.col("c").alias("label"))
    named = stored(large.select("g", "row", "m", "nb", "home").join(label, "row", "left")
                   .withColumn("label", F.coalesce("label", "row")), "named")
    main = (named.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("g").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("n_main")))
    marked = (named.join(main, "g").withColumn("rest", F.col("label") != F.col("main"))
              .withColumn("rb", F.ceil((F.col("m") - F.col("n_main")) * F.col("nb") / F.col("m")).cast("long"))
              .filter(F.col("rb") > 0))
    probes = (marked.filter("rest").withColumn("i", F.pmod(F.xxhash64(F.lit(5), "row"), "rb"))
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("probe", F.lit(True)))
    targets = (marked.withColumn("j", F.col("home")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
               .withColumn("probe", F.lit(False)))
    cols = ["g", "i", "j", "row", "label", "probe"]
    second = (probes.select(*cols).unionByName(targets.select(*cols))
              .join(members.select("g", "row", "body"), ["g", "row"]))
    return links.unionByName(stored(_group_links(second, kind, percent).distinct(), "links"))


def components(links: DataFrame) -> DataFrame:
    """``v, c``: every end of a link with the smallest end of its component.

    Each round every component points at its smallest neighbour, pointers are followed to their
    ends, and links are carried over to the ends; links inside a component vanish. The number of
    components at least halves per round, and a hot component is only ever the small side's key.
    """
    links = stored(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    named = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("c")), "pointers")
        while True:                         # a pointer never rises, so chains end at a fixed point
            on = to.select(F.col("v").alias("w"), F.col("c").alias("d"))
            step = stored(to.join(on, F.col("c") == F.col("w")).select(
                "v", F.col("d").alias("c"), (F.col("c") != F.col("d")).alias("moved")), "pointers")
            to = step.select("v", "c")
            if not step.filter("moved").head(1):
                break
        if named is None:
            named = to
        else:
            on = to.select(F.col("v").alias("w"), F.col("c").alias("d"))
            named = stored(named.join(on, F.col("c") == F.col("w"), "left").select(
                "v", F.coalesce("d", "c").alias("c")), "named")
        ends = lambda x: to.select(F.col("v").alias(f"v{x}"), F.col("c").alias(f"c{x}"))
        links = stored(links.join(ends("a"), F.col("a") == F.col("va")).join(ends("b"), F.col("b") == F.col("vb"))
                       .filter(F.col("ca") != F.col("cb"))
                       .select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "edges")
    return named if named is not None else links.select(F.col("a").alias("v"), F.col("b").alias("c"))


# -- the operator -----------------------------------------------------------------------------

def signature_table(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, shingle: int,
                    percent: int = PERCENT) -> DataFrame:
    """Written: ``id, row, n, d1, d2, keys, sketch`` per document."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("row", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
                           T.StructField("d2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
                           T.StructField("sketch", T.BinaryType())])

    def make():
        def run(batch):
            n_rows = batch.num_rows
            n, d = np.zeros(n_rows, np.int64), np.zeros((n_rows, 2), np.uint64)
            keys: list = [None] * n_rows
            sketch: list = [None] * n_rows
            for i, sets in batch_sets(batch.column(2), shingle):
                n[i:i + len(sets)] = [len(s) for s in sets]
                full = i + np.flatnonzero(n[i:i + len(sets)])
                if not len(full):
                    continue
                flat = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                d[full] = digests(flat, starts)
                k, s = signatures(flat, starts, percent)
                for at, x, y in zip(full, k, s):
                    keys[at], sketch[at] = x, y.tobytes()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(d[:, 0].view(np.int64)),
                 pa.array(d[:, 1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=[f.name for f in schema.fields])
        return run
    return stored(in_batches(rows, make, schema), "signatures")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Written: ``g, row, body`` of the classes ``wanted(g, row, rep_id, d1, d2)``: the set of a
    document with the class's id and digest."""
    ids = small_side(wanted.select("rep_id").distinct())
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["rep_id"]), "left_semi").select(F.col(text_col).alias("t"))

    def make():
        def run(batch):
            bodies, d = [], []
            for _, sets in batch_sets(batch.column(0), shingle):
                sets = [s for s in sets if len(s)]
                if sets:
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                    d.append(digests(np.concatenate(sets), starts).view(np.int64))
                    bodies += [s.tobytes() for s in sets]
            d = np.concatenate(d) if d else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(bodies, pa.binary())],
                                              names=["e1", "e2", "body"])
        return run
    sets = in_batches(texts, make, "e1 long, e2 long, body binary")
    keys = small_side(wanted.select("g", "row", "d1", "d2"))
    return stored(sets.join(keys, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")))
                  .groupBy("g", "row").agg(F.first("body").alias("body")), "sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                    shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """Per row: ``id, row, n_shingles, component_id, kept`` (one row of each component is kept,
    the one with the smallest id). ``row`` is ``row_col``, or a number given on reading."""
    prepare(docs.sparkSession)
    signed = signature_table(docs, id_col, text_col, row_col, shingle, percent)
    best = F.struct(F.col("id").isNull().alias("nulls"), "id", "row")
    classes = stored(signed.filter(F.col("n") > 0).groupBy("d1", "d2").agg(
        F.min(best).alias("best"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    bands = classes.select(F.col("best.row").alias("row"), F.explode("keys").alias("g"))
    # written, so that the join below reads two plain shuffles, which AQE can split at a hot bucket
    shared = stored(bands.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("g"), "shared")
    sketches = classes.select(F.col("best.row").alias("row"), F.col("sketch").alias("body"))
    members = stored(bands.join(shared, "g").join(sketches, "row"), "buckets")
    cluster = stored(components(joined_members(members, Sketches, percent, block, hubs=hubs)), "clusters")
    info = classes.select(F.col("best.row").alias("v"), F.col("best.id").alias("rep_id"), "d1", "d2")
    wanted = stored(cluster.join(info, "v").select(F.col("c").alias("g"), F.col("v").alias("row"), "rep_id", "d1", "d2"),
                    "wanted")
    links = joined_members(full_sets(docs, wanted, id_col, text_col, shingle), Sets, percent, block, hubs=hubs)
    linked = components(links)
    of_class = (classes.select("d1", "d2", "best").join(linked, F.col("best.row") == F.col("v"), "left")
                .withColumn("c", F.coalesce("c", "best.row")))
    smallest = of_class.groupBy("c").agg(F.min("best").alias("least"))
    named = of_class.join(smallest, "c").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "least")
    out = signed.select("id", "row", "n", "d1", "d2").join(
        named, (F.col("n") > 0) & (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    alone = F.col("least").isNull()
    return out.select("id", "row", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
                      (alone | (F.col("row") == F.col("least.row"))).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document of each component. The rows are written once with a
    number, so that exactly one row stays even where ids repeat or are null."""
    prepare(docs.sparkSession)
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = stored(near_duplicates(numbered, id_col, text_col, "__row", **options).filter(~F.col("kept"))
                  .select(F.col("row").alias("__gone")), "gone")
    return (numbered.join(small_side(gone), F.col("__row") == F.col("__gone"), "left_anti").select(*docs.columns))
