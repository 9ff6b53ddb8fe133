"""Document fingerprints as threshold-scaled sketches: of all shingle hashes of a text, those
below a fixed fraction of the hash space are retained.

A shingle is five consecutive words (runs of non-space, lower-cased), a shorter text is one
shingle; its hash is the first 64 bits of its MD5 in hexadecimal. Whether a hash is retained
depends on the hash alone, so a sketch grows with its text, the sketch of a union is the union of
the sketches (``merged``), and the share of one sketch found in another estimates the share of
one text contained in another, however unequal their lengths (``containment``). ``likeness`` is
the larger of the two containments. A text with words whose every hash is above the threshold
keeps its smallest one, so that no such text has an empty fingerprint.

``edited_neighbours`` needs the following document in a global order. Documents are dealt into
blocks, contiguous in that order, with one exchange of the texts; a window finds the next
document inside its block, and the first row of each block is also sent to the block before it.
The cuts between blocks come from a narrow table of keys and hashes: one key per range partition
reaches the driver. A key that fills several ranges is cut further by the hash of the text.

Native column expressions throughout; higher-order functions bind the split words once per row
(``_let``), because the optimizer would copy a projected expression into the lambda.

Defined results: a null text is the empty text, its sketch is empty; two equal sketches have
likeness 1, an empty and another one 0. Order: id descending, a null id after all others; equal
ids by the text's hash, then the text; equal rows follow each other. After the last document
comes the first; a single one follows itself. An empty table has no rows. Extra columns pass
through; a caller's column named like a result raises unless ``prefix`` sets it apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.llm.common import prepare, stored

SHINGLE = 5
FRACTION = 1 / 8
#: Blocks per shuffle partition: several, so that partitions come out even.
CUTS = 6
SPACE = r"[\x20\x09-\x0D]+"
LOWEST = -(1 << 63)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, also where ``f`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """The hash of every shingle, in order."""
    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (shingle - 1)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(
            at, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, shingle), " ").cast("binary")), 1, 16)))
    return _let(words(text), hashed)


def fingerprint(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The retained hashes, distinct and sorted: ``array<string>``."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    below = f"{min(int(fraction * 2 ** 64), 2 ** 64 - 1):016x}"
    keep = (lambda h: h <= below) if fraction == 1 else (lambda h: h < below)

    def sketch(hashes: Column) -> Column:
        kept = F.filter(hashes, keep)
        return F.when(F.size(hashes) == 0, hashes).otherwise(_let(kept, lambda k: F.when(
            F.size(k) == 0, F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(k)))))
    return _let(shingle_hashes(text, shingle), sketch)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s text found in ``b``'s, from the sketches (0 for an empty ``a``)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """The larger containment: shared hashes over the smaller sketch's."""
    least = F.least(F.size(a), F.size(b))
    return (F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / least).cast("double"))


def merged(rows: DataFrame, key: str, sketch: str) -> DataFrame:
    """``key, hash``: the sketch of each group's union, one row per distinct hash, combined before
    the shuffle and never gathered into one task. (A kept smallest hash of a text without any
    below the threshold is a member like the others.)"""
    return rows.select(F.col(key).alias("key"), F.explode(sketch).alias("hash")).distinct()


# -- the next document in a global order ---------------------------------------------------------

def _cuts(keys: DataFrame) -> list[int]:
    """The key at the head of each range of the order but the first: at most ``CUTS`` values per
    shuffle partition."""
    n = CUTS * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, F.desc("k"), F.asc("h"))
    heads = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect()
    return sorted((r["k"] for r in heads), reverse=True)[1:]


def _block(k: Column, h: Column, cuts: list[int]) -> Column:
    """The block of a key: how many cuts lie above it, and for a key that is itself a cut, ``m``
    times over, one of ``m + 1`` further blocks by the text's hash. Two steps over rows of about
    ``sqrt(cuts)`` values instead of one over all."""
    if not cuts:
        return F.lit(0).cast("long")
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])     # noqa: E731
    last = array([r[-1] for r in rows])

    def count(test: Callable[[Column, Column], Column]) -> Column:
        whole = F.size(F.filter(last, lambda c: test(c, k)))
        rest = F.size(F.filter(F.coalesce(F.get(F.array(*map(array, rows)), whole), F.array().cast("array<long>")),
                               lambda c: test(c, k)))
        return whole * step + F.when(whole < len(rows), rest).otherwise(0)
    above = count(lambda c, key: c > key)
    same = count(lambda c, key: c >= key) - above
    share = h.cast("double") / F.lit(2.0 ** 64) + 0.5
    return (above + F.least(F.floor(share * (same + 1)), same)).cast("long")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      fraction: float = FRACTION, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_chars, edited`` (the last ``floor(n_chars / 2)`` code points replaced by
    the next document's first), ``fingerprint, edited_fingerprint`` (arrays), ``near_edited`` and
    ``near_next``."""
    results = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if clash := {prefix + r for r in results} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; set prefix")
    prepare(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = stored(docs.select(key.alias("k"), F.xxhash64(text).alias("h")), "keys")
    cuts = _cuts(keys)
    block = _block(F.col("k"), F.col("h"), cuts)
    heads = keys.groupBy(block.alias("b")).agg(
        F.min_by(F.struct("k", "h"), F.struct(-F.col("k").cast("decimal(20,0)"), "h")).alias("m"))
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.coalesce(F.lag("b").over(Window.orderBy("b")), F.last("b").over(every))
    before = heads.select(F.col("b").alias("__hb"), F.col("m.k").alias("__hk"), F.col("m.h").alias("__hh"),
                          back.alias("__to"))             # one row per block: at most one more than twice the cuts

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("t"),
                       key.alias("k"), F.xxhash64(text).alias("h")).withColumn("b", block)
    first = (F.col("b") == F.col("__hb")) & (F.col("k") == F.col("__hk")) & (F.col("h") == F.col("__hh"))
    places = F.array(F.struct(F.col("b"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("__to").alias("b"), F.lit(True).alias("guest")))
    dealt = (rows.join(F.broadcast(before), first, "left")
             .withColumn("place", F.explode(F.when(F.col("__to").isNull(), places).otherwise(F.concat(places, guest))))
             .select(F.when(~F.col("place.guest"), F.col("row")).alias("row"), "id", "t", "k", "h", "place.b", "place.guest"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = dealt.repartition(n, "b").withColumn("fp", fingerprint(F.col("t"), shingle, fraction))
    order = Window.partitionBy("b").orderBy("guest", F.desc("k"), F.asc("h"), F.desc_nulls_last("id"), F.asc("t"))
    following = (sketched.withColumn("next", F.lead(F.struct("t", "fp")).over(order)).filter(~F.col("guest"))
                 .withColumn("n", F.char_length("t").cast("long")))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.left(F.col("t"), F.col("n").cast("int") - half), F.left(F.col("next.t"), half))
    out = (following.withColumn("e", edited).withColumn("efp", fingerprint(F.col("e"), shingle, fraction)))
    made = {"n_chars": F.col("n"), "edited": F.col("e"), "fingerprint": F.col("fp"), "edited_fingerprint": F.col("efp"),
            "near_edited": likeness(F.col("fp"), F.col("efp")), "near_next": likeness(F.col("fp"), F.col("next.fp"))}
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[v.alias(prefix + k) for k, v in made.items()])
