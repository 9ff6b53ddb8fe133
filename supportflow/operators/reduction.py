"""Bloom-filter reduction of the hold-out and linking joins.

A semi or anti join against a key set too large to broadcast shuffles every row of the big side,
although most rows have no partner (or, for an anti join, need none). Before the shuffle they are
tested against a bit set of the keys:

* the keys are counted; up to ``broadcast_rows`` of them are broadcast, which needs no filter;
* otherwise each key sets four bits of one 64-bit word, both chosen by its hash. The words are
  OR-ed by an aggregation that combines before its shuffle, so the keys are never gathered. There
  are ``BITS_PER_KEY`` bits per counted key, rounded up to a power of two, at most ``MAX_WORDS``
  words: that table (16 bytes a row) is what is broadcast;
* the big side is joined to the words. Rows whose bits are not all set have no partner: a semi
  join drops them, an anti join keeps them, neither shuffles them. The others go through the
  exact join, so a false positive costs a shuffled row and never changes the result.

Beyond ``MAX_WORDS * 64 / BITS_PER_KEY`` keys the filter lets more rows through, up to all. All
steps are column expressions. Null keys match nothing; a hot key is one entry of the key set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportflow.session import BROADCAST_ROWS, written

BITS_PER_KEY, MAX_WORDS = 16, 1 << 20


def _hash(key: Column) -> Column:
    return F.xxhash64(F.lit(11), key)


def _word(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(words - 1)).cast("int")


def _mask(h: Column) -> Column:
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(4):
        at = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    return mask


def word_count(keys: int) -> int:
    return min(MAX_WORDS, max(1, 1 << (max(1, keys) * BITS_PER_KEY // 64).bit_length()))


def bit_set(keys: DataFrame, key: str, words: int) -> DataFrame:
    """``word, bits``: the mergeable filter of a key column."""
    h = _hash(F.col(key))
    return (keys.filter(F.col(key).isNotNull()).groupBy(_word(h, words).alias("word"))
            .agg(F.bit_or(_mask(h)).alias("bits")))


def merge(*sets: DataFrame) -> DataFrame:
    """The filter of the union of the key sets (of equal ``words``)."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_maybe(big: DataFrame, key: Column, filter_: DataFrame, words: int, flag: str = "__maybe") -> DataFrame:
    """``big`` with ``flag``: false where ``key`` is certainly not among the filter's keys."""
    side = F.broadcast(filter_.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    h = _hash(key)
    out = big.join(side, _word(h, words) == F.col("__word"), "left")
    hit = key.isNotNull() & F.col("__bits").isNotNull() & (F.col("__bits").bitwiseAND(_mask(h)) == _mask(h))
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__word", "__bits")


def _prepared(keys: DataFrame, key: str, broadcast_rows: int) -> tuple[DataFrame, int]:
    """The distinct keys, written once, and how many there are."""
    distinct = written(keys.select(F.col(key).alias("__key")).filter(F.col("__key").isNotNull()).distinct(), "keys")
    return distinct, distinct.count()


def semi_join(big: DataFrame, keys: DataFrame, big_key: str, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``big`` whose ``big_key`` is among ``keys``."""
    distinct, n = _prepared(keys, key, broadcast_rows)
    on = big[big_key] == F.col("__key")
    if n <= broadcast_rows:
        return big.join(F.broadcast(distinct), on, "left_semi")
    words = word_count(n)
    maybe = with_maybe(big, F.col(big_key), bit_set(distinct, "__key", words), words).filter("__maybe")
    return maybe.join(distinct, F.col(big_key) == F.col("__key"), "left_semi").select(*big.columns)


def anti_join(big: DataFrame, keys: DataFrame, big_key: str, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``big`` whose ``big_key`` is null or not among ``keys``."""
    distinct, n = _prepared(keys, key, broadcast_rows)
    if n <= broadcast_rows:
        return big.join(F.broadcast(distinct), big[big_key] == F.col("__key"), "left_anti")
    words = word_count(n)
    marked = with_maybe(big, F.col(big_key), bit_set(distinct, "__key", words), words)
    maybe = marked.filter("__maybe").join(distinct, F.col(big_key) == F.col("__key"), "left_anti")
    return marked.filter("NOT __maybe").unionByName(maybe).select(*big.columns)
