"""Bloom-filter join reduction: exact results, few rows left to shuffle, mergeable filters."""

import pytest
from pyspark.sql import functions as F

from supportflow.operators import reduction as RD


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(77)).when(F.col("id") % 100 == 1, F.lit(None))
                                     .otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("row"))
    keys = spark.range(0, 60_000, 20).select(F.col("id").alias("id")).unionByName(
        spark.createDataFrame([(77,), (77,), (None,), (10**15,)], "id long"))
    return big, keys


@pytest.mark.parametrize("broadcast_rows", [0, 200_000], ids=["filter", "broadcast"])
def test_joins_are_exact(spark, sides, broadcast_rows):
    big, keys = sides
    ids = lambda d: sorted(r["row"] for r in d.collect())     # noqa: E731
    on = big["k"] == keys["id"]
    assert ids(RD.semi_join(big, keys, "k", "id", broadcast_rows)) == ids(big.join(keys, on, "left_semi"))
    assert ids(RD.anti_join(big, keys, "k", "id", broadcast_rows)) == ids(big.join(keys, on, "left_anti"))
    assert RD.semi_join(big, keys, "k", "id", broadcast_rows).columns == big.columns
    none = keys.limit(0)
    assert RD.semi_join(big, none, "k", "id", broadcast_rows).count() == 0
    assert RD.anti_join(big, none, "k", "id", broadcast_rows).count() == 60_000


def test_text_keys(spark):
    big = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "s string")
    keys = spark.createDataFrame([("b",), ("",), ("zz",)], "s string")
    assert sorted(r[0] for r in RD.semi_join(big, keys, "s", "s", 0).collect()) == ["", "b"]
    assert sorted((r[0] for r in RD.anti_join(big, keys, "s", "s", 0).collect()), key=str) == [None, "a"]


def test_few_rows_without_a_partner_are_shuffled(spark, sides):
    big, keys = sides
    distinct = keys.filter("id IS NOT NULL").distinct()
    words = RD.word_count(distinct.count())
    marked = RD.with_maybe(big, F.col("k"), RD.bit_set(distinct, "id", words), words)
    partners = big.join(distinct, big["k"] == distinct["id"], "left_semi").count()
    left = marked.filter("__maybe").count()
    assert partners <= left <= partners + 0.03 * (60_000 - partners)
    plan = RD.semi_join(big, keys, "k", "id", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "__maybe" in plan or "bits" in plan


def test_filters_merge(spark, sides):
    _, keys = sides
    a, b = keys.filter("id % 40 = 0"), keys.filter("id % 40 <> 0")
    rows = lambda d: sorted(map(tuple, d.collect()))     # noqa: E731
    assert rows(RD.merge(RD.bit_set(a, "id", 64), RD.bit_set(b, "id", 64))) == rows(RD.bit_set(keys, "id", 64))


def test_words_follow_the_count():
    assert RD.word_count(0) == 1 and RD.word_count(10**12) == RD.MAX_WORDS
    for n in (10, 1000, 10**6):
        assert 16 * n <= 64 * RD.word_count(n) <= 64 * max(2, n)
