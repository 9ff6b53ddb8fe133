"""Versioned tables: atomic replace, upserts of touched buckets, refresh of changed rows."""

import os

import pytest
from pyspark.sql import functions as F

from supportflow.sources import snapshots as S


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, x double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_reader_sees_the_old_or_the_new_version(spark, tmp_path):
    path = str(tmp_path / "t")
    old, new = [(i, f"a{i}", 1.0) for i in range(50)], [(i, f"b{i}", 2.0) for i in range(20, 60)]
    assert S.replace(table(spark, old), path, "k", 4) == 1
    reader = S.read(spark, path)                            # opened before the replace
    half = reader.filter("k % 2 = 0")
    assert S.replace(table(spark, new), path, "k", 4) == 2
    assert rows(reader) == sorted(old, key=str) and half.count() == 25      # read after it
    assert rows(S.read(spark, path)) == sorted(new, key=str)
    assert rows(S.read(spark, path, 1)) == sorted(old, key=str)


def test_a_failed_job_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace(table(spark, [(1, "a", 1.0)]), path, "k", 2)
    bad = table(spark, [(2, "b", 2.0)]).withColumn("v", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        S.replace(bad, path, "k", 2)
    assert rows(S.read(spark, path)) == [(1, "a", 1.0)] and S.versions(spark, path) == [1]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace(table(spark, [(1, "a", 1.0)]), path, "k", 2)
    manifest = S._load(spark, path, 1)
    S._commit(spark, path, 2, manifest)
    with pytest.raises(S.Conflict):
        S._commit(spark, path, 2, {**manifest, "data": {}})
    assert rows(S.read(spark, path)) == [(1, "a", 1.0)]
    assert not [f for f in os.listdir(f"{path}/manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    base = [(i, f"a{i}", float(i)) for i in range(200)] + [(None, "none", 0.0)]
    S.replace(table(spark, base), path, "k", 16)
    before = S._load(spark, path, 1)["data"]
    S.upsert(table(spark, [(7, "new", -1.0), (7, "other", -1.0), (900, "added", 9.0)]), path,
             deleted=spark.createDataFrame([(3,), (12345,)], "k long"))
    after = S._load(spark, path, 2)["data"]
    assert sum(before[b] != after[b] for b in before) <= 4 and sum(before[b] == after[b] for b in before) >= 12
    want = {r[0]: r for r in base if r[0] != 3} | {7: (7, "new", -1.0), 900: (900, "added", 9.0)}
    assert rows(S.read(spark, path)) == sorted(want.values(), key=str)
    S.upsert(table(spark, [(None, "changed", 1.0)]), path)
    assert (None, "changed", 1.0) in rows(S.read(spark, path)) and S.read(spark, path).count() == 201
    assert S.upsert(table(spark, []), path) == 4 and S.read(spark, path).count() == 201


def test_an_added_case_does_not_vectorise_the_rest(spark, tmp_path):
    from supportflow.plans.world import update_case_vectors
    path = str(tmp_path / "v")
    cases = [(i, f"case number {i} about a phone") for i in range(40)]
    computed = []

    def frame(c):
        return spark.createDataFrame(c, "case_id long, customer_text string")
    update_case_vectors(frame(cases), path, computed.append)
    first = {r["case_id"]: r["vec"] for r in S.read(spark, path).collect()}
    cases = [c for c in cases if c[0] != 5] + [(99, "one more case")]
    cases[3] = (3, "its text has changed")
    update_case_vectors(frame(cases), path, computed.append)
    now = {r["case_id"]: r["vec"] for r in S.read(spark, path).collect()}
    assert sorted(r["case_id"] for r in computed[1].collect()) == [3, 99] and computed[0].count() == 40
    assert set(now) == {c[0] for c in cases} and now[3] != first[3]
    assert all(now[k] == first[k] for k in now if k not in (3, 99))


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        S.replace(table(spark, [(i, "a", 1.0), (10 + i, "b", 2.0)]), path, "k", 4)
    S.upsert(table(spark, [(77, "c", 3.0)]), path)
    want = rows(S.read(spark, path))
    removed = S.vacuum(spark, path, keep=1)
    assert removed and S.versions(spark, path) == [5] and rows(S.read(spark, path)) == want
    with pytest.raises(FileNotFoundError):
        S.read(spark, path, 1)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        S.read(spark, path)
    S.replace(table(spark, []), path, "k", 4)
    assert S.read(spark, path).columns == ["k", "v", "x"] and S.read(spark, path).count() == 0
    S.upsert(table(spark, [(1, "a", 1.0)]), path)
    assert rows(S.read(spark, path)) == [(1, "a", 1.0)]
