"""Tables as immutable versions behind one pointer.

A table is a folder of data folders, never changed once written, and of numbered manifests. A
manifest names, per bucket of the key, the data folders that make up the table; the highest
number is the table. A commit writes its data first and then creates the next manifest under a
name that must not exist yet, which is one atomic step of the file system: a reader sees the old
version or the new one, also in the middle of a replace, and of two writers that start from one
version the second fails instead of overwriting the first. A failed job leaves data that no
manifest names; ``vacuum`` removes it.

``upsert`` rewrites only the buckets that the changed keys fall into, ``refresh`` computes only
rows that are new or whose fingerprint changed. Rows are compared by key; data stays in the tasks,
the driver reads manifests (one line per bucket and folder).

Defined results: a null key is a key like others; of changes with equal keys one is kept (the
smallest row); deleting is ``upsert`` with ``deleted`` keys; an empty table has an empty version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _load(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifests/{version:012d}.json").collect()))


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> int:
    """Makes ``version`` the table, or raises ``Conflict`` if it exists. The manifest is complete
    before it gets its name, and the name is given only once."""
    fs, at = _fs(spark, path)
    draft, final = at(f"{path}/manifests/.{uuid.uuid4().hex}"), at(f"{path}/manifests/{version:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    try:
        files = jvm.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))   # fails if the name is taken
    except Exception as e:
        fs.delete(draft, False)
        if versions(spark, path)[-1:] >= [version]:
            raise Conflict(f"version {version} of {path} exists") from e
        raise
    return version


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, list[str]]:
    """Data folders per bucket of ``rows``."""
    spark, name = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    dealt = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (dealt.repartition(buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{name}"))
    fs, at = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(at(f"{path}/{name}"))]
    return {f.split("=")[1]: [f"{name}/{f}"] for f in found if f.startswith(f"{_BUCKET}=")}


def replace(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, properties: dict | None = None) -> int:
    """A new version that is ``rows`` alone, with ``properties`` that belong to it."""
    spark = rows.sparkSession
    version = (versions(spark, path) or [0])[-1] + 1
    return _commit(spark, path, version, {"key": key, "buckets": buckets, "schema": rows.schema.json(),
                                          "properties": properties or {}, "data": _write(rows, path, key, buckets)})


def properties(spark: SparkSession, path: str, version: int | None = None) -> dict:
    return _load(spark, path, version or versions(spark, path)[-1]).get("properties", {})


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{path}/{f}" for b, names in manifest["data"].items() if buckets is None or b in buckets for f in names]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it was committed last, or as ``version``. What is read doesn't change when
    another version is committed."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {version or ''} of {path}")
    return _rows(spark, path, _load(spark, path, version or known[-1]))


def upsert(changes: DataFrame, path: str, deleted: DataFrame | None = None) -> int:
    """A new version in which ``changes`` replace or join the rows of equal keys and rows with a
    key of ``deleted`` are gone. Buckets without a changed key keep their data folders."""
    spark = changes.sparkSession
    base = versions(spark, path)[-1]
    manifest = _load(spark, path, base)
    key, buckets = manifest["key"], manifest["buckets"]
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    rest = [f.name for f in schema.fields if f.name != key]
    fresh = (changes.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r"))
             .select(key, *[F.col("__r")[c].alias(c) for c in rest]).select(*schema.fieldNames()))
    keys = fresh.select(key) if deleted is None else fresh.select(key).unionByName(deleted.select(key)).distinct()
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string").alias("b")
    touched = sorted(r["b"] for r in keys.select(bucket).distinct().collect())              # at most `buckets`
    old = _rows(spark, path, manifest, touched)
    gone = keys.select(F.col(key).alias("__gone"))
    kept = old.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
    written = _write(kept.unionByName(fresh), path, key, buckets) if touched else {}
    data = {b: names for b, names in manifest["data"].items() if b not in touched} | written
    return _commit(spark, path, base + 1, {**manifest, "data": data})


def refresh(source: DataFrame, path: str, key: str, print_col: str, compute: Callable[[DataFrame], DataFrame],
            buckets: int = BUCKETS) -> int:
    """Brings a derived table up to ``source``: ``compute`` sees only rows whose key is new or whose
    ``print_col`` differs from the stored one (its result keeps both columns); rows whose key is
    not in ``source`` any more go. The first time everything is computed."""
    spark = source.sparkSession
    if not versions(spark, path):
        return replace(compute(source), path, key, buckets)
    known = read(spark, path).select(F.col(key).alias("__k"), F.col(print_col).alias("__p"))
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col(print_col).eqNullSafe(F.col("__p"))
    changed = source.join(known, same, "left_anti")
    gone = known.join(source.select(key), F.col(key).eqNullSafe(F.col("__k")), "left_anti").select(F.col("__k").alias(key))
    return upsert(compute(changed), path, gone)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all versions but the last ``keep`` and the data that no remaining one names; returns
    the removed data folders. Not to be run beside a writer."""
    fs, at = _fs(spark, path)
    known = versions(spark, path)
    for v in known[:-keep]:
        fs.delete(at(f"{path}/manifests/{v:012d}.json"), False)
    used = {f for v in known[-keep:] for names in _load(spark, path, v)["data"].values() for f in names}
    removed = []
    for top in fs.listStatus(at(path)):
        name = top.getPath().getName()
        if name.startswith("data-"):
            parts = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(top.getPath())]
            unused = [p for p in parts if f"{_BUCKET}=" in p and p not in used]
            for p in unused:
                fs.delete(at(f"{path}/{p}"), True)
            removed += unused
            if not any(p in used for p in parts):
                fs.delete(top.getPath(), True)
    return removed
