"""Sharding by extendible hashing: a directory over the leading bits of a hash, in which only
the buckets that exceed the byte limit split on one more bit, until every shard fits.

The hash of a row is 60 bits of the MD5 of its id and text. Bytes are summed once per ``LEVELS``
leading bits; from that table (at most ``2**LEVELS`` rows) every depth is derived at once: the
shard of a prefix is its shortest leading part whose bytes fit. Only prefixes that are still too
large go on to the next ``LEVELS`` bits, with the bytes of their rows alone. Native column
expressions throughout.

A shard's name is its bits (``""`` for a single shard). A text larger than the limit can't be
cut and rows with equal id and text can't be told apart by a hash: when all bits are used such a
bucket is a shard over the limit, marked ``oversized``.

Defined results: a null text has 0 bytes; a null id hashes as the empty string; repeated rows
share a shard; an empty table has no shards; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportflow.llm.common import ensure_checkpoint_dir, shared_path, small_side, stored

BITS, LEVELS = 60, 12
LIMIT = 1 << 20


def row_bits(id_col: str, text_col: str) -> Column:
    """The hash as a string of ``BITS`` binary digits."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                               F.coalesce(F.col(text_col), F.lit(""))))
    return F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")


def byte_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``bits, shard, bytes``: the shard of every hash prefix ``bits`` of ``rows(bits, bytes)``.
    ``bits`` are as long as was needed to place the prefix."""
    parts, rest, depth = [], rows, 0
    while True:
        deeper = depth + LEVELS
        table = stored(rest.groupBy(F.substring("bits", 1, deeper).alias("bits")).agg(F.sum("bytes").alias("bytes")),
                       "directory")
        shortest = 0 if depth == 0 else depth + 1
        nodes = (table.select("bits", "bytes", F.explode(F.sequence(F.lit(shortest), F.lit(deeper))).alias("depth"))
                 .groupBy(F.substring("bits", F.lit(1), F.col("depth")).alias("node"), "depth")
                 .agg(F.sum("bytes").alias("bytes")))
        last = deeper >= BITS
        fit = small_side(nodes.filter((F.col("bytes") <= limit) | (F.col("depth") == deeper) & F.lit(last))
                         .select(F.col("node"), F.col("depth").alias("d"), F.col("bytes").alias("shard_bytes")))
        tries = table.select("bits", F.explode(F.sequence(F.lit(shortest), F.lit(deeper))).alias("depth"))
        placed = (tries.join(fit, (F.substring("bits", F.lit(1), F.col("depth")) == F.col("node"))
                             & (F.col("depth") == F.col("d")))
                  .groupBy("bits").agg(F.min_by(F.struct(F.col("node").alias("shard"), F.col("shard_bytes").alias("bytes")),
                                                "depth").alias("s"))
                  .select("bits", "s.shard", "s.bytes"))
        parts.append(stored(placed, "placed"))
        over = table.join(parts[-1].select("bits"), "bits", "left_anti").select(F.col("bits").alias("p"))
        over = stored(over, "oversized")
        if last or not over.head(1):
            break
        rest = rest.join(small_side(over), F.substring("bits", 1, deeper) == F.col("p"), "left_semi")
        depth = deeper
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
               prefix: str = "") -> DataFrame:
    """``docs`` with ``shard``, ``bytes`` (of the row), ``shard_bytes`` and ``oversized``."""
    ensure_checkpoint_dir(docs.sparkSession)
    marked = docs.select("*", row_bits(id_col, text_col).alias("__s_bits"), byte_size(text_col).alias("__s_bytes"))
    rows = stored(marked.select(F.col("__s_bits").alias("bits"), F.col("__s_bytes").alias("bytes")), "hashes")
    placed = stored(directory(rows, limit).select(F.col("bits").alias("__p_bits"), F.col("shard").alias("__p_shard"),
                                                  F.col("bytes").alias("__p_bytes")), "shards")
    lengths = [r[0] for r in placed.select(F.length("__p_bits")).distinct().collect()]   # at most BITS / LEVELS
    out = marked
    for n in sorted(lengths):
        side = small_side(placed.filter(F.length("__p_bits") == n))
        found = side.select(F.col("__p_bits").alias(f"__k{n}"), F.struct("__p_shard", "__p_bytes").alias(f"__v{n}"))
        out = out.join(found, F.substring("__s_bits", 1, n) == F.col(f"__k{n}"), "left")
    best = F.coalesce(*[F.col(f"__v{n}") for n in sorted(lengths)]) if lengths else F.struct(
        F.lit("").alias("__p_shard"), F.lit(0).cast("long").alias("__p_bytes"))
    return (out.withColumn("__s", best)
            .select(*docs.columns, F.col("__s.__p_shard").alias(prefix + "shard"), F.col("__s_bytes").alias(prefix + "bytes"),
                    F.col("__s.__p_bytes").alias(prefix + "shard_bytes"),
                    (F.col("__s.__p_bytes") > limit).alias(prefix + "oversized")))


def write_shards(docs: DataFrame, path: str | None = None, limit: int = LIMIT, **options) -> str:
    """Writes one folder per shard (``shard=0110``), each by one task; a shard fits its limit, so
    a task's file does too. Returns the path."""
    path = path or shared_path(docs.sparkSession, "sharded")
    sharded = with_shard(docs, limit, prefix="__out_", **options)
    (sharded.withColumn("shard", F.concat(F.lit("b"), F.col("__out_shard")))
     .drop("__out_shard", "__out_bytes", "__out_shard_bytes", "__out_oversized")
     .repartition("shard").write.partitionBy("shard").parquet(path))
    return path
