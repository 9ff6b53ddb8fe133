"""Licence scan: canonical digest lookup.

A text is normalised (case; copyright notice lines and "all rights reserved" removed;
punctuation, layout and comment marks to single spaces; equivalent spellings to one) and its
digest is hash-joined with the digests of known licences, normalised alike. Entire texts are
looked up, and every line of a text as an entire text of its own, so that a licence notice
inside a longer document is found too. Native column expressions throughout.

Plan: one scan. Lines are exploded with their row's number; the join's small side, the known
digests, is broadcast behind a size check, else both sides are shuffled by digest (a very common
line is skewed on the big side only, which AQE splits). After the join only matching lines and
one row per document are left for the last aggregation.

Defined results: a null or empty text, or one of nothing but punctuation, has the digest of the
empty text and no licence; nothing is known under an empty normal form; licences that share a
normal form are all reported; repeated rows are looked up row by row; extra columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.llm.common import fits
from supportflow.llm.license_texts import LICENSES

#: Spelling -> equivalent spelling, replaced anywhere in lower-cased text, in order.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("favour", "favor"), ("colour", "color"), ("honour", "honor"), ("acknowledgement", "acknowledgment"),
    ("whilst", "while"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("https ", "http "),
]
#: A line that states a copyright holder: the mark, then the year or its placeholder.
NOTICE = (r"(^|\n)[^0-9a-z\n]*(copyright[ \t]*(\(c\)|©|[0-9][0-9][0-9][0-9]|<year>|\[year\]|by )"
          r"|\(c\)[ \t]*[0-9][0-9][0-9][0-9]|©)[^\n]*")
RESERVED = "all rights reserved"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
LAYOUT = r"[ \n]+"


def normal_lines(text: Column) -> Column:
    """The normalised text, line feeds kept."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, NOTICE, "$1")
    x = F.regexp_replace(x, PUNCTUATION, " ")
    for old, new in [(RESERVED, ""), *SPELLINGS]:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def one_line(normal: Column) -> Column:
    return F.trim(F.regexp_replace(normal, LAYOUT, " "))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``license_id, text`` of the built-in licence texts and notices, or of ``texts``."""
    return spark.createDataFrame(list((texts or LICENSES).items()), "license_id string, text string")


def digests(known: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """``digest, licenses``: the known normal forms and their licence ids."""
    return (known.select(one_line(normal_lines(F.col(text_col))).alias("n"), F.col(id_col).alias("id"))
            .filter((F.col("n") != "") & F.col("id").isNotNull())
            .groupBy(F.md5("n").alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("licenses")))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         prefix: str = "") -> DataFrame:
    """``keep`` columns (default: all) with ``digest`` (of the entire normal form), ``license``
    (ids of the entire text, or null), ``n_license_lines`` and ``line_licenses`` (distinct ids
    of the lines, sorted and comma-joined)."""
    keep = docs.columns if keep is None else keep
    table = digests(known).select(F.col("digest").alias("__k"), F.col("licenses").alias("__l"))
    table = F.broadcast(table) if fits(table) else table
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("__row"),
                       F.monotonically_increasing_id().alias("__id"), normal_lines(F.col(text_col)).alias("__n"))
    # element 0 is the entire text; digests are taken after the explode, once per unit
    units = (rows.select("__row", "__id", F.posexplode(F.concat(F.array(F.col("__n")), F.split("__n", "\n")))
                         .alias("__at", "__unit"))
             .select("__row", "__id", "__at", F.md5(one_line(F.col("__unit"))).alias("__d")))
    found = (units.join(table, F.col("__d") == F.col("__k"), "left")
             .filter((F.col("__at") == 0) | F.col("__l").isNotNull()))
    line = F.when(F.col("__at") > 0, F.col("__l"))
    first = F.col("__at") == 0
    out = found.groupBy("__id").agg(
        F.first(F.when(first, F.col("__row")), ignorenulls=True).alias("__row"),
        F.max(F.when(first, F.col("__d"))).alias("__digest"), F.max(F.when(first, F.col("__l"))).alias("__license"),
        F.count(line).alias("__n_lines"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(line, ","))))), ",").alias("__lines"))
    return out.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("__digest").alias(prefix + "digest"), F.col("__license").alias(prefix + "license"),
                      F.col("__n_lines").alias(prefix + "n_license_lines"), F.col("__lines").alias(prefix + "line_licenses"))
