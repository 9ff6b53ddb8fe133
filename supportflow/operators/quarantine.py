"""Bad rows kept, with reasons (A1, N5, B10): a job over damaged input loses no row and doesn't fail.

``split`` tests every row against named checks in one projection; a row that fails any goes to the
error side with all its reason codes, so valid and error rows always add up to the input.
``typed`` turns text records into typed rows with ``try_`` casts and the corrupt-record column;
what a cast could not read is a reason, not a null. ``Sink`` keeps the error rows of several
steps in one versioned table.

Defined results: a check that is null counts as failed; a row may have several reasons, in the
order of the checks; an empty table has no rows on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.sources import snapshots
from supportflow.sources.csv_chunks import OPTIONS

REASONS = "reasons"
CORRUPT = "_corrupt_record"


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with the codes of the checks (code -> condition that a good row meets) it fails."""
    failed = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(code)) for code, ok in checks.items()]
    return df.withColumn(REASONS, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, error rows with their reasons)``."""
    marked = with_reasons(df, checks)
    return marked.filter(F.size(REASONS) == 0).drop(REASONS), marked.filter(F.size(REASONS) > 0)


def typed(records: DataFrame, schema: T.StructType, record_col: str = "record") -> DataFrame:
    """CSV records as typed columns, with ``_corrupt_record`` (the record, if its columns don't fit
    the schema) and ``_unread``: the columns whose text is there but no value of their type."""
    names = ", ".join(f"`{f.name}` string" for f in schema.fields) + f", {CORRUPT} string"
    read = records.withColumn("__r", F.from_csv(record_col, names, {**OPTIONS, "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}))
    cast = {f.name: F.col(f"__r.{f.name}").try_cast(f.dataType) for f in schema.fields}
    unread = F.array_compact(F.array(*[F.when(F.col(f"__r.{f.name}").isNotNull() & cast[f.name].isNull(), F.lit(f.name))
                                       for f in schema.fields]))
    keep = [F.col(c) for c in records.columns if c not in cast]
    return read.select(*keep, *[c.alias(n) for n, c in cast.items()], F.col(f"__r.{CORRUPT}").alias(CORRUPT), unread.alias("_unread"))


def report(errors: DataFrame) -> DataFrame:
    """``reason, n``: rows per reason (a row with two reasons counts for both)."""
    return errors.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


class Sink:
    """Error rows of named steps in one versioned table ``step, row, reasons``; the row as JSON."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, step: str, errors: DataFrame) -> int:
        """Replaces the rows of ``step``; other steps' rows stay. Returns the version."""
        rows = errors.select(F.lit(step).alias("step"), F.to_json(F.struct(*[c for c in errors.columns if c != REASONS])).alias("row"),
                             F.col(REASONS))
        if snapshots.versions(self.spark, self.path):
            rows = snapshots.read(self.spark, self.path).filter(F.col("step") != step).unionByName(rows)
        return snapshots.replace(rows, self.path, "row")

    def read(self) -> DataFrame:
        return snapshots.read(self.spark, self.path)


MESSAGE = T.StructType([T.StructField("tweet_id", T.LongType()), T.StructField("text", T.StringType())])


def message_checks() -> dict[str, Column]:
    """What the agent needs of a message record read by ``typed``."""
    return {"corrupt_record": F.col(CORRUPT).isNull(), "unreadable_id": ~F.array_contains("_unread", "tweet_id"),
            "missing_id": F.col("tweet_id").isNotNull() | F.array_contains("_unread", "tweet_id") | F.col(CORRUPT).isNotNull(),
            "missing_text": F.trim("text") != ""}


def response_checks() -> dict[str, Column]:
    """What a reply needs: a response, and text left of it after cleaning (``reply``)."""
    return {"no_response": F.col("raw").isNotNull(), "rejected_reply": F.col("raw").isNull() | F.col("reply").isNotNull()}
