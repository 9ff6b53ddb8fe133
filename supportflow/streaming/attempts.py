"""Judge attempts as they arrive (S1 with N8): the score of the earliest successful attempt per id,
kept as streaming state.

Attempts come in any order and may come again. They are scored where they are read, so texts are
not shuffled; a replayed ``(id, attempt)`` is dropped by ``dropDuplicatesWithinWatermark``. The
state of an id is its earliest success and how many attempts there were; ids share the state of
their bucket (``BUCKETS``, fixed for a checkpoint folder), 32 bytes each, so a task handles the ids
of a bucket together. A row is appended whenever an id gets an attempt. State, progress and
output live in folders: a job that is stopped anywhere and started again on them goes on where it
was, and ``latest`` of its output equals the batch result of the attempts read so far.

State ends: an id without a new attempt for ``idle`` (event time) is forgotten. An attempt later
than the watermark is dropped by the engine, so ``delay`` must exceed the disorder of the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from supportflow.operators import judge as J
from supportflow.streaming.scoring import _paths

OUTPUT = "id long, llm_overall int, attempts long"
STATE = "ids binary"                               # rows of HELD, by id
HELD = np.dtype([("id", "<i8"), ("first", "<i4"), ("score", "<i4"), ("attempts", "<i8"), ("expires", "<i8")])
BUCKETS = 4096


def _merge(held: np.ndarray, ids: np.ndarray, attempt: np.ndarray, score: np.ndarray, expires: int) -> tuple[np.ndarray, np.ndarray]:
    """``(others, changed)``: the held rows without a new attempt, and those of the ids with one. A
    score of 0 is none yet."""
    own, row = np.unique(ids, return_inverse=True)
    at = np.searchsorted(held["id"], own)
    known = np.flatnonzero(at < len(held))
    known = known[held["id"][at[known]] == own[known]]
    changed = np.zeros(len(own), HELD)
    changed["id"] = own
    changed[known] = held[at[known]]
    changed["attempts"] += np.bincount(row, minlength=len(own))
    changed["expires"] = expires
    good = np.flatnonzero(~np.isnan(score) & ~np.isnan(attempt))
    good = good[np.lexsort((attempt[good], row[good]))]
    good = good[np.unique(row[good], return_index=True)[1]]                            # the earliest success of each
    new = changed[row[good]]
    good = good[(new["score"] == 0) | (attempt[good] < new["first"])]
    changed["first"][row[good]], changed["score"][row[good]] = attempt[good], score[good]
    return np.delete(held, at[known]), changed


def _step(idle_ms: int):
    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], HELD) if state.exists else np.zeros(0, HELD)
        now, changed = max(state.getCurrentWatermarkMs(), 0), np.zeros(0, HELD)
        if not state.hasTimedOut:
            ids, attempt, score = (np.concatenate(x) for x in zip(*(
                (p["id"].to_numpy(np.int64), p["attempt"].to_numpy(float), p["llm_overall"].to_numpy(float)) for p in parts)))
            held, changed = _merge(held, ids, attempt, score, now + idle_ms)
        held = np.concatenate([held[held["expires"] >= now], changed])
        if len(held):
            state.update((np.sort(held, order="id").tobytes(),))
            state.setTimeoutTimestamp(int(held["expires"].min()))
        elif state.exists:
            state.remove()
        if len(changed):
            yield pd.DataFrame({"id": pd.arrays.IntegerArray(changed["id"].copy(), np.full(len(changed), bool(key[1]))),
                                "llm_overall": pd.arrays.IntegerArray(changed["score"].copy(), changed["score"] == 0),
                                "attempts": changed["attempts"]})
    return step


def first_successes(attempts: DataFrame, delay: str = "7 days", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """A stream of ``id, llm_overall, attempts``, the last row of an id being its state, from a
    stream ``id, attempt, raw, at``."""
    scored = J.score_one(attempts.withWatermark("at", delay)).select("id", "attempt", "llm_overall", "at")
    once = scored.dropDuplicatesWithinWatermark(["id", "attempt"])
    dealt = once.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"), F.col("id").isNull().alias("no_id"),
                        F.coalesce("id", F.lit(0)).alias("id"), "attempt", "llm_overall", "at")
    return dealt.groupBy("bucket", "no_id").applyInPandasWithState(_step(idle_ms), OUTPUT, STATE, "append",
                                                                   GroupStateTimeout.EventTimeTimeout)


def run(attempts: DataFrame, out: str | None = None, checkpoint: str | None = None, **options) -> str:
    """Processes what has arrived and stops; the next run on the same folders goes on from there."""
    out, checkpoint = _paths(attempts.sparkSession, "attempts", out, checkpoint)
    q = (first_successes(attempts, **options).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Per id the row with most attempts seen: the state after the last batch."""
    rows = spark.read.schema(OUTPUT).parquet(out)
    return rows.groupBy("id").agg(F.max_by("llm_overall", "attempts").alias("llm_overall"), F.max("attempts").alias("attempts"))
