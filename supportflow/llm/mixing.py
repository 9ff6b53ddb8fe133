"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents (a hash of the document and of the pass picks the order)
and serves them one after the other; a document's virtual finish time is its source's
cumulative words divided by the source's target. The mix is all sources merged in the order of
virtual finish time, cut where the total budget is used up. A source whose target exceeds its
size is served again, in a new order, so a document is taken at most ``MAX_PASSES`` times. The
documents in service when the budget runs out are cut there: each source gives its target, to
the word.

Targets: ``share`` of all words, divided by weight; a source is held to ``MAX_PASSES`` times its
size and the excess is shared again by weight until nothing exceeds (water filling, solved in
one sweep over the sources sorted by limit / weight). Weights 5, 2, 1, repeating, go to the
sources in code-point order, null last.

Plan: sizes are one projection over whole texts, written as a narrow table. Cumulative words
never gather a source in one task: rows are dealt to ``16 ** SLOT_DIGITS`` slots of the shuffle
order per source, slots are summed first, and windows run per (source, pass, slot). The virtual
time at which the budget is used up is 1 for all sources, so the cut needs no total order;
``mix`` range-sorts the rows it returns.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source;
repeated rows, equal in id and size, are served one after the other like any others; empty
tables give no rows; extra columns pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportflow.llm.common import fits, prepare, running_sums, small_side, stored

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
SLOT_DIGITS = 3
SOURCES_IN_ONE_TASK = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sorted by limit / weight, the sources held to their limit come first; the others get
    ``weight * level`` with ``level = (budget - limits before) / weights from here on``. A
    source is held if its limit is at most its weight times the level computed at it.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = _running(per.withColumn("absent", F.col("source").isNull()).withColumn("one", F.lit(1)),
                      ["absent", "source"], {"rank": "one"}).drop("one", "absent")
    by_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = (ranked.withColumn("weight", by_rank).withColumn("limit", F.lit(max_passes) * F.col("source_size"))
              .withColumn("ratio", F.col("limit") / F.col("weight")))
    total = per.agg(F.sum("source_size").alias("all")).first()["all"] or 0
    all_weights = limits.agg(F.sum("weight").alias("w")).first()["w"] or 0
    swept = _running(limits, ["ratio", "rank"], {"limits_to": "limit", "weights_to": "weight"})
    budget = F.lit(share * total)
    level = ((budget - (F.col("limits_to") - F.col("limit")))
             / (F.lit(float(all_weights)) - (F.col("weights_to") - F.col("weight"))))
    held = stored(swept.withColumn("level", level).withColumn("held", F.col("ratio") <= F.col("level")), "held")
    # the first source that is not held fixes the level of all that follow
    first = held.filter(~F.col("held")).orderBy("ratio", "rank").select("level").limit(1).collect()
    shared = first[0]["level"] if first else 0.0
    return held.select("source", "source_size",
                       F.when(F.col("held"), F.col("limit").cast("double"))
                       .otherwise(F.col("weight") * F.lit(float(shared))).alias("target"))


def _running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over the sources: one window for a checked, small number of them, else
    range-partitioned."""
    if fits(df, SOURCES_IN_ONE_TASK):
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(k) for k, c in sums.items()])
    return running_sums(df, order, sums)


def with_size(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)).alias("print")]


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, doc_id, source, size, print``: written once, so that ``row`` names a row for good."""
    return stored(docs.select(*with_size(docs, id_col, text_col, source_col))
                  .withColumn("row", F.monotonically_increasing_id()), "sizes")


def shuffle_key(one_pass: Column) -> Column:
    """The place of a document in its source's shuffle order of a pass."""
    return F.md5(F.concat_ws(":", one_pass.cast("string"), F.col("print")))


def services(sizes: DataFrame, targets: DataFrame, passes: int = MAX_PASSES) -> DataFrame:
    """One row per document and pass that its source needs, the first pass always:
    ``row, doc_id, source, size, source_size, target, pass, key, finish, taken``. ``finish`` is
    the virtual finish time (the budget ends at 1), ``taken`` the words the mix takes."""
    t = small_side(targets.select(F.col("source").alias("t_source"), "source_size", "target"))
    each = (sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
            .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
            .filter((F.col("pass") == 0) | (F.col("target") > F.col("pass") * F.col("source_size")))
            .withColumn("key", shuffle_key(F.col("pass")))
            .withColumn("slot", F.substring("key", 1, SLOT_DIGITS)))
    slots = each.groupBy("source", "pass", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source", "pass").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(F.col("source").alias("o_source"), F.col("pass").alias("o_pass"), F.col("slot").alias("o_slot"),
                           F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("source", "pass", "slot").orderBy("key", "doc_id", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("pass") * F.col("source_size") + F.col("offset") + F.col("served")
    return (each.withColumn("served", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(small_side(offsets), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("pass") == F.col("o_pass"))
                  & (F.col("slot") == F.col("o_slot")))
            .withColumn("start", start)
            .withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")))
            .withColumn("taken", F.greatest(F.lit(0), F.least(
                F.col("size"), F.floor(F.col("target")).cast("long") - F.col("start"))))
            .select("row", "doc_id", "source", "size", "source_size", "target", "pass", "key", "finish", "taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The services that the mix takes words of, range-sorted over the cluster by virtual finish
    time and cut at the budget."""
    prepare(docs.sparkSession)
    sizes = sizes_of(docs, id_col, text_col, source_col)
    rows = services(sizes, source_targets(sizes, weights, share)).filter(F.col("taken") > 0)
    return rows.sort("finish", "source", "pass", "key", "doc_id")


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken`` (repeats counted)."""
    prepare(docs.sparkSession)
    sizes = sizes_of(docs, id_col, text_col, source_col)
    return (services(sizes, source_targets(sizes, weights, share)).groupBy("row")
            .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
                 F.sum("taken").alias("taken")).drop("row"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixed documents, whole, with the columns of ``docs``: a document served twice is two
    rows, and the one in service at the budget's end is kept whole.

    What a source serves in a pass is a prefix of its shuffle order, so the last key served per
    (source, pass) decides every row of ``docs`` where it is; no text is shuffled."""
    prepare(docs.sparkSession)
    sizes = sizes_of(docs, id_col, text_col, source_col)
    ends = (services(sizes, source_targets(sizes, weights, share)).filter(F.col("taken") > 0)
            .groupBy("source", "pass").agg(F.max("key").alias("last"))
            .groupBy(F.col("source").alias("__m_source"))
            .agg(F.map_from_entries(F.collect_list(F.struct("pass", "last"))).alias("__m_last")))
    marked = docs.select("*", *[c.alias(f"__m_{n}") for c, n in zip(
        with_size(docs, id_col, text_col, source_col)[2:], ("size", "print"))])
    key = lambda p: F.md5(F.concat_ws(":", p.cast("string"), F.col("__m_print")))
    times = F.filter(F.map_keys("__m_last"), lambda p: key(p) <= F.element_at("__m_last", p))
    return (marked.join(small_side(stored(ends, "ends")), F.col(source_col).eqNullSafe(F.col("__m_source")))
            .filter(F.col("__m_size") > 0).withColumn("__m_pass", F.explode(times)).select(*docs.columns))
