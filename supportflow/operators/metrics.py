"""Evaluation metrics (F1-F15 except retrieval ones) as aggregations.

Everything starts from the pair-count table ``groupBy(truth, pred).count()``: one
partial-aggregated shuffle over the data, after which the per-label arithmetic runs on
at most ``labels^2`` rows. F1 is ``2tp / (2tp + fp + fn)`` (0 when undefined), over
labels in truth or prediction; results rounded to 4 (H25).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return (df.select(F.col(truth).cast("string").alias("y"), F.col(pred).cast("string").alias("p"))
            .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """F8: ``n, accuracy``; a null label or prediction is never correct."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.round(F.avg(F.coalesce(F.col(truth).cast("string") == F.col(pred).cast("string"),
                                           F.lit(False)).cast("double")), 4)
                  .alias("accuracy"))


def per_label(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``label, tp, fp, fn, support, precision, recall, f1`` for labels in truth ∪ prediction.

    A null prediction is a miss for its true label and a null truth a false positive for
    the predicted one, so ``tp + fn = support`` always holds."""
    pc = pair_counts(df, truth, pred)
    miss = ~F.col("y").eqNullSafe(F.col("p"))
    as_truth = pc.select(F.col("y").alias("label"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("fp"),
                         F.when(miss, F.col("n")).otherwise(0).alias("fn"),
                         F.col("n").alias("support"))
    as_pred = pc.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                        F.when(miss, F.col("n")).otherwise(0).alias("fp"),
                        F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support"))
    s = (as_truth.unionByName(as_pred).filter(F.col("label").isNotNull())
         .groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")]))
    return (s.withColumn("precision", _safe_div(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", _safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
            .withColumn("f1", _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``n_labels, macro_f1``."""
    return per_label(df, truth, pred).agg(F.count(F.lit(1)).alias("n_labels"),
                                          F.round(F.avg("f1"), 4).alias("macro_f1"))


def binary_f1(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """positive class True; null truth counts as False."""
    y = F.coalesce(truth.cast("boolean"), F.lit(False))
    p = F.coalesce(pred.cast("boolean"), F.lit(False))
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return c.withColumn("f1", F.round(_safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4))


def _row(label: str, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("n").alias("support"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """per-label rows, then 'accuracy', 'macro avg', 'weighted avg' rows.

    Columns ``label, precision, recall, f1, support`` (accuracy row: f1 = accuracy).
    """
    pl = per_label(df, truth, pred)
    rows = pl.select("label", "precision", "recall", "f1", "support")
    tot = pl.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _safe_div(F.col("tp"), F.col("n")).alias("f1"),
                 F.col("n").alias("support")),
        _row("macro avg", "mp", "mr", "mf"), _row("weighted avg", "wp", "wr", "wf"))).alias("r")
    ).select("r.*")
    return (rows.unionByName(summary)
            .select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support")))


def confusion_pairs(df: DataFrame, truth: str, pred: str, labels: list[str] | None = None) -> DataFrame:
    """F12 (long form): every (truth, pred) pair of the labels with its count, zeros kept.

    Without ``labels``, all labels in truth or prediction. A label outside a given list is an
    error, never dropped; rows with a null label or prediction are left out (a matrix has no
    cell for them)."""
    pc = (pair_counts(df, truth, pred).dropna()
          .withColumnRenamed("y", "true_label").withColumnRenamed("p", "pred_label"))
    if labels is None:                                   # one row: the sorted label list
        known = (pc.select(F.explode(F.array("true_label", "pred_label")).alias("l"))
                 .agg(F.sort_array(F.collect_set("l")).alias("ls")))
    else:
        lab = F.array(*[F.lit(str(x)) for x in labels])
        known = df.sparkSession.range(1).select(lab.alias("ls"))
        inside = F.array_contains(lab, F.col("true_label")) & F.array_contains(lab, F.col("pred_label"))
        pc = pc.withColumn("n", F.when(inside, F.col("n")).otherwise(
            F.raise_error(F.lit("a label outside the given list")).cast("long")))
    grid = (known.select("ls", F.explode("ls").alias("true_label"))
            .select("true_label", F.explode("ls").alias("pred_label")))
    if labels is not None:
        return (grid.join(pc, ["true_label", "pred_label"], "full")
                .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return (grid.join(pc, ["true_label", "pred_label"], "left")
            .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def binary_confusion(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """F12 with the fixed order [False, True]: rows per truth value, columns per prediction."""
    y = F.coalesce(truth.cast("boolean"), F.lit(False))
    p = F.coalesce(pred.cast("boolean"), F.lit(False))
    c = df.agg(F.count_if(~y & ~p).alias("ff"), F.count_if(~y & p).alias("ft"),
               F.count_if(y & ~p).alias("tf"), F.count_if(y & p).alias("tt"))
    return c.select(F.explode(F.array(
        F.struct(F.lit(False).alias("truth"), F.col("ff").alias("pred_false"), F.col("ft").alias("pred_true")),
        F.struct(F.lit(True).alias("truth"), F.col("tf").alias("pred_false"),
                 F.col("tt").alias("pred_true")))).alias("r")).select("r.*")

