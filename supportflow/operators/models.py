"""Baselines (L2-L4, C8): majority class and TF-IDF + logistic regression in Spark ML.

A fitted model is a versioned table (``save``), one row per term with its number, idf and a
weight per class, and a row for the intercepts under the empty term. Any later batch or stream
job reads a version (``load``) and predicts in one pass: terms are counted, weighed and
multiplied with the weights in the task, a batch at a time. ``scores_by_join`` states the same in
joins over the stored table, without a bound on its size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.operators import features as FT
from supportflow.session import small_side, written
from supportflow.sources import snapshots


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """L4 + C8: the train split's majority label (ties -> smallest) on every test row.

    The majority is one row; it reaches the test rows through a broadcast equi-join on a
    constant key (a broadcast hash join of a single row)."""
    maj = (train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
           .orderBy(F.desc("__n"), F.asc(label)).limit(1)
           .select(F.col(label).alias("prediction"), F.lit(1).alias("__k")))
    return (test.withColumn("__k", F.lit(1)).join(F.broadcast(maj), "__k").drop("__k"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``class_weight='balanced'``: w = n / (k * n_label), as a column ``w``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    tot = counts.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    wt = (counts.withColumn("__one", F.lit(1)).join(F.broadcast(tot.withColumn("__one", F.lit(1))), "__one")
          .select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("w")))
    return df.join(small_side(wt), label)


@dataclass
class StoredModel:
    """What predictions need: terms by number, their idf and weights per class, intercepts."""

    terms: pa.ChunkedArray
    idf: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    sublinear: bool

    def predict(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """L3: ``rows`` (a table or a stream) with ``prediction``, the class with the largest score; a
        text without a known term gets the class with the largest intercept."""
        keep = rows.columns
        narrow = rows.select("*", FT.tokens(F.col(text_col)).alias("__t"))
        known, place, _ = FT.hashed_vocabulary(self.terms, np.arange(len(self.idf)))
        sent = rows.sparkSession.sparkContext.broadcast((known, self.idf[place], self.weights[place], self.intercept))
        sublinear = self.sublinear

        def run(batches):
            known, idf, weights, intercept = sent.value
            for b in batches:
                out = [np.zeros(0, np.int32)]
                for _, n_rows, g in FT._chunks(b.column(len(keep))):
                    row, key, count, *_ = FT._row_counts(g, n_rows, known)
                    score = np.tile(intercept, (n_rows, 1))
                    if len(row):
                        w = FT._weights(row, count, idf[key], sublinear)
                        for c in range(len(intercept)):
                            score[:, c] += np.bincount(row, w * weights[key, c], n_rows)
                    out.append(score.argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(np.concatenate(out))], names=[*keep, "prediction"])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return narrow.mapInArrow(run, f"{schema}, prediction int")


def load(spark: SparkSession, path: str, version: int | None = None) -> StoredModel:
    """The model as it was saved last, or as ``version``."""
    table = snapshots.read(spark, path, version)
    if (n := table.count()) > FT.VOCABULARY_ROWS + 1:
        raise ValueError(f"a vocabulary of {n - 1} terms is too large to send to every task; use scores_by_join")
    rows = table.orderBy("number").toArrow()                # the intercepts first
    weights = np.array(rows["weights"].to_pylist(), float).reshape(n, -1)
    return StoredModel(rows["term"].slice(1), rows["idf"].to_numpy()[1:], weights[1:], weights[0],
                       snapshots.properties(spark, path, version)["sublinear"])


def scores_by_join(rows: DataFrame, path: str, id_col: str, text_col: str = "text", version: int | None = None) -> DataFrame:
    """``id, class, score`` of every row and class, by joins over the stored table."""
    spark = rows.sparkSession
    table = snapshots.read(spark, path, version)
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(FT.TOKEN_RE), 0)
    split = rows.select(F.col(id_col).alias("id"), toks.alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(0), F.size("t") - 1)),
                        lambda i: F.concat_ws(" ", F.try_element_at("t", i), F.try_element_at("t", i + 1)))
    grams = F.when(F.size("t") > 1, F.concat("t", pairs)).otherwise(F.col("t"))
    counts = split.select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    tf = (F.lit(1.0) + F.log("n")) if snapshots.properties(spark, path, version)["sublinear"] else F.col("n").cast("double")
    terms = table.filter("number >= 0")
    v = counts.join(terms, "term").select("id", (tf * F.col("idf")).alias("v"), "weights")
    parts = (v.select("id", "v", F.posexplode("weights").alias("class", "w")).groupBy("id", "class")     # v is needed once
             .agg((F.sum(F.col("v") * F.col("w")) / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("part")))
    base = (table.filter("number < 0").select(F.posexplode("weights").alias("c", "intercept")).withColumn("one", F.lit(1)))
    every = split.select(F.col("id").alias("r_id"), F.lit(1).alias("one")).join(F.broadcast(base), "one")     # a row per class
    return (every.join(parts, (F.col("r_id") == F.col("id")) & (F.col("c") == F.col("class")), "left")
            .select(F.col("r_id").alias("id"), F.col("c").alias("class"),
                    (F.col("intercept") + F.coalesce("part", F.lit(0.0))).alias("score")))


@dataclass
class LogReg:
    """A fitted L1 + L2 baseline: the model, its vocabulary and the weighted training rows."""

    model: LogisticRegressionModel
    vocab: pa.Table
    train: DataFrame
    reg: float
    sublinear: bool

    def stored(self) -> StoredModel:
        order = np.argsort(self.vocab["number"].to_numpy())
        vocab = self.vocab.take(pa.array(order))
        return StoredModel(vocab["term"], vocab["idf"].to_numpy(), self.model.coefficientMatrix.toArray().T,
                           self.model.interceptVector.toArray(), self.sublinear)

    def save(self, path: str) -> int:
        """The model as the next version of the table at ``path``."""
        m, spark = self.stored(), self.train.sparkSession
        n = len(m.idf)
        rows = pa.table({"term": pa.concat_arrays([*m.terms.chunks, pa.array([""])]),
                         "number": pa.array(np.append(np.arange(n), -1), pa.int32()), "idf": np.append(m.idf, 0.0),
                         "weights": pa.array([*m.weights, m.intercept], pa.list_(pa.float64()))})
        return snapshots.replace(spark.createDataFrame(rows), path, "term", properties={"sublinear": self.sublinear})

    def predict(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """L3: ``rows`` with ``prediction``."""
        return self.stored().predict(rows, text_col)

    def gradient(self) -> float:
        """The largest entry of the objective's gradient at the fitted weights, from one pass
        over the training rows and one row per term."""
        k, total = self.model.numClasses, self.train.agg(F.sum("w")).first()[0]
        p = vector_to_array("probability")
        scored = self.model.transform(self.train).select("idx", "val", *[
            ((p[c] - F.when(F.col("__y") == c, 1.0).otherwise(0.0)) * F.col("w") / total).alias(f"r{c}") for c in range(k)])
        bias = scored.agg(*[F.sum(f"r{c}").alias(f"b{c}") for c in range(k)]).first()
        terms = (scored.withColumn("e", F.explode(F.arrays_zip("idx", "val")))
                 .groupBy(F.col("e.idx").alias("j")).agg(*[F.sum(F.col("e.val") * F.col(f"r{c}")).alias(f"g{c}") for c in range(k)]))
        coef = self.model.coefficientMatrix.toArray()
        known = self.train.sparkSession.createDataFrame(
            [(j, *map(float, coef[:, j])) for j in range(coef.shape[1])],
            "j int, " + ", ".join(f"w{c} double" for c in range(k)))
        worst = known.join(terms, "j", "left").agg(*[F.max(F.abs(
            F.coalesce(f"g{c}", F.lit(0.0)) + self.reg * F.col(f"w{c}"))).alias(f"m{c}") for c in range(k)]).first()
        return max([abs(b) for b in bias] + [m or 0.0 for m in worst])


def _with_features(rows: DataFrame, size: int) -> DataFrame:
    @F.udf(VectorUDT())
    def sparse(idx, val):
        return Vectors.sparse(size, idx, val)
    return rows.withColumn("features", sparse("idx", "val"))


LEAST_ROWS = 5000                                  # of a task, below which its overhead counts


def _training_tasks(n: int, rows_per_task: int, cores: int) -> int:
    return max(1, math.ceil(n / rows_per_task), min(cores, n // LEAST_ROWS))


def fit_logreg(train: DataFrame, label: str, text_col: str = "text", min_df: int = 2, max_features: int = 100000,
               max_iter: int = 2000, C: float = 1.0, balanced: bool = True, sublinear: bool = True,
               rows_per_task: int = 100000) -> LogReg:
    """L1 + L2: unigram and bigram TF-IDF (sublinear tf, smoothed idf, unit rows; vocabulary and
    idf from the training split only, cut and numbered as in L1), multinomial logistic
    regression with L2 penalty ``1/(C*n)`` and balanced weights.

    Every optimizer iteration is one distributed gradient pass over the training rows, so
    they are spread over ``ceil(n / rows_per_task)`` partitions, or all cores if that is more and
    leaves each ``LEAST_ROWS``: no core waits through the iterations of a large training set, and
    a small one has no per-iteration cost of many near-empty tasks."""
    terms = FT.vocabulary(train, min_df, max_features, text_col).orderBy(F.desc("total"), "term").toArrow()
    vocab = pa.table({"term": terms["term"], "number": np.arange(terms.num_rows), "idf": terms["idf"]})   # at most max_features rows
    n = train.count()
    rows = FT.sparse_rows(train, vocab, sublinear, text_col, [label])
    tasks = _training_tasks(n, rows_per_task, train.sparkSession.sparkContext.defaultParallelism)
    rows = written(rows.repartition(tasks), "training")                                # first: the weights count its labels
    rows = class_weights(rows, label) if balanced else rows.withColumn("w", F.lit(1.0))
    rows = _with_features(rows, vocab.num_rows).withColumn("__y", F.col(label).cast("double"))
    reg = 1.0 / (C * max(n, 1))
    lr = LogisticRegression(featuresCol="features", labelCol="__y", family="multinomial", regParam=reg,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, weightCol="w", tol=1e-9)
    return LogReg(lr.fit(rows), vocab, rows, reg, sublinear)


def tfidf_logreg(train: DataFrame, test: DataFrame, label: str, text_col: str = "text", **options) -> DataFrame:
    """L1 + L2 + L3: test rows + ``prediction``."""
    return fit_logreg(train, label, text_col, **options).predict(test, text_col)
