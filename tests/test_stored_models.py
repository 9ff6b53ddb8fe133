"""Stored models: reloaded predictions, versions, streams, and the joins that state the scores."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from supportflow.operators import features as FT
from supportflow.operators import models as MD
from supportflow.sources import snapshots as S


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    words = [["battery", "charge", "power", "drain"], ["login", "password", "account", "café"], ["screen", "touch", "über", "glass"]]
    rows = []
    for i in range(150):
        y = i % 3
        text = " ".join(rng.choice(words[y] if rng.random() < .6 else ["the", "phone", "a", "is", "x1"]) for _ in range(rng.randint(1, 15)))
        rows.append((i, y, text))
    rows += [(900, 0, None), (901, 1, ""), (902, 2, "unknown zebra")]
    return spark.createDataFrame(rows, "id long, y int, text string")


@pytest.fixture(scope="module")
def fit(data):
    return MD.fit_logreg(data, "y", max_iter=50)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_reloaded_model_predicts_the_same(spark, data, fit, tmp_path):
    path = str(tmp_path / "m")
    assert fit.save(path) == 1
    got = rows(MD.load(spark, path).predict(data).select("id", "prediction"))
    sparse = FT.sparse_rows(data, fit.vocab, fit.sublinear, "text", ["id"])
    ml = fit.model.transform(MD._with_features(sparse, fit.vocab.num_rows))
    assert got == rows(ml.select("id", F.col("prediction").cast("int")))
    assert np.mean([p == i % 3 for i, p in got if i < 150]) > 0.9
    assert S.read(spark, path).count() == fit.vocab.num_rows + 1


def test_scores_by_join_are_the_models(spark, data, fit, tmp_path):
    path = str(tmp_path / "m")
    fit.save(path)
    got = {(r["id"], r["class"]): r["score"] for r in MD.scores_by_join(data, path, "id").collect()}
    sparse = FT.sparse_rows(data, fit.vocab, fit.sublinear, "text", ["id"])
    raw = fit.model.transform(MD._with_features(sparse, fit.vocab.num_rows)).select("id", vector_to_array("rawPrediction").alias("raw"))
    want = {(r["id"], c): x for r in raw.collect() for c, x in enumerate(r["raw"])}
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-8)


def test_versions_of_a_model(spark, data, fit, tmp_path):
    path = str(tmp_path / "m")
    fit.save(path)
    before = rows(MD.load(spark, path).predict(data).select("id", "prediction"))
    MD.fit_logreg(data.filter("y < 2"), "y", max_iter=5, sublinear=False).save(path)
    assert S.versions(spark, path) == [1, 2]
    assert len(MD.load(spark, path).intercept) == 2 and not MD.load(spark, path).sublinear
    assert rows(MD.load(spark, path, 1).predict(data).select("id", "prediction")) == before


def test_a_stream_reads_the_stored_model(spark, data, fit, tmp_path):
    model, source = str(tmp_path / "m"), str(tmp_path / "in")
    fit.save(model)
    data.repartition(3).write.parquet(source)
    out = MD.load(spark, model).predict(spark.readStream.schema(data.schema).parquet(source))
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "prediction")) == rows(
        MD.load(spark, model).predict(data).select("id", "prediction"))


def test_a_model_too_large_to_send(spark, data, fit, tmp_path, monkeypatch):
    fit.save(str(tmp_path / "m"))
    monkeypatch.setattr(FT, "VOCABULARY_ROWS", 3)
    with pytest.raises(ValueError, match="scores_by_join"):
        MD.load(spark, str(tmp_path / "m"))
    assert MD.scores_by_join(data, str(tmp_path / "m"), "id").count() == 3 * data.count()


def test_hashes_are_those_of_the_texts():
    import pyarrow as pa
    texts = ["aa\nbb\naa\nbb", "", "cc", "über\ncafé"]
    seen = {}
    for _, _, g in FT._chunks(pa.array(texts)):
        seen.update(zip(g.terms(np.arange(len(g.hash))).to_pylist(), g.hash.tolist()))
    assert set(seen) == {"aa", "bb", "aa bb", "bb aa", "cc", "über", "café", "über café"}
    names = sorted(seen)
    assert FT.term_hashes(pa.array(names)).tolist() == [seen[t] for t in names]


def test_many_flushes_sum_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50:02}" for j in range(20))) for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, FT.term_stats(docs).collect()))
    monkeypatch.setattr(FT, "FLUSH", 5)
    assert sorted(map(tuple, FT.term_stats(docs).collect())) == want


def test_every_text_becomes_a_row_once(spark, data, monkeypatch):
    """the class weights count the written rows, not the texts again; iterations use all cores."""
    seen = spark.sparkContext.accumulator(0)
    plain = FT.sparse_rows

    def counted(*args, **kw):
        out = plain(*args, **kw)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return out.mapInArrow(run, out.schema)
    monkeypatch.setattr(FT, "sparse_rows", counted)
    MD.fit_logreg(data, "y", max_iter=2)
    assert seen.value == data.count()
    assert [MD._training_tasks(n, 100000, 12) for n in (0, 4999, 40_000, 400_000, 2_400_000)] == [1, 1, 8, 12, 24]
