"""Every operator and every pipeline stage over the awkward table, over an empty one, and with
extra columns of clashing names."""

import pytest
from cases import CLASHES, DOCS, SCHEMA, docs, wide
from pyspark.sql import functions as F

from supportflow.llm import (decontaminate, language, licenses, lines, mixing, near_dedup, pii, quality, sharding,
                             warc)

ITEMS = [(1, "ein zwei drei vier fünf sechs sieben acht neun zehn"), (2, None), (None, "zwei"), (3, "")]


def items(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def labels(spark, rows=((1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix_documents(d),
    "sharding": lambda s, d: sharding.with_shard(d, prefix="out_"),
    "pii": lambda s, d: pii.sanitise(d, prefix="out_"),
    "decontaminate": lambda s, d: decontaminate.scan(d, items(s), prefix="out_"),
    "decontaminate_documents": lambda s, d: decontaminate.decontaminate(d, items(s)),
    "decontaminate_spans": lambda s, d: decontaminate.decontaminate(d, items(s), mode="span"),
    "licenses": lambda s, d: licenses.scan(d, licenses.known_licenses(s), prefix="out_"),
    "language": lambda s, d: language.predict(d, language.train(d), prefix="out_"),
    "near_dedup": lambda s, d: near_dedup.dedup(d),
    "lines": lambda s, d: lines.remove_repeats(d, prefix="out_"),
    "quality": lambda s, d: quality.quality_rules(d, labels(s), prefix="out_"),
}
#: Rows of the awkward table that stay.
ROWS = {"mixing": None, "decontaminate_documents": 8, "near_dedup": 9}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_columns(spark, name):
    d = wide(spark)
    out = OPERATORS[name](spark, d)
    assert out.columns[:len(d.columns)] == d.columns
    rows = out.collect()
    want = ROWS.get(name, len(DOCS))
    if want is not None:
        assert len(rows) == want
    assert all(r[c] == "x" for r in rows for c in CLASHES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_empty_side_tables(spark):
    clean = decontaminate.scan(docs(spark), items(spark, []))
    assert clean.filter("n_hit > 0").count() == 0 and clean.count() == len(DOCS)
    scored = quality.quality_rules(docs(spark), labels(spark, []))
    assert scored.filter("kept = base_failed").count() == 0
    assert licenses.scan(docs(spark), licenses.known_licenses(spark).limit(0)).filter("license is not null").count() == 0


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("rows", [DOCS, []], ids=["awkward", "empty"])
def test_pipeline_stages(spark, tmp_path, stage, rows):
    import corpus_pipeline
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, d, str(tmp_path))
    if name != "sharding":
        assert out.columns == d.columns
    got = out.count()
    assert got == 0 if not rows else got > 0


def test_warc_awkward_pages(spark):
    rows = [(1, "http://a.example/x", "<p>one</p>"), (2, None, None), (None, "http://a.example/\r\nX: y", ""),
            (3, "https://www.A.example:80/x#f", "<p>one</p>"), (4, "", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\n"),
            (4, "", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\n"), (None, None, "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1))
    out = warc.archive_pages(pages).collect()
    assert len(out) == len(rows) and all(r["intact"] for r in out)
    by = sorted(((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["refers_to"]) for r in out), key=str)
    assert by == sorted([(1, "response", 10, None), (3, "revisit", 10, 1), (2, "response", 0, None), (0, "revisit", 0, 2),
                         (4, "response", 40, None), (4, "revisit", 40, 4), (0, "response", 200_000, None)], key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_null_schema_is_kept(spark):
    assert near_dedup.dedup(docs(spark)).schema == docs(spark).schema
    assert SCHEMA.startswith("doc_id long")
