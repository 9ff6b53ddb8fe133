"""Fingerprints against brute force, over awkward rows, and the properties of the sketch."""

import hashlib
import re

import pytest
from cases import CLASHES, DOCS, docs, prose, wide
from pyspark.sql import functions as F

from supportflow.llm import fingerprints
from supportflow.plans import check

SF = "/root/testdata/sf0.001"


def hashes(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if not w:
        return []
    return [hashlib.md5(" ".join(w[i:i + size]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - size + 1))]


def sketch(text, fraction=1 / 8):
    h = hashes(text)
    kept = sorted({x for x in h if int(x, 16) < fraction * 2 ** 64})
    return kept or sorted(h)[:1]


def like(a, b):
    if a == b:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        out.append((k, len(t), e, tuple(sketch(t)), tuple(sketch(e)), like(sketch(t), sketch(e)), like(sketch(t), sketch(after))))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["n_chars"], r["edited"], tuple(r["fingerprint"]), tuple(r["edited_fingerprint"]),
                   r["near_edited"], r["near_next"]) for r in df.collect())


def test_query_matches_oracle(spark):
    from supportflow.llm.oracle import oracle_sql
    from supportflow.llm.queries import queries
    out = queries()["op12_fingerprints"](spark, SF)
    res = check.duck(SF).execute(oracle_sql()["op12_fingerprints"])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(out.columns)
    assert check._rows(out.columns, [tuple(r) for r in out.collect()]) == check._rows(cols, res.fetchall())


@pytest.mark.parametrize("n", [1, 2, 300])
def test_next_document_over_many_blocks(spark, n):
    texts = prose(n, seed=3, words=30)
    texts[0] = None
    rows = [((i * 7919) % 100_003 - 5_000, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(fingerprints.edited_neighbours(d.repartition(5))) == brute(rows)


def test_hot_and_null_ids_keep_every_row(spark):
    texts = prose(240, seed=5, words=20)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.edited_neighbours(d).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(k), t) for k, t in rows)
    heads = {t[:1] for t in texts}
    for r in out:
        half = len(r["text"]) // 2
        assert r["edited"].startswith(r["text"][:len(r["text"]) - half])
        assert tuple(r["fingerprint"]) == tuple(sketch(r["text"])) and tuple(r["edited_fingerprint"]) == tuple(sketch(r["edited"]))
    assert len(heads) > 3
    again = fingerprints.edited_neighbours(d.repartition(11)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"], r["edited"])     # noqa: E731
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_hot_id_is_cut_into_several_blocks(spark):
    keys = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("k"),
                                    F.xxhash64("id").alias("h"))
    block = fingerprints._block(F.col("k"), F.col("h"), fingerprints._cuts(keys))
    rows = [(r["k"], r["h"], r["b"]) for r in keys.select("k", "h", block.alias("b")).collect()]
    rows.sort(key=lambda r: (-r[0], r[1]))
    assert [b for *_, b in rows] == sorted(b for *_, b in rows)          # blocks follow the order
    assert len({b for k, _, b in rows if k == 5}) >= 4
    assert max(sum(1 for r in rows if r[2] == b) for b in {r[2] for r in rows}) < 1000


def test_awkward_rows_and_clashing_columns(spark):
    d = wide(spark)
    out = fingerprints.edited_neighbours(d, prefix="out_")
    assert out.columns[:len(d.columns)] == d.columns
    rows = out.collect()
    assert len(rows) == len(DOCS) and all(r[c] == "x" for r in rows for c in CLASHES)
    for r in rows:
        assert r["out_fingerprint"] == sketch(r["text"]) and 0 <= r["out_near_edited"] <= 1
    assert fingerprints.edited_neighbours(docs(spark, []), prefix="out_").collect() == []
    with pytest.raises(ValueError, match="n_chars"):
        fingerprints.edited_neighbours(d)


def test_sketches_merge_and_estimate_containment(spark):
    long, other = " ".join(prose(30, seed=8, words=200)), " ".join(prose(30, seed=9, words=200))
    words = long.split()
    part = " ".join(words[100:1100])
    d = spark.createDataFrame([("long", long), ("part", part), ("other", other)], "k string, t string")
    s = {r["k"]: r["s"] for r in d.select("k", fingerprints.fingerprint(F.col("t")).alias("s")).collect()}
    assert 0.09 < len(s["long"]) / len(set(hashes(long))) < 0.16
    rows = spark.createDataFrame([(s["part"], s["long"], s["other"])], "a array<string>, b array<string>, c array<string>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = rows.select(fingerprints.containment(a, b).alias("ab"), fingerprints.containment(b, a).alias("ba"),
                    fingerprints.containment(a, c).alias("ac")).first()
    assert r["ab"] == 1.0 and r["ac"] == 0.0
    assert r["ba"] == pytest.approx(996 / len(set(hashes(long))), abs=0.06)
    both = spark.createDataFrame([("g", s["long"]), ("g", s["other"]), ("h", s["part"])], "g string, s array<string>")
    merged = {}
    for r in fingerprints.merged(both, "g", "s").collect():
        merged.setdefault(r["key"], set()).add(r["hash"])
    assert merged == {"g": set(s["long"]) | set(s["other"]), "h": set(s["part"])}


def test_main_path_is_native(spark):
    plan = fingerprints.edited_neighbours(docs(spark).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Window" in plan and not re.search("Python|Pandas|Arrow", plan)
