"""One CSV file read by many tasks: equal to the multiLine reader wherever the ranges fall."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from supportflow.sources import csv_chunks as CC
from supportflow.sources import tables as TB

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@pytest.fixture
def split(spark):
    """Ranges of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def to(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
    yield to
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def written(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "a", "b"])
    w.writerows(rows)
    return out.getvalue()


def awkward(n, seed):
    rng = random.Random(seed)
    parts = ["x", "\n", '"', ",", "\n\n", '""', "\r\n", " ", "é", "long value " * 5, '"\n', '\n"', ",\n,"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), rng.choice(["p", "q\nr", ""])) for i in range(n)]


def multi_line(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("lineSep", "\n").options(**CC.OPTIONS).csv(path)


@pytest.mark.parametrize("size", [16, 37, 150, 4000, 10 ** 7])
def test_equal_to_multiline_wherever_ranges_fall(spark, tmp_path, split, size):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(written(awkward(90, 1)))
    want = [tuple(r) for r in multi_line(spark, path).collect()]
    split(size)
    lines = CC._lines(spark, path)
    assert size > 4000 or lines.rdd.getNumPartitions() > 1
    got = TB.read_csv_positioned(spark, path, SCHEMA).orderBy("position").collect()
    assert [tuple(r)[:3] for r in got] == want and len(want) == 90
    assert sorted(map(str, TB.read_csv(spark, path, SCHEMA).collect())) == sorted(map(str, multi_line(spark, path).collect()))


def test_several_files_and_carriage_returns(spark, tmp_path, split):
    rows = [awkward(40, s) for s in (2, 3)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, r in enumerate(rows):
        with open(folder / f"part-{k}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(written(r, "\r\n" if k else "\n"))
    split(60)
    got = TB.read_csv_positioned(spark, str(folder), SCHEMA).orderBy("position").collect()
    clean = lambda x: None if x == "" else x     # noqa: E731
    assert [tuple(r)[:3] for r in got] == [(i, clean(a), clean(b)) for r in rows for i, a, b in r]


def test_a_file_of_one_value_longer_than_many_ranges(spark, tmp_path, split):
    path = str(tmp_path / "t.csv")
    value = "\n".join(f'line {i} "quoted"' for i in range(400))
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(written([(1, value, "z"), (2, "plain", "y")]))
    split(100)
    got = TB.read_csv(spark, path, SCHEMA).collect()
    assert sorted(map(tuple, got)) == [(1, value, "z"), (2, "plain", "y")]


def test_the_plain_reader_where_no_value_holds_a_line_feed(spark, tmp_path, split):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(written([(i, f'say ""hi"", {i}', "x,y") for i in range(50)]))
    split(200)
    df = TB.read_csv(spark, path, SCHEMA)
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() > 3
    assert df.count() == 50 and TB.read_csv(spark, path, SCHEMA, ["b"]).columns == ["b"]
    with open(str(tmp_path / "e.csv"), "w") as f:
        f.write("id,a,b\n")
    assert TB.read_csv(spark, str(tmp_path / "e.csv"), SCHEMA).count() == 0
    assert TB.read_csv_positioned(spark, str(tmp_path / "e.csv"), SCHEMA).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a",\n', max_size=6), min_size=1, max_size=5), st.integers(0, 12))
def test_states_compose(values, cut):
    """The state behind any line is that of the text before it, from either start."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(values)
    lines = out.getvalue().rstrip("\n").split("\n")
    inside, quotes = False, 0
    for line in lines:
        inside = CC.open_at_end(line, inside)
        quotes += line.count('"')
        assert inside == (quotes % 2 == 1)                      # the csv module quotes whole values


def test_first_in_file_order(spark, tmp_path, split):
    """A message id that occurs twice keeps the earlier row of the file, whatever its reply id."""
    from supportflow.operators import cases as C
    names = TB.RAW_TWEETS.fieldNames()
    rows = [(1, "u", "true", "t", "first\nquestion", "20", ""), (1, "u", "true", "t", "second question", "10", ""),
            (10, "Brand", "false", "t", "reply ten", "", "1"), (20, "Brand", "false", "t", "reply twenty", "", "1"),
            (20, "Brand", "false", "t", "reply twenty again", "", "1")]
    path = str(tmp_path / "tweets.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(names)
        w.writerows(rows)
    split(40)
    tw = TB.read_csv_positioned(spark, path, TB.RAW_TWEETS)
    got = C.build_cases(C.linked_messages(tw, "Brand"), tw, "Brand", position="position").collect()
    assert [(r["customer_text"], r["brand_reply_id"], r["brand_reply"]) for r in got] == [("first\nquestion", "20", "reply twenty")]
    other = C.build_cases(C.linked_messages(tw, "Brand"), tw, "Brand").collect()
    assert [r["brand_reply_id"] for r in other] == ["10"]       # id order, without a position


def test_first_row_of_parquet_files(spark, tmp_path):
    from supportflow.operators import cases as C
    path = str(tmp_path / "p")
    spark.createDataFrame([("b", 9), ("a", 5), ("a", 1), ("b", 2)], "k string, v long").coalesce(1).write.parquet(path)
    got = C.keep_first_in_file(C.with_file_position(spark.read.parquet(path)), "k").collect()
    assert sorted(map(tuple, got)) == [("a", 5), ("b", 9)]
