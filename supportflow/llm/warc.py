"""WARC archives of web pages, and their capture index by external index merge.

**Writing.** One WARC/1.1 record per page, through Spark's text writer: a record is a line whose
separator is the blank line that WARC asks for between records, so the files are plain WARC on
any file system and a lost task is simply written again. Of pages with equal payloads the one
with the smallest id (null last, then url) is a ``response``; the others are ``revisit`` records
without a payload, which refer to its record, page and address. Every record has an id of its
own, also those of repeated rows and null page ids. A ``warcinfo`` record, in a file of its own,
describes the archive. Only payloads that occur more than once are shuffled.

**Reading.** All records carry the same ``WARC-Warcinfo-ID``, a value that no payload contains
(checked before writing), so Spark's splittable text reader can cut the files at their record
heads; lengths and digests of what was read are compared with the headers.

**Index.** Every task sorts the captures it read into a run. Range partitioning by URL key and
time gives each merging task the same key range of all runs; rows of one run stay in order, and
a loser tree merges the runs. There are so many ranges that one holds about ``MERGE_ROWS``
captures, which bounds what a merging task keeps; the key ends with the page id and the record's
place, so even a URL with a third of all captures is spread over ranges.

Defined results: a null html is an empty payload; a null url has an empty key and no
``WARC-Target-URI``; a null page id is written as an absent ``X-Page-Id``; of fully equal rows one
is the response; empty tables write an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportflow.llm.common import hex_base32, prepare, shared_path, small_side, stored

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MIN_BYTES, MERGE_ROWS = 0, 100_000
START = 1_700_000_000          # capture time of page 0; one second per id, as pages have no time


def url_key(url: Column) -> Column:
    """Sort key of a URL: lower-cased host with its labels reversed, then path and query; the
    scheme, ``www.``, the port and the fragment are dropped."""
    u = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^www[0-9]*\\.", "")
    host = F.regexp_replace(F.regexp_extract(u, "^([^/?]*)", 1), ":[0-9]+$", "")
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    return F.when(u == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters can't break out of it."""
    clean = F.regexp_replace(value.cast("string"), "[\\x00-\\x1F\\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _narrow(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("sha1"),
                        F.spark_partition_id().alias("part"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = MIN_BYTES) -> str:
    """Writes the archives below ``path`` and returns their ``WARC-Warcinfo-ID``."""
    spark = pages.sparkSession
    rows = _narrow(pages, id_col, url_col, html_col)
    warcinfo = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}"
    # equal captures of one scan partition count as one group
    groups = stored(rows.groupBy("sha1", "bytes", "page_id", "url", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.contains("html", F.lit(warcinfo))).alias("clash")), "captures")
    while groups.filter("clash").head(1):
        warcinfo = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, warcinfo)}"
        groups = groups.withColumn("clash", F.lit(False))
        if rows.filter(F.contains("html", F.lit(warcinfo))).head(1):
            groups = groups.withColumn("clash", F.lit(True))
    rank = F.struct(F.col("page_id").isNull().alias("n1"), "page_id", F.col("url").isNull().alias("n2"), "url", "part")
    repeated = stored(groups.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes")
                      .agg(F.sum("n").alias("copies"), F.min(rank).alias("first")).filter(F.col("copies") > 1)
                      .select(F.col("sha1").alias("r_sha1"), F.col("bytes").alias("r_bytes"), "first"), "repeated")
    same = (F.col("sha1") == F.col("r_sha1")) & (F.col("bytes") == F.col("r_bytes"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    side = small_side(repeated)
    marked = rows.join(side, same, "left").filter(F.col("r_sha1").isNull() | is_first)
    # payloads under min_bytes are responses even if they are equal: the row's number tells them apart
    own = F.when(F.col("bytes") < min_bytes, F.monotonically_increasing_id().cast("string")).otherwise("response")
    single = marked.filter(F.col("r_sha1").isNull()).withColumn("own", own)
    chosen = (marked.filter(F.col("r_sha1").isNotNull()).groupBy("sha1", "bytes", "page_id", "url")
              .agg(F.any_value("html").alias("html")).withColumn("own", F.lit("response")))
    names = ["page_id", "url", "html", "bytes", "sha1", "own"]
    responses = single.select(*names).unionByName(chosen.select(*names))
    revisits = (groups.join(side, same)
                .withColumn("n", F.col("n") - F.when(is_first & (F.col("part") == F.col("first.part")), 1).otherwise(0))
                .filter(F.col("n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
                .select("page_id", "url", "bytes", "sha1", F.col("first.page_id").alias("refers_to"),
                        F.col("first.url").alias("refers_url"),
                        F.concat_ws(":", F.md5(F.coalesce("url", F.lit("")).cast("binary")), F.col("url").isNull().cast("int"),
                                    "part", "copy").alias("own")))
    records = (responses.select(_record(warcinfo, "response", F.col("html")).alias("value"))
               .unionByName(revisits.select(_record(warcinfo, "revisit", None).alias("value"))))
    about = spark.range(1).select(F.lit(_about(warcinfo)).alias("value"))
    about.unionByName(records).write.option("lineSep", CRLF + CRLF).text(path)
    return warcinfo


def _about(warcinfo: str) -> str:
    """The warcinfo record that all others name."""
    block = f"software: supportflow{CRLF}format: WARC File Format 1.1{CRLF}"
    when = datetime.fromtimestamp(START, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return (f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <{warcinfo}>{CRLF}WARC-Date: {when}{CRLF}"
            f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(block)}{CRLF}{CRLF}{block}")


def _record_id(digest: Column, page: Column, own: Column) -> Column:
    return F.concat(F.lit("<urn:sha1:"), digest, F.lit(":"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), own, F.lit(">"))


def _record(warcinfo: str, kind: str, html: Column | None) -> Column:
    page = F.col("page_id").cast("string")
    digest = hex_base32(F.col("sha1"))
    block = F.concat(F.lit(HTTP), html) if html is not None else F.lit("")
    second = F.pmod(F.coalesce(F.expr("try_cast(page_id as bigint)"), F.lit(0)), F.lit(1_000_000_000))
    when = F.date_format(F.timestamp_seconds(F.lit(START) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <{warcinfo}>{CRLF}WARC-Type: {kind}{CRLF}"),
             _header("WARC-Record-ID", _record_id(digest, page, F.col("own"))),
             _header("WARC-Date", when), _header("WARC-Target-URI", F.col("url")), _header("X-Page-Id", page),
             _header("X-Payload-Length", F.col("bytes")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    if kind == "revisit":
        parts += [F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
                  _header("WARC-Refers-To", _record_id(digest, F.col("refers_to"), F.lit("response"))),
                  _header("WARC-Refers-To-Target-URI", F.col("refers_url")), _header("X-Refers-To-Page-Id", F.col("refers_to"))]
    else:
        parts.append(F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"))
    return F.concat(*parts, _header("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def read_archives(spark: SparkSession, path: str, warcinfo: str, id_type: str = "long") -> DataFrame:
    """One row per capture: ``page_id, url, captured, record_type, payload_bytes, payload_digest,
    refers_to, payload, record_id, refers_record, intact`` (lengths and digest agree with the
    headers)."""
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <{warcinfo}>{CRLF}").text(path)
    cut = F.locate(CRLF + CRLF, F.col("value"))
    parts = (raw.filter(F.length("value") > 0)
             .select(F.substring("value", F.lit(1), cut + 1).alias("head"),
                     F.col("value").substr(cut + 4, F.length("value") - cut - 7).alias("block")))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", f"(?:^|\n){name}: ([^\r]*)\r", 1)
        return F.when(got != "", got)
    response = F.col("kind") == "response"
    fields = parts.select(
        field("WARC-Type").alias("kind"), F.regexp_replace(field("WARC-Record-ID"), "[<>]", "").alias("record_id"),
        F.regexp_replace(field("WARC-Refers-To"), "[<>]", "").alias("refers_record"), field("X-Page-Id").cast(id_type).alias("page_id"),
        field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("captured"),
        field("X-Payload-Length").cast("long").alias("declared"), field("Content-Length").cast("long").alias("length"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("X-Refers-To-Page-Id").cast(id_type).alias("refers_to"), "block").filter(F.col("kind") != "warcinfo")
    payload = F.when(response, F.col("block").substr(F.lit(len(HTTP) + 1), F.length("block")))
    read = fields.withColumn("payload", payload)
    measured = (F.octet_length("payload") == F.col("declared")) & (hex_base32(F.sha1(F.col("payload").cast("binary"))) == F.col("digest"))
    return read.select("page_id", "url", "captured", F.col("kind").alias("record_type"),
                       F.when(response, F.octet_length("payload")).otherwise(F.col("declared")).cast("long").alias("payload_bytes"),
                       F.when(response, hex_base32(F.sha1(F.col("payload").cast("binary")))).otherwise(F.col("digest")).alias("payload_digest"),
                       "refers_to", "payload", "record_id", "refers_record",
                       ((F.octet_length("block") == F.col("length")) & (~response | measured)).alias("intact"))


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, the winner moves on,
    so each step replays one path of ``log2 k`` matches. Ties go to the earlier run."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:                    # first match of this node: wait for the other side
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def merge_runs(captures: DataFrame, key: list[str], run: str, partitions: int | None = None) -> DataFrame:
    """``captures``, sorted by ``key`` inside every ``run``, in global order of ``key``."""
    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = captures.columns
    at = [names.index(c) for c in key]
    which = names.index(run)

    def merge(batches):
        runs: dict[int, list] = {}
        tables = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(i).to_pylist() for i in at)))
            for r, (rid, k) in enumerate(zip(b.column(which).to_pylist(), keys)):
                runs.setdefault(rid, []).append((k, len(tables), r))
            tables.append(b)
        if not tables:
            return
        starts = [0]
        for b in tables:
            starts.append(starts[-1] + b.num_rows)
        whole = pa.Table.from_batches(tables)
        tree = LoserTree([iter(_ascending(runs[r])) for r in sorted(runs)])
        order = pa.array([starts[b] + r for _, b, r in tree], pa.int64())
        yield from whole.take(order).combine_chunks().to_batches()

    return captures.repartitionByRange(n, *key).mapInArrow(merge, captures.schema)


def _ascending(rows: list) -> list:
    """A run's rows as they came; blocks of a run may arrive cut in two, never out of order
    inside a block, so this is a merge of what is already sorted."""
    return rows if all(a <= b for a, b in zip(rows, rows[1:])) else sorted(rows)


def capture_index(records: DataFrame) -> DataFrame:
    """The capture histories in global order of URL key and time (the payloads left out)."""
    prepare(records.sparkSession)
    narrow = records.drop("payload").select(
        url_key(F.col("url")).alias("url_key"), F.coalesce("captured", F.lit("")).alias("captured"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id_text"), "page_id", "url", "record_type",
        "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_record", "intact",
        F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("place"))
    key = ["url_key", "captured", "id_text", "place"]
    runs = stored(narrow.sortWithinPartitions(*key), "runs")
    ranges = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGE_ROWS))
    return merge_runs(runs, key, "run", ranges).drop("id_text", "run", "place")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **columns) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns the merged capture index."""
    spark = pages.sparkSession
    prepare(spark)
    path = path or shared_path(spark, "warc")
    warcinfo = write_archives(pages, path, id_col, **columns)
    return capture_index(read_archives(spark, path, warcinfo, pages.schema[id_col].dataType.simpleString()))
