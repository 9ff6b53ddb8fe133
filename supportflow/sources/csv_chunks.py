"""One CSV file read by many tasks although quoted values hold line feeds (A1, A2).

Spark's text reader cuts files into byte ranges at line feeds, so a record may be cut anywhere in
a quoted value. Whether a range starts inside one follows from all text before it:

1. Every range (chunk) is read once for what it does to that state: whether a value is open at
   its end if none was open at its start, and if one was. Two bits per chunk.
2. The chunks' functions are composed in file order: a prefix scan over one row per chunk.
3. Every range is read again from its known state. Records that begin and end in it are cut at
   the line feeds outside quotes. What is left at its edges, an unfinished last record and the
   lines that belong to one begun before, goes to a second, small table, is put together in file
   order, and only that is shuffled.

If no line leaves a value open there are no such line feeds, and the plain reader, which splits
files by itself, reads the same rows. Records are parsed by Spark (``from_csv``) with the options
of ``OPTIONS``. To the driver and to each task goes one number and one bit per chunk (9 bytes per
128 MB of input).

Defined results: as with ``multiLine``: the first record of every file is its header, empty lines
are no records, a carriage return before a record's line feed is dropped, one inside quotes stays.
``position`` (file, chunk, number) sorts the records as they stand in the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: From inside a quoted value to its closing quote (a doubled quote is one in the value).
_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
COMPLETE, EDGE = 0, 1


def open_at_end(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line, given whether one is at its start."""
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            close = _CLOSE.match(line, at)
            if close is None:
                return True
            inside, at = False, close.end()
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk")))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The lines of each chunk in a batch."""
    files, chunks = batch.column(1), batch.column(2).to_numpy()
    number = files.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(chunks) != 0)) + 1
    for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
        if e > s:
            yield files[int(s)].as_py(), int(chunks[s]), batch.column(0).slice(int(s), int(e - s))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: the state at the end from either state at the start, and whether any line
    leaves a value open."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, chunk, lines in _runs(batch):
            state = found.setdefault((file, chunk), [False, True, False])
            quoted = pc.filter(lines, pc.match_substring(lines, '"')).to_pylist()
            for line in quoted:
                state[2] = state[2] or open_at_end(line, False)
                same, state[0] = state[0] == state[1], open_at_end(line, state[0])
                state[1] = state[0] if same else open_at_end(line, state[1])
    rows = [(f, c, *s) for (f, c), s in found.items()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "chunk", "out", "in", "any"])


def chunk_states(lines: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], bool]:
    """Per file the sorted chunks with whether each starts inside a quoted value, and whether any
    line of the input leaves a value open."""
    table = lines.mapInArrow(_effects, "file string, chunk long, out boolean, in boolean, any boolean").toArrow()
    by_file: dict[str, list] = {}
    for file, chunk, after_out, after_in in zip(*(table[c].to_pylist() for c in ("file", "chunk", "out", "in"))):
        by_file.setdefault(file, []).append((chunk, after_out, after_in))
    states = {}
    for file, chunks in by_file.items():
        chunks.sort()
        inside, starts = False, []
        for _, after_out, after_in in chunks:              # the prefix scan
            starts.append(inside)
            inside = after_in if inside else after_out
        states[file] = np.array([c for c, *_ in chunks], np.int64), np.array(starts, bool)
    return states, any(table["any"].to_pylist())


def _records(shared):
    """Cuts each chunk into records from its known state."""
    kinds = pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("number", pa.int64()), ("kind", pa.int32()),
                       ("begins", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, at, inside, number, begins, part = shared.value, None, False, 0, True, []

        def rows(out: list) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

        for batch in batches:
            out = []
            for file, chunk, lines in _runs(batch):
                if at != (file, chunk):
                    if part:                               # the chunk before ends inside a record
                        out.append((*at, number, EDGE, begins, "\n".join(part)))
                    at, number, part = (file, chunk), 0, []
                    starts = states[file]
                    inside = bool(starts[1][np.searchsorted(starts[0], chunk)])
                    begins = not inside                    # else these lines belong to an earlier record
                has = pc.match_substring(lines, '"').to_pylist()
                for line, quoted in zip(lines.to_pylist(), has):
                    after = open_at_end(line, inside) if quoted else inside
                    if after:
                        part.append(line)
                    else:
                        text = "\n".join([*part, line]) if part else line
                        out.append((file, chunk, number, COMPLETE if begins else EDGE, begins, text.removesuffix("\r")))
                        number, begins, part = number + 1, True, []
                    inside = after
            if out:
                yield rows(out)
        if part:
            yield rows([(*at, number, EDGE, begins, "\n".join(part))])
    return run


def records(spark: SparkSession, path: str, needed: bool = True) -> DataFrame | None:
    """``position, record``: every record of the files, headers and empty lines left out. ``None`` if
    not ``needed`` and no quoted value holds a line feed."""
    lines = _lines(spark, path)
    states, any_open = chunk_states(lines)
    if not any_open and not needed:
        return None
    cut = lines.mapInArrow(_records(spark.sparkContext.broadcast(states)),
                           "file string, chunk long, number long, kind int, begins boolean, record string")
    whole = cut.filter(F.col("kind") == COMPLETE).select("file", "chunk", "number", "record")
    order = Window.partitionBy("file").orderBy("chunk", "number")         # at most two rows per chunk
    edges = (cut.filter(F.col("kind") == EDGE)
             .withColumn("which", F.sum(F.col("begins").cast("long")).over(order))
             .groupBy("file", "which")
             .agg(F.array_sort(F.collect_list(F.struct("chunk", "number", "record"))).alias("parts"))
             .select("file", F.col("parts")[0]["chunk"].alias("chunk"), F.col("parts")[0]["number"].alias("number"),
                     F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    header = (F.col("chunk") == 0) & (F.col("number") == 0)
    return (whole.unionByName(edges).filter(~header & (F.col("record") != ""))
            .select(F.struct("file", "chunk", "number").alias("position"), "record"))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files of a known schema, every file read by as many tasks as it has ranges."""
    found = records(spark, path, needed=False)
    if found is None:
        return spark.read.schema(schema).options(header=True, **OPTIONS).csv(path)
    return parsed(found, schema).select("row.*")


def parsed(found: DataFrame, schema: T.StructType) -> DataFrame:
    """``position, row``."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return found.select("position", F.from_csv("record", ddl, {**OPTIONS, "multiLine": "true"}).alias("row"))
