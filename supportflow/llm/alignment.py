"""Cross-tokenizer alignment: inverted bitmaps per pair of token ids.

Each text is encoded by two tokenizers. Where tokens of both end at one byte, the sequences are
cut into groups, and the two tokens that end there are linked. A pair of ids (of A and B) counts
as often as it is linked in the corpus.

1. One pass over the texts (``postings``). Documents are numbered inside a container, at most
   ``DOCS`` documents or ``CHARS`` characters. Per container and pair it writes the compressed
   bitmap of the documents that link the pair (batches are OR-merged into the container's), and
   multiplicity planes: plane ``k`` marks the documents whose number of further links has bit
   ``k``. The popcounts go along: ``n_docs`` of the bitmap, ``n_links`` of bitmap and planes.
   Beside them it writes a row per document. Both are written to the shared folder, so container
   numbers stay what they are.
2. ``pair_counts``: a document lies in one container, so the bitmaps of a pair are disjoint and
   its popcounts add up: ``n_docs`` and ``n_links`` over the corpus, and whether no other A id has
   more links with that B id.
3. ``align``: every posting fetches its pair's count (a shuffle join on the pair; a very common
   pair has one row per container, which AQE splits), goes back to its container, and the
   bitmaps and planes add the counts to their documents.

Encoding works on pieces: a text is cut at single spaces between two other characters. Tokens of
A never cross such a space (its pre-tokenizer takes the space with what follows) and B's pieces
hold a space only in front, which is checked when the vocabulary is loaded; so the pieces' tokens
are the text's, and each distinct piece is encoded once and kept (``PIECES`` at most, per worker).
A text whose pieces don't reproduce its bytes is encoded whole.

A bitmap is a byte 0 and two bytes per document, or a byte 1 and one bit per document, whichever
is shorter.

Defined results: a null or empty text, or one whose tokens' joined bytes differ from space + text,
has no tokens: zeros and ``groups_sha256 = ''``. Repeated rows are documents of their own, a null
id stays null, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportflow.llm.common import prepare, small_side, stored

DOCS, CHARS, PIECES, STEP = 1 << 13, 1 << 23, 400_000, 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")


# -- tokenizers and pieces (inside tasks) ---------------------------------------------------------

def byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves,
    the others follow from code point 256 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def groups(a_ids, b_ids, a_len, b_len) -> tuple[list[tuple[int, int]], str, int]:
    """``(links, printed groups, how many)`` of two token sequences over the same bytes."""
    links, out, i, j, ea, eb, si, sj = [], [], 0, 0, 0, 0, 0, 0
    while i < len(a_ids) and j < len(b_ids):
        la, lb = a_len[a_ids[i]], b_len[b_ids[j]]
        if ea + la < eb + lb:
            ea, i = ea + la, i + 1
        elif ea + la > eb + lb:
            eb, j = eb + lb, j + 1
        else:
            links.append((a_ids[i], b_ids[j]))
            ea, eb, i, j = ea + la, eb + lb, i + 1, j + 1
            out.append(",".join(map(str, a_ids[si:i])) + "|" + ",".join(map(str, b_ids[sj:j])))
            si, sj = i, j
    return links, ";".join(out), len(out)


class Pieces:
    """Both tokenizers, and the tokens, links and groups of the pieces met so far."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        table = byte_level()
        size = 1 + max(self.a.get_vocab(True).values())
        self.a_bytes = [bytes(table[c] for c in self.a.id_to_token(i) or "") for i in range(size)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.a_len, self.b_len = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.printed: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.ok = array("q"), array("q"), array("q"), array("b")
        self.links, self.first = array("q"), array("q", [0])

    def learn(self, texts: list[str]) -> None:
        """Adds texts (pieces or whole) as the next entries."""
        encoded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        for t, ea, ib in zip(texts, encoded, self.b.encode(texts, num_threads=1)):
            ia, whole = ea.ids, (" " + t).encode()
            ok = b"".join([self.a_bytes[i] for i in ia]) == whole == b"".join([self.b_bytes[i] for i in ib])
            links, printed, n = groups(ia, ib, self.a_len, self.b_len) if ok else ([], "", 0)
            self.printed.append(printed)
            self.n_a.append(len(ia) if ok else 0)
            self.n_b.append(len(ib) if ok else 0)
            self.n_groups.append(n)
            self.ok.append(ok)
            self.links.extend([x << 32 | y for x, y in links])
            self.first.append(len(self.links))

    def entries(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the entries whose tokens, in a row, are its own."""
        cut = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.index]
        for s in range(0, len(new), 20_000):
            known = len(self.printed)
            self.learn(new[s:s + 20_000])
            self.index.update(zip(new[s:s + 20_000], range(known, len(self.printed))))
        out = []
        for text, parts in zip(texts, cut):
            ids = np.array([self.index[p] for p in parts], np.int64)
            if len(ids) > 1 and not np.asarray(self.ok)[ids].all():
                self.learn([text])                         # an entry of its own, not kept by name
                ids = np.array([len(self.printed) - 1])
            out.append(ids)
        return out


# -- bitmaps (inside tasks) ------------------------------------------------------------------------

def bitmaps(group: np.ndarray, doc: np.ndarray, n_groups: int, n_docs: int) -> pa.BinaryArray:
    """The compressed bitmap of each group's documents; ``(group, doc)`` sorted and distinct."""
    n = np.bincount(group, minlength=n_groups)
    wide = (n_docs + 7) // 8
    dense = 2 * n > wide
    size = 1 + np.where(dense, wide, 2 * n)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    if offsets[-1] >= 2 ** 31:
        raise OverflowError("a container's bitmaps exceed 2 GB")
    data = np.zeros(int(offsets[-1]), np.uint8)
    data[offsets[:-1]] = dense
    first = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(len(doc)) - first[group]
    sparse = ~dense[group]
    at = offsets[group[sparse]] + 1 + 2 * within[sparse]
    data[at], data[at + 1] = doc[sparse] & 255, doc[sparse] >> 8
    for g in np.flatnonzero(dense):
        bits = np.zeros(8 * wide, np.uint8)
        bits[doc[first[g]:first[g + 1]]] = 1
        data[offsets[g] + 1:offsets[g + 1]] = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), n_groups, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, doc)`` of every bit set in a column of bitmaps."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)
    start, dense = offsets[:-1] + 1, data[offsets[:-1]] == 1
    n = np.where(dense, 0, (offsets[1:] - start) // 2)
    rows = np.repeat(np.arange(len(column)), n)
    at = start[rows] + 2 * (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))
    out = [(rows, data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8)]
    for r in np.flatnonzero(dense):
        set_bits = np.flatnonzero(np.unpackbits(data[start[r]:offsets[r + 1]], bitorder="little"))
        out.append((np.full(len(set_bits), r), set_bits))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def one(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


# -- 1: one pass over the texts ---------------------------------------------------------------------

POSTINGS = pa.schema([("container", pa.int64()), ("ordinal", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()),
                      ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                      ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary())),
                      ("n_docs", pa.int64())])
POSTINGS_DDL = ("container long, ordinal int, id long, n_a long, n_b long, n_groups long, n_links long, "
                "groups_sha256 string, a int, b int, docs binary, planes array<binary>, n_docs long")


def _batches(n: int, **columns) -> Iterator[pa.RecordBatch]:
    made = pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in POSTINGS], schema=POSTINGS)
    yield from made.to_batches(max_chunksize=20_000)


def container_rows(container: int, ids: list, entries: list[np.ndarray], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    """The document rows and the postings of one container."""
    n = len(ids)
    links, first = np.asarray(pieces.links), np.asarray(pieces.first)
    entry = np.concatenate([*entries, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(n), [len(e) for e in entries])
    total = lambda values: np.bincount(doc, np.asarray(values)[entry], n).astype(np.int64)     # noqa: E731
    per_link = np.bincount(doc, np.diff(first)[entry], n).astype(np.int64)
    n_a = total(pieces.n_a)
    printed = [hashlib.sha256(";".join([pieces.printed[i] for i in e.tolist()]).encode()).hexdigest() if k else ""
               for e, k in zip(entries, n_a.tolist())]
    yield from _batches(n, container=pa.array(np.full(n, container)), ordinal=pa.array(np.arange(n, dtype=np.int32)),
                        id=pa.array(ids, pa.int64()), n_a=pa.array(n_a), n_b=pa.array(total(pieces.n_b)),
                        n_groups=pa.array(total(pieces.n_groups)), n_links=pa.array(per_link),
                        groups_sha256=pa.array(printed, pa.string()))

    key, times = np.unique(doc * len(pieces.printed) + entry, return_counts=True)      # entries of a document, once
    doc, entry = key // len(pieces.printed), key % len(pieces.printed)
    width = first[entry + 1] - first[entry]
    at = np.repeat(first[entry], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    pairs, pair = np.unique(links[at], return_inverse=True)
    key = pair * n + np.repeat(doc, width)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return
    count = np.add.reduceat(np.repeat(times, width)[order], heads)
    pair, doc = key[heads] // n, key[heads] % n
    plane_of, further = [], count - 1
    for k in range(int(further.max()).bit_length()):
        with_bit = np.flatnonzero(further >> k & 1)
        plane_of.append((pair[with_bit], np.full(len(with_bit), k), doc[with_bit]))
    p, k, d = (np.concatenate([x[i] for x in plane_of] or [np.zeros(0, np.int64)]) for i in range(3))
    order = np.lexsort((d, k, p))
    slots, slot = np.unique(p[order] * 64 + k[order], return_inverse=True)
    highest = np.zeros(len(pairs), np.int64)                                           # planes up to the highest
    np.maximum.at(highest, slots // 64, slots % 64 + 1)
    offsets = np.concatenate([[0], np.cumsum(highest)])
    place = (offsets[slots // 64] + slots % 64)[slot]
    planes = bitmaps(place, d[order], int(offsets[-1]), n)
    yield from _batches(len(pairs), container=pa.array(np.full(len(pairs), container)),
                        a=pa.array((pairs >> 32).astype(np.int32)), b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                        docs=bitmaps(pair, doc, len(pairs), n),
                        planes=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), planes),
                        n_docs=pa.array(np.bincount(pair, minlength=len(pairs))),
                        n_links=pa.array(np.bincount(pair, count, len(pairs)).astype(np.int64)))


_LOADED: dict = {}


def _pieces(key: str, a_json: bytes, b_model: bytes) -> Pieces:
    """The worker's tokenizers, kept from task to task."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(a_json.decode(), b_model)
    return _LOADED[key]


def postings(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document rows (``ordinal`` not null) and posting rows (``a`` not null), written once."""
    prepare(docs.sparkSession)
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        files = fa.read(), fb.read()                       # vocabularies, a few MB; tasks get their bytes
    json.loads(files[0])
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(files)
    limits = DOCS, CHARS, PIECES, STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        most_docs, most_chars, most_pieces, step = limits
        pieces, container = _pieces(name, *sent.value), TaskContext.get().partitionId() << 32
        ids, entries, chars = [], [], 0
        for batch in batches:
            texts, keys, s = batch.column(1).to_pylist(), batch.column(0).to_pylist(), 0
            while s < len(texts):
                e, block = s, 0
                while e < len(texts) and e - s < most_docs - len(ids) and (e == s or block < step):
                    block, e = block + len(texts[e] or ""), e + 1
                ids += keys[s:e]
                entries += pieces.entries(texts[s:e])
                chars, s = chars + block, e
                if len(ids) >= most_docs or chars >= most_chars:
                    yield from container_rows(container, ids, entries, pieces)
                    ids, entries, chars, container = [], [], 0, container + 1
                    if len(pieces.printed) > most_pieces:
                        pieces.forget()
        if ids:
            yield from container_rows(container, ids, entries, pieces)
        if len(pieces.printed) > most_pieces:
            pieces.forget()
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(narrow.mapInArrow(run, POSTINGS_DDL), "postings")


# -- 2: counts of pairs ------------------------------------------------------------------------------

def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links, best``: documents and links of each pair of ids; ``best`` if no
    other A id has more links with that B id."""
    pairs = stored(found.filter(F.col("a").isNotNull()).groupBy("a", "b")
                   .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pairs")
    most = small_side(pairs.groupBy(F.col("b").alias("m_b")).agg(F.max("n_links").alias("most")))   # B's vocabulary at most
    return (pairs.join(most, F.col("b") == F.col("m_b"))
            .select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best")))


# -- 3: counts back to the documents -------------------------------------------------------------------

SCORED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(key, docs: pa.Table, posting: pa.Table) -> pa.Table:
    n = docs.num_rows
    at = one(docs["ordinal"]).to_numpy()
    size = int(at.max()) + 1 if n else 0
    sums = np.zeros((2, size), np.int64)
    if posting.num_rows:
        count = one(posting["count"]).to_numpy()
        best = one(posting["best"]).to_numpy(zero_copy_only=False).astype(np.int64)
        row, doc = members(one(posting["docs"]))
        np.add.at(sums[0], doc, count[row])
        np.add.at(sums[1], doc, best[row])
        lists = one(posting["planes"])
        planes = lists.flatten()
        width = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(width)), width)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        row, doc = members(planes)
        np.add.at(sums[0], doc, count[owner[row]] << level[row])
        np.add.at(sums[1], doc, best[owner[row]] << level[row])
    keep = {c: one(docs[c]) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**keep, "n_best": pa.array(sums[1][at]), "count_sum": pa.array(sums[0][at]),
                     "groups_sha256": one(docs["groups_sha256"])})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document."""
    found = postings(docs, a_path, b_path, id_col, text_col)
    pairs = pair_counts(found).select(F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("n_links").alias("count"), "best")
    posting = (found.filter(F.col("a").isNotNull()).select(F.col("container").alias("c"), "a", "b", "docs", "planes")
               .join(pairs, (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")))
               .select("c", "docs", "planes", "count", "best"))
    rows = found.filter(F.col("ordinal").isNotNull()).select(
        "container", "ordinal", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.groupBy("container").cogroup(posting.groupBy("c")).applyInArrow(_score, SCORED)


def vocabularies(folder: str = "/opt/tokenizers") -> tuple[str, str]:
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"
