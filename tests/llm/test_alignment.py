"""Alignment against whole texts encoded directly and links counted one by one."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import DOCS, docs, prose, wide
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from supportflow.llm import alignment

A_PATH, B_PATH = alignment.vocabularies()
ODD = ["  two  spaces ", "tail ", " head", "\n", "a\n b \tc", "\x00a b", "ﬁ ﬂ", "▁a b", "a▁ b", "x ▁ y", "<s> </s> <unk>",
       "<|endoftext|> and more", "é é", "　x y", "a b c", "日本語 テキスト", "🙂 🙃🙂", "a\x1c b\x85 c", "it's we'll 12 345",
       " ", "   ", "a" * 5000 + " b", "\r\n x\r\n\r\n y", "<0x41> b", "a  b c", "​ z"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    # the published byte-to-character rule, inverted
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in own}
    for b_ in range(256):
        if b_ not in chars:
            chars[b_] = chr(256 + len(chars) - len(own))
    back = {c: k for k, c in chars.items()}
    names = {i: t for t, i in a.get_vocab(True).items()}

    def tokens(text):
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(back[c] for c in names[i]) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return None
        return list(zip(ia, np.cumsum(list(map(len, ba))).tolist())), list(zip(ib, np.cumsum(list(map(len, bb))).tolist()))
    return tokens


def brute(rows, tokens):
    parts = [(k, tokens(t)) for k, t in rows]
    links, count = [], Counter()
    for k, x in parts:
        ends = {} if x is None else {e: i for i, e in x[0]}
        links.append([] if x is None else [(ends[e], j) for j, e in x[1] if e in ends])
        count.update(links[-1])
    most = Counter()
    for (_, j), c in count.items():
        most[j] = max(most[j], c)
    out = []
    for (k, x), own in zip(parts, links):
        if x is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({e for _, e in x[0]} & {e for _, e in x[1]})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, e in x[0] if low < e <= high) + "|" + ",".join(str(j) for j, e in x[1] if low < e <= high))
            low = high
        out.append((k, len(x[0]), len(x[1]), len(groups), len(own), sum(count[p] == most[p[1]] for p in own),
                    sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    docs_of = Counter(p for own in links for p in set(own))
    return out, {p: (docs_of[p], c, c == most[p[1]]) for p, c in count.items()}


def aligned(df):
    return sorted(map(tuple, alignment.align(df, A_PATH, B_PATH).collect()), key=str)


@pytest.mark.parametrize("limits", [(1 << 13, 1 << 24, 400_000, 1 << 20), (7, 3000, 50, 500)], ids=["large", "small"])
def test_whole_texts_encoded_directly(spark, monkeypatch, tools, limits):
    for name, value in zip(("DOCS", "CHARS", "PIECES", "STEP"), limits):
        monkeypatch.setattr(alignment, name, value)
    rows = list(enumerate(ODD + prose(120, seed=4, words=60) + ["the " * 700, None, ""] + ODD[:5]))
    want, pairs = brute(rows, tools)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert aligned(d) == sorted(want, key=str)
    counted = alignment.pair_counts(alignment.postings(d, A_PATH, B_PATH)).collect()
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in counted} == pairs


def test_given_documents(spark, tools):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    from supportflow.llm.queries import queries
    out = queries()["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, tools)[0])


def test_awkward_rows_and_clashing_columns(spark, tools):
    want = sorted(brute([(r[0], r[1]) for r in DOCS], tools)[0], key=str)
    assert aligned(docs(spark)) == want
    clashing = wide(spark).withColumns({c: F.lit("x") for c in ("a", "b", "container", "ordinal", "docs", "n_docs", "count", "best")})
    assert aligned(clashing) == want
    assert aligned(docs(spark, [])) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3000)), max_size=200), st.integers(3001, 5000))
def test_bitmaps_round_trip(bits, n_docs):
    bits = sorted(set(bits))
    group, doc = (np.array([b[i] for b in bits], np.int64) for i in (0, 1))
    made = alignment.bitmaps(group, doc, 7, n_docs)
    assert sorted(zip(*map(np.ndarray.tolist, alignment.members(made)))) == bits
    assert sorted(zip(*map(np.ndarray.tolist, alignment.members(made.slice(2))))) == [(g - 2, d) for g, d in bits if g >= 2]
    assert all(len(x) <= 1 + (n_docs + 7) // 8 for x in made.to_pylist())


def test_dense_bitmaps():
    doc = np.arange(0, 4000, 2)
    made = alignment.bitmaps(np.zeros(2000, np.int64), doc, 2, 4000)
    assert [len(x) for x in made.to_pylist()] == [501, 1]
    assert alignment.members(pa.array(made.to_pylist(), pa.binary()))[1].tolist() == doc.tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.'1 \n▁\t日", max_size=40))
def test_pieces_are_the_texts_tokens(text):
    if text:
        p = test_pieces_are_the_texts_tokens.pieces
        ids = p.entries([text])[0]
        whole = (p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text))
        ok = b"".join(p.a_bytes[i] for i in whole[0]) == (" " + text).encode() == b"".join(p.b_bytes[i] for i in whole[1])
        printed = alignment.groups(*whole, p.a_len, p.b_len)[1] if ok else ""
        assert ";".join(p.printed[i] for i in ids.tolist()) == printed
        assert sum(p.n_a[i] for i in ids.tolist()) == (len(whole[0]) if ok else 0)


test_pieces_are_the_texts_tokens.pieces = alignment.Pieces(open(A_PATH).read(), open(B_PATH, "rb").read())
