"""Personal data: fixed patterns, plus information-theoretic sanitisation of the terms that
give a protected entity away.

**Base spans**, leftmost and non-overlapping per kind, failing matches dropped without a retry:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip (four dotted numbers, each at
most 255); card (13 to 19 digits, single spaces or hyphens between, passing Luhn); phone (``+``,
9 to 15 digits). Offsets are code points, end exclusive.

**Disclosed terms.** The protected entities are the base values (normalised) that occur in at
least ``support`` distinct texts, and for every rarer value the narrowest of its classes that
does: the mail domain, the /24 network, the first six digits of a card or five of a phone, then
the whole kind (``email:*@host``, ``ip:1.2.3.*``, ``card:411111*``, ``phone:15551*``,
``email:*``). For a term ``t`` and an entity ``e`` of the same document the
corpus gives ``PMI = ln(N * n(t, e) / (n(t) * n(e)))``, and ``ln(N / n(e))`` is all that could be
learned about ``e``. Their quotient, the share of the entity's information that the term
discloses, is compared with two thresholds: from ``generalise_at`` a term is replaced by its
class, from ``remove_at`` it is cut. A pair counts only if the term was seen with that entity in
at least ``support`` distinct texts, so that copies of one text prove nothing. Terms are
sanitised in the documents that hold the entity, or any value of a protected class; a document
without personal data stays as it is. A value whose whole kind is in fewer than ``support``
texts has no estimate.

**Secrets** (kind ``secret``, spans beside the base ones): the value that a name such as token,
password or api key assigns (8 characters or more, with a digit), private key headers, and keys
of a known form (``AKIA...``, ``ghp_...``).

Plan. One pass over whole texts writes those that hold a base span; entities, candidate words
and pairs read these alone, a second pass over all texts counts the candidate words, a third
writes the spans. What is shuffled is pre-aggregated per task and pruned without changing the
result: ``disclosed >= a`` is ``n(t) <= n(t, e) * (N / n(e))**(1 - a)``, and ``n(t, e) <= n(e)``,
so a pair needs ``n(t) <= n(e)**a * N**(1 - a)``; and a word in fewer than ``support`` of the
written texts can't have a pair with support. Pairs outside both bounds are never emitted, the
others as three 64-bit numbers; strings are fetched for the disclosed pairs only. Sent to the
tasks: one byte per slot of a hash table sized from a count (at most ``2**MOST_BITS`` slots;
words or entities that share one only let more pairs through, which the joins remove), and a
disclosure table of at most ``block_rows`` rows. A larger one is dealt into blocks, each with a
plan and a written result of its own, merged by the text's hash.

Defined results: null texts are empty and have no spans; the statistics count rows, so a
repeated row counts again; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm import textkit as K
from supportflow.llm.common import in_batches, prepare, stored

KINDS = ["email", "ip", "card", "phone"]
TERM, SECRET = "term", "secret"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", SECRET: "[SECRET]"}
SUPPORT = 3
GENERALISE_AT, REMOVE_AT = 0.7, 0.95
MOST_BITS, LEVELS = 24, 8
BLOCK_ROWS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")     # a later start in a digit run can't match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SECRET = re.compile(
    r"(?i:\b(?:api|access|secret|private|auth|client)?[_ -]?(?:key|token|secret|password|passwd|pwd)\b)[\"']?[ \t]*[:=][ \t]*[\"']?"
    r"(?P<v>(?=[^\s\"'<>,;0-9]{0,200}[0-9])[^\s\"'<>,;]{8,})"
    r"|(?P<k>-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b)")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MARK = np.isin(np.arange(256), np.frombuffer(b"0123456789@", np.uint8))


def emails(text: str) -> list[tuple[int, int]]:
    """Every ``@`` has one possible match: the run of local characters before it, as far as it
    is free, and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [(SECRET, *m.span("v" if m["v"] else "k")) for m in _SECRET.finditer(text)]


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.translate(_AZ)}" if kind in ("email", "ip") else f"{kind}:{_digits(value)}"


def classes(name: str) -> list[str]:
    """The classes of an entity, narrowest first; ``*`` is in no value."""
    kind, value = name.split(":", 1)
    inner = {"email": lambda: "*@" + value.rsplit("@", 1)[1], "ip": lambda: value.rsplit(".", 1)[0] + ".*",
             "card": lambda: value[:6] + "*", "phone": lambda: value[:5] + "*"}[kind]()
    return [f"{kind}:{inner}", f"{kind}:*"]


def own_keys(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The entities of a text and all their classes."""
    own = {entity(k, text[s:e]) for k, s, e in spans}
    return sorted(own.union(*map(classes, own)))


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def marked(column: pa.Array) -> list[tuple[int, str]]:
    """Rows whose text has a digit or ``@``: no other can hold a base span."""
    data, offsets = K.text_bytes(column)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MARK[data], out=total[1:])
    rows = np.flatnonzero(np.diff(total[offsets]))
    return [(int(i), t) for i, t in zip(rows, column.take(pa.array(rows)).to_pylist())]


def outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of the words that no base span touches."""
    taken = sorted((s, e) for _, s, e in spans)
    out, k, reach = [], 0, -1
    for m in _WORD.finditer(text.translate(_AZ)):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            out.append((m[0], *m.span()))
    return out


def hash64(values: list[str]) -> np.ndarray:
    """The hash that ``K.Words`` gives to each word."""
    data, offsets = K.text_bytes(pa.array(values, pa.string()))
    w = K.Words(data, offsets, np.ones(256, bool), lower=False)
    return w.hashes().view(np.int64)


def slot_bytes(rows: DataFrame, column: str, byte: str, n: int) -> np.ndarray:
    """A byte per slot, the bits of ``byte`` of all rows whose ``column`` falls into it, with about
    eight slots for each of ``n`` rows; gathered as one long per eight slots (at most
    ``2**MOST_BITS / 8``, whatever the input)."""
    bits = min(MOST_BITS, max(10, (8 * n).bit_length()))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (rows.select(F.shiftright(low, 3).cast("int").alias("w"),
                         F.expr(f"shiftleft(cast({byte} as bigint), int({column} & 7) * 8)").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    out = np.zeros(1 << bits - 3, np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return out.view(np.uint8)


def at_slots(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[hashes.astype(np.int64) & (len(table) - 1)]


def holders(texts: DataFrame) -> DataFrame:
    """``t, x``: the texts that hold a base span, with their hash; written once."""
    def make():
        def run(batch):
            found = [t for _, t in marked(batch.column(0)) if base_spans(t)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(list(map(text_hash, found)), pa.int64())],
                                              names=["t", "x"])
        return run
    return stored(in_batches(texts, make, "t string, x long"), "holders")


def _entities(held: DataFrame, support: int) -> DataFrame:
    """``entity, eh, n_e``: documents per protected entity, base value or class."""
    def make():
        def run(batch):
            out, own, wide, text = [], [], [], []
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = sorted({entity(k, t[s:e]) for k, s, e in base_spans(t)})
                rows = [(y, None, None) for y in sorted({y for n in names for y in classes(n)})]
                rows += [(n, *classes(n)) for n in names]
                for columns, values in zip((out, own, wide), zip(*rows)):
                    columns += values
                text += [x] * len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()), pa.array(own, pa.string()), pa.array(wide, pa.string()),
                 pa.array(hash64(out)), pa.array(text, pa.int64())], names=["entity", "inner", "kind", "eh", "x"])
        return run
    every = stored(in_batches(held, make, "entity string, inner string, kind string, eh long, x long")
                   .groupBy("entity", "inner", "kind", "eh", "x").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("entity", "inner", "kind", "eh").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")),
                   "values")
    often = every.filter(F.col("texts") >= support)
    rare = every.filter(F.col("inner").isNotNull() & (F.col("texts") < support))
    wanted = rare.select("inner", "kind").distinct()
    able = often.filter(F.col("inner").isNull()).select(F.col("entity").alias("able"))
    falls = (wanted.join(able, F.col("inner") == F.col("able"), "left")
             .select(F.coalesce("able", "kind").alias("entity")).distinct())
    return often.filter(F.col("inner").isNotNull()).unionByName(
        often.filter(F.col("inner").isNull()).join(falls, "entity", "left_semi")).select("entity", "eh", "n_e")


def _keys_and_words(t: str, entities: np.ndarray):
    """The protected keys of a text with their bytes, and its distinct words outside base spans,
    as hashes."""
    spans = base_spans(t)
    keys = hash64(own_keys(t, spans))
    masks = at_slots(entities, keys)
    words = sorted({w for w, _, _ in outside(t, spans)}) if masks.any() else []
    return keys[masks > 0], masks[masks > 0], words


def _summed(counts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts per hash, merged in a task while they are at most a million."""
    hashes, sums, size = [], [], 0
    for h, n in itertools.chain(counts, [(None, None)]):
        if h is not None:
            hashes.append(h.view(np.int64))
            sums.append(n)
            size += len(h)
        if size > 1_000_000 or h is None and size:
            u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(sums), len(u)).astype(np.int64)
            hashes, sums, size = [u], [n], len(u)
            if h is None or size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["h", "n"])
                hashes, sums, size = [], [], 0


def _candidates(held: DataFrame, entities, support: int) -> DataFrame:
    """``h``: words in at least ``support`` of the written texts that hold a protected key."""
    def run(batches):
        def counts():
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    h = hash64(_keys_and_words(t, entities.value)[2])
                    yield h, np.ones(len(h), np.int64)
        return _summed(counts())
    return (held.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= support).select("h"))


def _term_counts(texts: DataFrame, candidates) -> DataFrame:
    """``h, n_t``: documents per word hash, for hashes that share a slot with a candidate."""
    def run(batches):
        def counts():
            table = candidates.value
            for batch in batches:
                data, offsets = K.text_bytes(batch.column(0))
                for i, j in K.chunks(offsets):
                    w = K.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], K.ALNUM, lower=True)
                    h = w.hashes()
                    at = np.flatnonzero(at_slots(table, h))
                    u, inverse = np.unique(h[at], return_inverse=True)
                    pairs = np.unique(inverse * (j - i) + w.row[at])            # a word counts once per text
                    yield u, np.bincount(pairs // (j - i), minlength=len(u))
        return _summed(counts())
    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n_t"))


def _pairs(held: DataFrame, entities, words) -> DataFrame:
    """``eh, h, x``: hashes of protected entities, of the words of their documents, and of the
    text, for pairs within the bounds."""
    def make():
        def run(batch):
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, masks, own = _keys_and_words(t, entities.value)
                h = hash64(own)
                levels = at_slots(words.value, h)
                for key, mask in zip(keys, masks):
                    fit = h[(levels & mask) > 0]
                    for column, values in zip(out, (np.full(len(fit), key), fit, np.full(len(fit), x))):
                        column.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["eh", "h", "x"])
        return run
    return in_batches(held, make, "eh long, h long, x long")


def _names(held: DataFrame, wanted) -> DataFrame:
    """``h, term``: the words whose hash is wanted, as strings."""
    def make():
        def run(batch):
            words = sorted({w for t in batch.column(0).to_pylist() for w, _, _ in outside(t, base_spans(t))})
            h = hash64(words)
            at = np.flatnonzero(at_slots(wanted.value, h))
            return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array([words[i] for i in at], pa.string())], names=["h", "term"])
        return run
    return in_batches(held, make, "h long, term string").distinct()


def disclosures(docs: DataFrame, text_col: str = "text", support: int = SUPPORT,
                threshold: float = GENERALISE_AT) -> DataFrame:
    """``entity, term, n_e, n_t, n_te, texts, disclosed``: the pairs whose share of
    disclosed information reaches ``threshold``, over the whole corpus."""
    spark = docs.sparkSession
    prepare(spark)
    send = spark.sparkContext.broadcast
    texts = docs.select(F.col(text_col).alias("t"))
    n_docs = max(1, texts.count())
    n = F.lit(float(n_docs))
    held = holders(texts)
    # a word with more documents than this discloses too little about the entity, whatever their overlap
    most = F.when(F.col("n_e") < n, F.pow("n_e", F.lit(threshold)) * F.pow(n, F.lit(1 - threshold)) * (1 + 1e-9)).otherwise(0)
    known = stored(_entities(held, support).withColumn("most", most), "entities")
    size, bound = known.agg(F.count(F.lit(1)), F.max("most")).first()
    bound = max(float(bound or 0), support)
    steps = [support * (bound / support) ** (k / (LEVELS - 1)) for k in range(LEVELS)]
    steps[-1] = bound
    admitted = sum((F.when(F.col("most") > (steps[k - 1] if k else 0), F.lit(1 << k)).otherwise(0) for k in range(LEVELS)),
                   F.lit(0))
    entities = send(slot_bytes(known.withColumn("admitted", admitted), "eh", "admitted", size))
    able = stored(_candidates(held, entities, support), "candidates")
    n_able = able.count()
    counts = _term_counts(texts, send(slot_bytes(able.withColumn("one", F.lit(1)), "h", "one", n_able)))
    terms = stored(counts.filter((F.col("n_t") >= support) & (F.col("n_t") <= bound)).join(able, "h", "left_semi"), "terms")
    level = F.expr("CASE " + " ".join(f"WHEN n_t <= {s!r}D THEN {1 << k}" for k, s in enumerate(steps)) + " END")
    words = send(slot_bytes(terms.withColumn("level", level), "h", "level", n_able))
    pairs = (_pairs(held, entities, words).groupBy("eh", "h", "x").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("eh", "h").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts"))
             .filter(F.col("texts") >= support))
    share = F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))
    found = stored(pairs.join(known, "eh").join(terms, "h").withColumn("disclosed", F.when(F.col("n_e") < n, share))
                   .filter(F.col("disclosed") >= threshold), "disclosed")
    hashes = found.select("h", F.lit(1).alias("one")).distinct()
    names = _names(held, send(slot_bytes(hashes, "h", "one", hashes.count())))
    return found.join(names, "h").select("entity", "term", "n_e", "n_t", "n_te", "texts", "disclosed")


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sanitised(text: str, spans: list[tuple[str, int, int]], removed: set[tuple[int, int]]) -> str:
    """The text with each span replaced by its class, or cut; of overlapping spans the one
    that starts first (then the longer) stands for all."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], "" if (s, e) in removed else LABELS.get(k, "[TERM]")]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, found: DataFrame, text_col: str = "text", remove_at: float = REMOVE_AT,
         block_rows: int = BLOCK_ROWS, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (default: all) with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``n_secret``, ``base`` and ``spans`` (``kind:start:end`` comma-joined) and ``sanitised`` (the
    text). A ``keep`` column named like one of these raises unless ``prefix`` sets it apart."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    counted = [*KINDS, SECRET]
    added = [*[(f"n_{k}", T.LongType()) for k in counted], ("base", T.StringType()), ("spans", T.StringType()),
             ("sanitised", T.StringType())]
    if clash := {prefix + n for n, _ in added} & set(keep):
        raise ValueError(f"columns {sorted(clash)} exist; set prefix")
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    names = [f"c{i}" for i in range(len(keep) + 1)]
    rows, width = rows.toDF(*names), len(names)
    table = stored(found.select("entity", "term", (F.col("disclosed") >= remove_at).alias("r")), "disclosures")
    n = table.count()
    if n <= block_rows:
        terms = docs.sparkSession.sparkContext.broadcast(_by_entity(table))
    else:
        rows, terms = _with_terms(rows, table, -(-n // block_rows)), None
    last = T.StructType([*rows.schema.fields[:len(keep)], *(T.StructField(n, t) for n, t in added)])

    def make():
        def run(batch):
            n = batch.num_rows
            counts, base, spans = {k: [0] * n for k in counted}, [""] * n, [""] * n
            text = batch.column(width - 1)
            clean = text.to_pylist()
            more = None if terms else batch.column(width).to_pylist()
            for i, t in marked(text):
                own, secrets = base_spans(t), secret_spans(t)
                if not own and not secrets:
                    continue
                for k, _, _ in own + secrets:
                    counts[k][i] += 1
                at = disclosed(t, own, terms.value) if terms else {(m["s"], m["e"], m["r"]) for m in more[i] or []}
                removed = {(s, e) for s, e, r in at if r}
                every = own + secrets + [(TERM, s, e) for s, e in sorted({(s, e) for s, e, _ in at})]
                base[i], spans[i], clean[i] = span_text(own), span_text(every), sanitised(t, every, removed)
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array(counts[k], pa.int64()) for k in counted),
                 pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                names=[f.name for f in last.fields])
        return run
    return in_batches(rows, make, last).toDF(*keep, *[prefix + n for n, _ in added])


def _by_entity(table: DataFrame) -> dict[str, dict[str, bool]]:
    """A table of at most ``block_rows`` rows as ``entity -> term -> removed``."""
    out: dict[str, dict[str, bool]] = {}
    for e, t, r in table.collect():
        out.setdefault(e, {})[t] = r
    return out


def disclosed(text: str, spans: list[tuple[str, int, int]], by_entity: dict) -> set[tuple[int, int, bool]]:
    """``(start, end, removed)`` of the terms that the text's own keys disclose."""
    own: dict[str, bool] = {}
    for x in own_keys(text, spans) if spans else []:
        for term, r in by_entity.get(x, {}).items():
            own[term] = own.get(term, False) or r
    return {(s, e, own[w]) for w, s, e in outside(text, spans) if w in own} if own else set()


def _with_terms(rows: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``rows`` (text last) with the spans of all ``k`` blocks. A plan holds one block, whose
    narrow result is written; the results meet the rows by the text's hash. Rows without base
    spans get numbers of their own instead, so that they share no key."""
    spark = rows.sparkSession
    text = rows.columns[-1]
    held = holders(rows.select(F.col(text).alias("t"))).dropDuplicates(["x"])
    held, parts = stored(held, "holders"), []
    for b in range(k):
        block = spark.sparkContext.broadcast(_by_entity(table.filter(F.pmod(F.xxhash64("entity", "term"), F.lit(k)) == b)))

        def make(block=block):
            def run(batch):
                out = [(x, *m) for t, x in zip(*(c.to_pylist() for c in batch.columns))
                       for m in sorted(disclosed(t, base_spans(t), block.value))]
                columns = list(zip(*out)) if out else [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["x", "s", "e", "r"])
            return run
        parts.append(stored(in_batches(held, make, "x long, s int, e int, r boolean"), "block"))
        block.unpersist()
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = (merged.groupBy("x", "s", "e").agg(F.max("r").alias("r"))
              .groupBy("x").agg(F.collect_list(F.struct("s", "e", "r")).alias("more")))      # one text's words

    def hashed(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = np.arange(number, number + batch.num_rows, dtype=np.int64)
            number += batch.num_rows
            for i, t in marked(batch.column(len(batch.schema.names) - 1)):
                if base_spans(t):
                    x[i] = text_hash(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*batch.schema.names, "x"])
    keyed = rows.mapInArrow(hashed, T.StructType([*rows.schema.fields, T.StructField("x", T.LongType())]))
    return keyed.join(merged, "x", "left").select(*rows.columns, "more")


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
             remove_at: float = REMOVE_AT, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The whole operator: corpus statistics, then spans and sanitised texts of every row."""
    found = disclosures(docs, text_col, support, generalise_at)
    return find(docs, found, text_col, remove_at, keep=keep, prefix=prefix)
