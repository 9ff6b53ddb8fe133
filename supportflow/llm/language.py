"""Language identification: sparse multinomial logistic regression over TF-IDF character
n-grams, trained with follow-the-regularised-leader and an elastic net, then calibrated.

Characters are code points, lower-cased one by one; n-grams of 1 to ``ORDERS`` characters are
hashed to ``BUCKETS``. A text's vector is ``(1 + ln count) * idf`` per bucket, at unit length,
over the whole text. Document frequencies cover every training document: each task sums its
own and only one row per bucket and task is shuffled.

The classifier is fitted on at most ``max_docs`` labelled training documents, shared out evenly
over all languages, or ``MIN_DOCS`` of each if that is more: the distinct texts with the
smallest hashes, so that reruns agree and copies of a text are one. A fifth of them is held back
to choose the temperature that scales the logits; the score is the calibrated probability of the
predicted language. A probability says nothing about a language that was not learned: ``known``
is the share of a text's letter trigrams that occur in at least two fitted documents, and a text
is ``familiar`` if that share is not below ``bound``, by more than chance allows for its length.
``bound`` is set on the held-back rows (``MARGIN`` of their lowest hundredth), whatever the
number of languages. The model holds ``BUCKETS`` weights per language and ``2**GRAM_BITS`` bits.

Defined results: a text that is null or has no letter (``str.isalpha``) is ``und`` with score
0, as is every text when nothing could be learned; null languages are never learned; repeated
rows are scored row by row; a text without letters is not familiar, one too short for a trigram
is; extra columns pass through, and one named like a result raises unless ``prefix`` sets it
apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportflow.llm.common import in_batches, prepare, small_side

ORDERS = 3
BITS = 15
BUCKETS = 1 << BITS
MAX_DOCS, MIN_DOCS = 4_000, 20
PIECE = 1 << 20
GRAM_BITS = 24
#: Trigrams of a held-back row that counts for the bound.
LONG = 50
#: The bound as a part of the held-back rows' lowest hundredth: texts of few, repeated words lie
#: up to a tenth below it.
MARGIN = 0.85

_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000 and len(_l := chr(_c).lower()) == 1:
        _LOWER[_c] = ord(_l)


def hashed_grams(text: str) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 1 << 16, _LOWER[np.minimum(c, 0xFFFF)], c)
    h, out = np.full(len(c), 2166136261, np.uint32), []
    for k in range(min(ORDERS, len(c))):
        h = (h[:len(c) - k] ^ c[k:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def all_counts(texts: list[str]):
    """``(buckets, counts)`` of each whole text. Short neighbours are hashed together (an
    n-gram that would leave its text is not counted); a text over ``PIECE`` characters is
    hashed in pieces that overlap by ``ORDERS - 1`` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
            size += len(texts[j])
            j += 1
        if size <= PIECE:
            grams, s = hashed_grams("".join(texts[i:j])), 0
            for t in texts[i:j]:
                e = s + len(t)
                own = [g[s:max(s, e - k)] for k, g in enumerate(grams)]
                yield _totals(np.bincount(np.concatenate(own), minlength=BUCKETS) if own else np.zeros(0))
                s = e
        else:
            total, t = np.zeros(BUCKETS, np.int64), texts[i]
            for s in range(0, len(t), PIECE):
                for k, g in enumerate(hashed_grams(t[s:s + PIECE + ORDERS - 1])):
                    total += np.bincount(g[:PIECE], minlength=BUCKETS)
            yield _totals(total)
        i = j


def _totals(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(total)
    return at, total[at]


_LETTER = np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    _LETTER[_c] = not 0xD800 <= _c < 0xE000 and chr(_c).isalpha()


def letter_grams(text: str) -> np.ndarray:
    """Hashes (``GRAM_BITS`` bits) of the windows of three characters, two or more of them
    letters, of the lower-cased text in which everything else is one space."""
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(c, 0xFFFF)
    letter = (c > 0xFFFF) | _LETTER[low]
    c = np.where(letter, np.where(c <= 0xFFFF, _LOWER[low], c), 0x20)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]                                  # the first of several spaces
    c, letter = c[keep], letter[keep]
    if len(c) < 3:
        return np.zeros(0, np.uint32)
    h = c[:-2] * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13)) ^ c[1:-1]) * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(16)) ^ c[2:]) * np.uint32(0x27D4EB2F)
    return (h ^ (h >> np.uint32(15)))[letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2] >> np.uint32(32 - GRAM_BITS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents with a letter, and in how many of them each bucket occurs."""
    def run(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            texts = list(filter(has_letter, b.column(0).to_pylist()))
            total[BUCKETS] += len(texts)
            for at, _ in all_counts(texts):
                total[at] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = (docs.select(F.col(text_col)).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())      # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return int(df[-1]), df[:-1]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    grams: np.ndarray                                        # packed bits of the known trigrams
    bound: float = 0.0

    def known(self, text: str) -> tuple[int, int]:
        """Known trigrams and all of them, whole text."""
        known = total = 0
        for s in range(0, len(text), PIECE):
            g = letter_grams(text[s:s + PIECE])
            known += int((self.grams[g >> np.uint32(3)] >> (g & np.uint32(7)).astype(np.uint8) & 1).sum())
            total += len(g)
        return known, total

    def familiar(self, known: int, total: int) -> bool:
        """Not below the bound by more than three standard deviations."""
        return known >= total * self.bound - 3 * np.sqrt(total * self.bound * (1 - self.bound))

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[at]
        return v / max(np.sqrt(v @ v), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """``lang_pred, score, known, familiar`` of each text."""
        out = [("und", 0.0, 0.0, False)] * len(texts)
        at = [i for i, t in enumerate(texts) if self.classes and has_letter(t)]
        for i, grams in zip(at, all_counts([texts[i] for i in at])):
            z = self.logits(*grams) / self.temperature
            p = np.exp(z - z.max())
            k = int(np.argmax(p))
            known, total = self.known(texts[i])
            out[i] = self.classes[k], float(p[k] / p.sum()), known / max(total, 1), bool(self.familiar(known, total))
        return out


def fit_ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 1.0,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3,
             seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net; returns weights (bucket x class) and the bias."""
    z, g2 = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    zb, gb = np.zeros(classes), np.zeros(classes)

    def solve(z, g2, lasso):
        return np.where(np.abs(z) <= lasso, 0.0, (np.sign(z) * lasso - z) / ((beta + np.sqrt(g2)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, v = vectors[i]
            w, b = solve(z[at], g2[at], l1), solve(zb, gb, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / alpha * w
            g2[at] = new
            nb = gb + p * p
            zb += p - (np.sqrt(nb) - np.sqrt(gb)) / alpha * b
            gb = nb
    return solve(z, g2, l1), solve(zb, gb, 0.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 80))

    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()
    return float(min(grid, key=loss))


def _sample(rows: DataFrame, max_docs: int) -> DataFrame:
    """``t, l, back``: the distinct texts with the smallest hashes of each language, every fifth
    held back. A first cut by a rate of the (estimated) distinct texts, so that copies neither
    crowd out a language nor reach one task; then the exact one."""
    labelled = rows.filter(F.col("l").isNotNull()).withColumn("h", F.xxhash64(F.lit(5), "t").bitwiseAND((1 << 62) - 1))
    per = labelled.groupBy("l").agg(F.approx_count_distinct("h").alias("texts"))
    share = F.greatest(F.lit(MIN_DOCS), F.floor(F.lit(max_docs) / F.greatest(F.lit(1), F.lit(per.count()))))
    rate = per.select(F.col("l").alias("r_l"), share.alias("share"), (share * 2.0 / F.col("texts") * 2.0 ** 62).alias("below"))
    first = (labelled.join(small_side(rate), F.col("l") == F.col("r_l")).filter(F.col("h") <= F.col("below"))
             .groupBy("l", "t", "h", "share").agg(F.lit(1).alias("one")))
    order = Window.partitionBy("l").orderBy("h", "t")        # about twice the share of rows
    return first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("share")).select("t", "l", (F.col("k") % 5 == 0).alias("back"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """The model learned from the rows of ``docs`` (give only rows that may be learned from)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    n_docs, df = document_frequencies(rows, "t")
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    def make():
        def run(batch):
            own = [x for x in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(x[0])]
            out = []
            for (t, l, back), (at, n) in zip(own, all_counts([x[0] for x in own])):
                g = letter_grams(t)
                out.append((l, back, at.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes(),
                            (g if back else np.unique(g)).tobytes()))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["l", "back", "at", "n", "g"])
        return run
    # at most max_docs rows (or MIN_DOCS of each language), the numbers of whole texts
    sample = in_batches(_sample(rows.filter(F.col("t").isNotNull()), max_docs), make,
                        "l string, back boolean, at binary, n binary, g binary").collect()
    sample = sorted((r["l"], r["back"], *map(bytes, (r["at"], r["n"], r["g"]))) for r in sample)
    classes = sorted({r[0] for r in sample})
    none = np.zeros(1 << GRAM_BITS - 3, np.uint8)
    if not sample:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, none)
    draft = Model(classes, idf, np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), 1.0, none)
    pairs = [(np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.uint32)) for r in sample]
    vectors = [(at, draft.vector(at, n)) for at, n in pairs]
    number = {c: k for k, c in enumerate(classes)}
    y = np.array([number[s[0]] for s in sample])
    back = np.array([r[1] for r in sample])
    fit_on = np.flatnonzero(~back) if not back.all() else np.arange(len(y))
    w, b = fit_ftrl([vectors[i] for i in fit_on], y[fit_on], len(classes))
    held = np.flatnonzero(back)
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] + b for i in held]).reshape(len(held), len(classes))
    seen = np.zeros(1 << GRAM_BITS, np.uint8)
    for i in fit_on:
        g = np.frombuffer(sample[i][4], np.uint32)
        seen[g] = np.minimum(seen[g] + 1, 2)
    model = Model(classes, idf, w.astype(np.float32), b, best_temperature(logits, y[held]),
                  np.packbits(seen >= 2, bitorder="little"))
    shares = [(seen[g] >= 2).mean() for g in (np.frombuffer(sample[i][4], np.uint32) for i in held) if len(g) >= LONG]
    model.bound = float(np.quantile(shares, 0.01)) * MARGIN if len(shares) >= 20 else 0.0
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "",
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``lang_pred``, ``score``, ``known`` and ``familiar``,
    named after ``prefix``."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    added = [prefix + c for c in ("lang_pred", "score", "known", "familiar")]
    if clash := set(added) & set(keep):
        raise ValueError(f"columns {sorted(clash)} exist; set prefix")
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields[:-1])]
                          + [T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType()),
                             T.StructField("k", T.DoubleType()), T.StructField("f", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema.fields]

    def make():
        m = shared.value

        def run(batch):
            got = m.predict(batch.column(batch.num_columns - 1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array([g[i] for g in got], t) for i, t in enumerate(
                    (pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=names)
        return run
    return in_batches(rows, make, schema).toDF(*keep, *added)


def is_held_out(doc_id: Column) -> Column:
    """Fold 2 of 4 by the CRC-32 of the id as text; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
