"""Text scalars (H1-H16, H25, B6, B9) as native Column expressions.

All regexes are written so that the JVM (java.util.regex) and RE2 read them the same
way; ``supportflow.plans.sqlgen`` emits the matching SQL for the oracle.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as blanks.
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
            + "\u2028\u2029\u202f\u205f\u3000")         # the same, one by one
WORD = r"\p{L}\p{N}_"
STRIP_RE = f"^[{WS}]+|[{WS}]+$"
TOKEN_RE = f"[^{WS}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quote_re(term: str) -> str:
    """Literal text inside a regex, valid for both java.util.regex and RE2."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def py_strip(x) -> Column:
    """H2: strip like Python ``str.strip()`` (all Unicode blanks, not only spaces)."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def normalise(x, strip: bool = True) -> Column:
    """H1: null -> '', strip, lower case (K8/K9 use ``strip=False``)."""
    c = F.coalesce(_c(x), F.lit(""))
    return F.lower(py_strip(c) if strip else c)


def contains_any(x, terms: Iterable[str]) -> Column:
    """H3/H5: substring test against a list; OR of codegen'd ``contains``."""
    c = _c(x)
    out = None
    for t in terms:
        e = c.contains(F.lit(t))
        out = e if out is None else (out | e)
    return F.lit(False) if out is None else out


def count_terms(x, terms: Iterable[str]) -> Column:
    """H6: number of list terms that occur (each term counted once)."""
    c = _c(x)
    parts = [F.when(c.contains(F.lit(t)), 1).otherwise(0) for t in terms]
    if not parts:
        return F.lit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def word_regex(word: str) -> str:
    return f"(?<![{WORD}]){quote_re(word)}(?![{WORD}])"


def has_word(x, word: str) -> Column:
    """H4: whole-word match with Python's notion of a word character."""
    return _c(x).rlike(word_regex(word))


SCAN_FROM = 32                                     # terms from which groups are scanned, not each term
Group = Sequence[tuple[str, bool, int]]            # term, whole word, weight


def _occurs(texts: pa.Array, group: Group) -> np.ndarray:
    """Whether any term of the group occurs: one automaton (RE2), one pass over a text."""
    if len(group) == 1 and not group[0][1]:
        found = pc.match_substring(texts, group[0][0])
    else:
        found = pc.match_substring_regex(texts, "|".join(
            f"(?:^|[^{WORD}]){quote_re(t)}(?:$|[^{WORD}])" if whole else quote_re(t) for t, whole, _ in group))
    return found.fill_null(False).to_numpy(zero_copy_only=False)


def _weights(texts: pa.Array, group: Group) -> np.ndarray:
    """Per text the weights of the terms that occur. Halves of the group are tried only on texts
    where the whole matches, so a text costs as many passes as it has terms, times their depth."""
    total = np.zeros(len(texts), np.int32)
    at = np.flatnonzero(_occurs(texts, group)) if len(texts) and group else np.zeros(0, np.int64)
    if len(group) == 1:
        total[at] = group[0][2]
    elif len(at):
        some, half = texts.take(pa.array(at)), len(group) // 2
        total[at] = _weights(some, group[:half]) + _weights(some, group[half:])
    return total


def scan_terms(x, groups: dict[str, Group], sums: Collection[str] = ()) -> Column:
    """H3-H6 for long lists: a struct with an int per group of terms: the weights of those that
    occur, each counted once, for the groups in ``sums``; 1 or 0 (any or none) for the others. A
    text is read once per group, where a ``contains`` for every term would read it hundreds of times."""
    @F.arrow_udf(", ".join(f"`{g}` int" for g in groups))
    def scan(texts: pa.Array) -> pa.Array:
        found = [_weights(texts, group) if g in sums else (_occurs(texts, group) if group else np.zeros(len(texts), bool))
                 for g, group in groups.items()]
        return pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in found], names=list(groups))
    return scan(_c(x))


def word_count(x) -> Column:
    """H7: ``len(text.split())``."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(TOKEN_RE), 0))


def at_least_words(x, n: int) -> Column:
    """H7 against a bound: ``len(text.split()) >= n``; reads no further than the ``n``-th word."""
    return _c(x).rlike(rf"\A(?:[{WS}]*+[^{WS}]++){{{n}}}")


def length_between(x, lo: int = 10, hi: int = 1000) -> Column:
    """H8: accepted reply length."""
    return F.length(_c(x)).between(lo, hi)


def lenient_id(x) -> Column:
    """B6: '267330.0' -> 267330; 'abc', '', null -> null.

    Goes through double and truncates, as numeric coercion followed by an int64 cast does.
    """
    return _c(x).cast("string").try_cast("double").try_cast("bigint")


def truthy(x) -> Column:
    """B9: 'true'/'1'/'yes' -> True, everything else (null included) -> False."""
    return F.coalesce(F.lower(py_strip(_c(x).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def prefixes_regex(prefixes: Iterable[str]) -> str:
    return "^" + "".join(f"(?:{quote_re(p)}[{WS}]*)?" for p in prefixes)


def strip_prefixes(x, prefixes: Iterable[str]) -> Column:
    """H9: for each prefix in list order, drop it if the (stripped) text starts with it, then
    strip again. One anchored regex of optional groups in list order does exactly that:
    each group is tried once, in order, and takes the blanks after its prefix."""
    return F.regexp_replace(_c(x), prefixes_regex(prefixes), "")


def after_first(x, marker: str) -> Column:
    """Text after the first ``marker`` (the whole text when the marker is absent)."""
    c = _c(x)
    pos = F.locate(marker, c)
    return F.when(pos > 0, F.substring(c, pos + F.lit(len(marker)), F.lit(1 << 30))).otherwise(c)


def fmt_fixed(x, digits: int) -> Column:
    """``f'{x:.Nf}'``."""
    return F.format_string(f"%.{digits}f", _c(x))
