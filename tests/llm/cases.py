"""Tables with the cases every operator must take: nulls in any column, empty and long texts,
ties, repeated rows, extra columns whose names clash with the operators' own."""

import random

LONG = "long " * 30_000 + "end."
DOCS = [
    (1, "The first text has a few words in it, and it ends here.\nA second line.", "en", "web", 10),
    (2, None, "en", "web", None),
    (3, "", None, "web", 0),
    (4, "The first text has a few words in it, and it ends here.\nA second line.", "en", None, 10),
    (None, "No id at all, but words enough for a shingle or two.", "de", "books", 7),
    (None, None, None, None, None),
    (5, LONG, "en", "books", 5),
    (6, "ein zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "news", 3),
    (6, "ein zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "news", 3),
    (7, "...!!! ### 123", None, "news", 1),
    (8, "zwei", "de", "news", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "size", "n_words", "kept", "shard", "label", "g", "id", "t", "c0", "spans", "body", "word", "pass"]


def docs(spark, rows=None):
    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)


def wide(spark, rows=None):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    out = docs(spark, rows)
    for c in CLASHES:
        out = out.withColumn(c, F.lit("x"))
    return out


def prose(n: int, seed: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéfghßij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2 * words))]
        out.append("".join(x + rng.choice([" ", " ", " ", ". ", ".\n", "\n"]) for x in w))
    return out
