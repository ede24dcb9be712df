"""Small tables that hold the awkward cases every operator has to take."""

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards watch from behind their old stone tower".split()


def prose(n, shift=0, step=1):
    """n words without regular repetition."""
    return " ".join(f"{WORDS[(i * step + shift) % len(WORDS)]}{(i * i + shift) % 97}" for i in range(n))


def documents(spark, rows, clash=()):
    """documents with (doc_id, text[, source]) rows and extra columns of the given names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC)
    return df.withColumns({c: F.lit(7) for c in clash})


def awkward(long_words=30_000):
    long = prose(long_words, 5, 3)
    return [(1, None), (2, ""), (3, "  \t\n "), (4, long), (5, prose(80)), (5, prose(80)), (6, prose(80)), (None, prose(60, 9)),
            (None, None), (7, prose(120, 3) + "\n" + prose(80))]


CLASHES = ("kept", "id", "k", "key", "w", "_id", "_text", "n_words", "start", "cls", "component_id", "name", "words", "component")
