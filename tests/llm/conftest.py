from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, blanks, ties, repeated rows, a long text, and columns with clashing names.
WORDS = [f"w{i % 97}x{i % 89}" for i in range(4000)]
LONG = " ".join(WORDS)
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", 1), (2, f"start {PASSAGE} end", "en", "a", 1), (3, f"other words {PASSAGE}\nfin", "fr", "b", 1), (4, None, None, None, None), (5, "", "de", None, 0),
    (6, "one two", "en", "a", 7), (6, "one two", "en", "a", 7), (7, "One TWO", "en", "b", 7), (None, "null id text here", "en", "a", 1), (8, " \t\n", "en", "c", 3),
    (9, "été " * 120, "fr", "b", 2), (10, "x" * 30000, "en", "a", 3), (11, "same line here now\n" * 30, "en", "c", 1), (6, "another text with the same id", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, DOC).select("*", F.lit(0).alias("k"), F.lit("z").alias("t"), F.lit(1).alias("size"), F.lit(2).alias("at"), F.lit(3).alias("h"), F.lit(4).alias("fp"), F.lit(5).alias("w")).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
