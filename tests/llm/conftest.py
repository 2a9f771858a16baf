from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use inside."""
    def make(rows, extra=True, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if extra:
            for c in ("key", "size", "score", "n", "a", "component", "part", "h"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "日本", "x"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, long = prose(120), prose(30_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "one two three"), (7, base), (8, base), (9, base.replace("alpha", "ALPHA", 3)),
        (10, base + " tail of a few more words"), (11, long), (12, long), (13, prose(80)), (13, prose(80)), (14, "a a a a a a a a"), (15, base), (15, base), (None, base), (None, None), (16, "\x00\x01<|endoftext|>"), (17, "\n".join(["same line here"] * 5)),
    ]
