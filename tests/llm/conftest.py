from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, source])."""

    def build(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank and very long texts, ties, repeated rows, one id with two texts."""
    long = words(random.Random(1), 120_000)
    rows = [
        (1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (3, None), (4, ""), (5, ""), (6, "   \n"),
        (7, long), (8, long), (9, long[:-1] + "z"), (None, "without an id at all"), (None, "alpha beta gamma delta"), (10, "one text"), (10, "another text here"),
        (11, "x" * 300_000), (12, "ÄÖÜ ß é 漢字 🙂"), (13, "source missing", None),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def clashing(make):
    """Columns named like the operators' own."""
    from pyspark.sql import functions as F

    d = make([(i, f"some text number {i % 7} with words", f"s{i % 2}") for i in range(20)])
    for c in ("tkey", "node", "name", "keep", "copies", "_drop_id", "_drop_key", "_mix_key", "_mix_n", "_quality", "_repeat_key", "quality", "key", "bucket", "n_rows", "h", "word"):
        d = d.withColumn(c, F.lit("mine"))
    return d


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
