from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that for on with as it was at by from this be are not have an or which you".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, stock: list[str] = WORDS) -> str:
    out = []
    for i in range(n):
        w = rng.choice(stock) + rng.choice(stock) if rng.random() < 0.7 else rng.choice(stock)
        out.append(w + (rng.choice([". ", ".\n"]) if i % 9 == 8 else rng.choice([" ", " ", ", "])))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [
        (1, prose(rng, 60), "en", "a", 1, 10, "x"),
        (1, prose(rng, 60), "en", "a", 1, 10, "x"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, 1, "y"),
        (4, "  \n\t ", "en", None, 0, 1, "y"),
        (None, prose(rng, 40), None, "b", 3, 1, "y"),
        (None, None, None, None, None, None, None),
        (5, long, "en", "b", len(long), 1, "y"),
        (6, "12 34 !!! ### \U0001f600", "en", "b", 1, 1, "z"),
        (7, "Ünïcode ẞtraße – “quoted” text, İstanbul ΣΊΣΥΦΟΣ été", "de", "c", 1, 1, "z"),
    ]
    rows += [rows[0]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
