from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string,"
    " size long, label string, _key string, _node string, _row string, kept string, n_words long, id long"
)
CLASHES = [-1.0, "k", -2, "l", "x", "y", "z", "w", -3, -4]


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns of clashing names."""

    def build(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None,
             *CLASHES) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(prose(1, 30_000, 5000))
    text = " ".join(prose(2, 60))
    return [
        (1, text, "a"), (1, text, "a"), (2, text, None), (3, None, "b"), (4, "", "b"), (5, " \n\t ", None),
        (6, long_text, "c"), (None, text, "c"), (None, None, None), (7, "one", "b"),
        (8, "Ünï çödé ￿ \U0001F600 <|endoftext|> x\x1cy", "é"), (9, text + " more words here", "a"),
    ]
