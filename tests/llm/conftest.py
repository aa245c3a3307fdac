"""Small corpora: one with every awkward row, one generated with copies, near copies and passages."""

from __future__ import annotations

import random

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from small_corpus import corpus, words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size double, key string, score string, t1 string, starts string, n string, copies string, kind string"
EXTRA = ("clash", 1.5, "k", "s", "t", "z", "n", "c", "d")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *EXTRA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and wordless texts, repeated rows and ids, a long word, a long text."""
    rng = random.Random(3)
    long = " ".join(words(rng, 6000))
    shared = " ".join(words(rng, 60))
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n\r "), row(4, "one"), row(5, "x" * 3000), row(6, long), row(7, long), row(7, long),
        row(None, shared), row(None, None, None, None), row(8, shared, None), row(9, "Ünïcode  日本語 🙂 <|endoftext|> ***", "de", None),
        row(10, "a b c d e f g"), row(10, "other text under the same id " * 3), row(11, "the " * 200), row(12, shared + " tail", "fr", "b"), row(12, shared + " tail", "fr", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def generated(spark):
    return spark.createDataFrame([row(k, t, "en", f"s{k % 4}") for k, t, _, _ in corpus()], SCHEMA)
