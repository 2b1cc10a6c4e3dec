import random

import pytest

WORDS = "the of and to in is that for river stone garden window yellow market harbour candle engine forest silver winter letter bridge".split()
FR = "le la les de des et un une dans pour avec jardin fenêtre rivière marché lettre forêt hiver bougie pont moteur".split()


def prose(seed, n=120, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, host string, spans string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls anywhere, empty and long texts, ties, repeats, clashing extra columns."""
    rows = [
        (1, prose(1), "en", "a", 10, "x", "h", "s"),
        (2, prose(1), "en", "a", 10, "x", "h", "s"),
        (2, prose(1), "en", "a", 10, "x", "h", "s"),
        (3, None, None, None, None, None, None, None),
        (None, prose(2), "en", "b", 5, "x", "h", "s"),
        (5, "", "fr", "b", 0, "x", "h", "s"),
        (6, "   \n\t ", "fr", "b", 5, "x", "h", "s"),
        (7, prose(3, 60_000), "en", "a", 1, "x", "h", "s"),
        (8, prose(4, 80, FR), "fr", "c", 1, "x", "h", "s"),
        (9, "12345 ??? 678", "fr", "c", 1, "x", "h", "s"),
        (10, "é😀 word", None, "c", 1, "x", "h", "s"),
    ] + [(100 + i, prose(100 + i, 60, FR if i % 2 else WORDS), "fr" if i % 2 else "en", "ab"[i % 2], 1, "x", "h", "s") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
