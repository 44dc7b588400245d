import random

import pytest

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(60)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    base = prose(rng, 80)
    rows = [(1, None), (2, ""), (3, "one"), (4, base), (5, base), (5, base), (6, base + " tail end"), (7, "x " + base), (8, long), (9, long + " more"), (None, prose(rng, 40)), (11, "   \n\t "), (12, "a b c d"), (13, prose(rng, 13)), (14, base.replace("w1", "W1", 2)), (15, "é ñ 漢字 " * 30), (16, "For " * 400)]
    frame = [(i, t, "en", "src0", len(t or ""), 7, "clash", 3) for i, t in rows]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, did long, row string, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def long_docs(spark):
    """Texts beyond a slice: one of 150,000 words, a near copy and a part of it, one word of a megabyte, and short ones."""
    rng = random.Random(9)
    words = [f"u{i}é{i % 7}" for i in range(30_000)]
    text = " ".join(rng.choice(words) for _ in range(150_000))
    rows = [(1, text), (2, text[: len(text) // 3]), (3, text + " one more word"), (4, "x" * 1_200_000 + " and " + prose(rng, 50)), (5, prose(rng, 50)), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
