import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ber", "ti", "on", "the", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, one very long, ties, repeated rows, and one id twice."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    near = long[: len(long) // 2] + "zebra " + long[len(long) // 2 :]
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, long), (6, near), (7, "  \n\t "), (8, "A B c D"), (9, "é漢字 <|endoftext|> ▁x\x00"), (12, long)]
    return rows + [(20 + i, prose(rng, rng.randint(1, 40))) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names clash with those that operators make."""
    columns = "doc_id long, text string, fp int, shard string, digest int, length int, key string, label string, bucket int, score int, kept int"
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y", "z", 4, 5, 6) for i, t in odd_rows], columns)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
