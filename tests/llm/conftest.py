import random

import pytest

CLASHES = ["size", "shard", "kept", "node", "n", "value", "score", "digest", "bucket", "rank", "id", "page", "sha", "ids", "_id", "_text", "take"]


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


def odd_texts():
    """Texts at the edges: nulls, empty, white space only, short, very long, ties, repeated rows, odd code points."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    base = words(rng, 80)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a b c d e"), (7, long), (8, long + " end"), (9, base), (10, near), (11, base.upper()),
        (12, base), (12, base), (None, base), (None, None), (13, "é ü 漢字 😀 　 x"), (14, "<|endoftext|> a<|endoftext|>"), (15, "don't  you'll 'tis\n\n  x"), (16, "same line\nsame line\nsame line\nother"),
        (17, "x y z w v " * 30), (18, "#*$%&|<> ###"), (19, "12 345"), (-5, "negative id " * 4), (1 << 40, words(rng, 30)),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 120))) for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts as documents, with columns that clash with names that operators use."""
    rows = [(i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None if k % 11 == 0 else f"src{k % 4}", len(t or ""), *[f"x{k}"] * len(CLASHES)) for k, (i, t) in enumerate(odd_texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
