import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, cls string, n int"


def prose(seed: int, n: int, vocab: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, ties, near copies."""
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (5, 40, 80)]
    texts = [None, "", " \t\n", "one", "one two", "One TWO", "a b c d e f g h i j", base, base, *near, prose(2, 30000, 5000), prose(3, 9), prose(3, 9) + " x", prose(4, 20), prose(4, 20) + " tail", "é ü ñ " * 5, "nul\x00\x01\x02 text here"]
    rows = [(i, x, "en", f"s{i % 3}", None, "k", "c", 1) for i, x in enumerate(texts)]
    rows += [(7, base, "en", "s1", None, "k", "c", 1), (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "one", "en", "s0", None, "k", "c", 1)]
    return rows


@pytest.fixture
def odd(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


LARGE = 2**53 + 1


@pytest.fixture
def large(spark):
    """Ids that doubles cannot hold, beside a null, in one batch."""
    rows = [(LARGE, prose(1, 30), "en", "s", None, "k", "c", 1), (LARGE + 2, prose(1, 30), "en", "s", None, "k", "c", 1), (None, "no id", "en", "s", None, "k", "c", 1)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)
