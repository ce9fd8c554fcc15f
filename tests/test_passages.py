import difflib
import random

import pytest

from docnav.functions.text import norm_quote
from docnav.functions.udfs import quote_similarity
from docnav.operators.passages import near_windows, passage_matches
from pyspark.sql import functions as F


def normal(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", norm_quote(F.col("t")).alias("n")).collect()
    return {r["i"]: r["n"] for r in rows}


def altered(r, words, share, how):
    out = []
    for w in words:
        if r.random() >= share:
            out.append(w)
        elif how == "replace":
            out.append("".join(r.choices("abcdefgh", k=len(w))))
        elif how == "typo":
            k = r.randrange(len(w))
            out.append(w[:k] + "q" + w[k + 1 :])
        elif how == "insert":
            out += [w, "extra"]
    return out


@pytest.mark.parametrize("how", ["replace", "typo", "insert", "drop"])
def test_equals_all_pairs(spark, how):
    """Passages with altered words among prose of the same words: the pairs and ratios of comparing each passage with each document."""
    r = random.Random(how)
    pool = ["".join(r.choices("etaoinshr", k=r.randrange(2, 9))) for _ in range(300)]
    items = [r.choices(pool, k=n) for n in (5, 8, 15, 30, 60, 90)]
    docs = []
    for k in range(40):
        body = r.choices(pool, k=r.randrange(0, 200))
        if k % 4:
            at = r.randrange(len(body) + 1)
            body[at:at] = altered(r, items[k % 6], r.choice([0, 0.05, 0.1, 0.15]), how)
        docs.append(" ".join(body))
    got = passage_matches(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string"), spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"))
    got = {(x["doc_id"], x["item_id"]): x["ratio"] for x in got.collect()}
    q, t = normal(spark, [" ".join(w) for w in items]), normal(spark, docs)
    want = {(d, i): ratio for d in t for i in q for found, ratio in [quote_similarity(q[i], t[d])] if found}
    assert got == want and len(want) > 10


def test_odd_rows(spark):
    docs = [(1, "The quick, brown fox jumps over the lazy dog."), (1, "nothing"), (2, "QUICK brown   fox"), (3, None), (None, "quick brown fox"), (4, ""), (5, "over there"), (6, "a quick brown fox jumps over a lazy dog today")]
    items = [(1, "quick brown fox"), (2, "over"), (3, "lazy dog"), (4, ""), (5, None), (None, "over"), (6, "the quick, brown fox jumps over the lazy dog."), (7, "!!!")]
    got = passage_matches(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))
    found = {(r["doc_id"], r["item_id"]): r["ratio"] for r in got.collect()}
    assert found[1, 6] == 1.0 and found[2, 1] == 1.0 and found[5, 2] == 1.0 and found[6, 3] == 1.0 and 0.8 <= found[6, 6] < 1
    assert {i for d, i in found if d == 1} >= {2, 6} and all(i not in (4, 5, 7) and d not in (3, 4, None) for d, i in found)
    assert passage_matches(spark.createDataFrame([], "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).count() == 0


def test_windows_near_diagonals():
    quote, text = "x" * 40, "y" * 400
    assert near_windows(quote, text, [100]) == [80, 90, 100, 110, 120]
    assert near_windows(quote, text, [-30]) == [0] and near_windows(quote, text, [900]) == [360]
    assert near_windows(quote, "short", [3]) == [0]


def test_ratio_is_that_of_difflib():
    """Short and long texts: from 200 characters on difflib lets only rare ones begin a block."""
    from docnav.functions.udfs import Same

    rng = random.Random(5)
    letters = ["ab", "aaaaaaaaab ", "abcdefghij klmnopqrst.,$%", "etaoinshrdlu" * 4 + "bcfgjkmpqvwxyz0123456789 "]
    for k in range(600):
        one = letters[k % 4]
        text = "".join(rng.choices(one, k=rng.choice([0, 1, 60, 199, 200, 201, 260])))
        quote = "".join(rng.choices(one, k=rng.choice([0, 1, 30, 199, 230])))
        if k % 2 and text:
            at = rng.randrange(len(text))
            quote = quote[: len(quote) // 2] + text[at : at + 90] + quote[len(quote) // 2 :]
        assert Same(quote).ratio(text) == difflib.SequenceMatcher(None, quote, text).ratio(), (quote, text)


def test_plain_is_norm_quote(spark):
    """Every character, between others and at both ends."""
    from docnav.operators.passages import plain

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["A".join(points[at : at + 700]) for at in range(0, len(points), 700)] + ["", " ", "\n İ ", "10 KELVIN,\t. \x00B"]
    assert normal(spark, texts) == {i: plain(t.encode()).decode() for i, t in enumerate(texts)}


def test_hopeless_windows_are_not_compared(monkeypatch):
    """Windows of a text of the same words, and so of the same letters, that shares one seed by chance; bounds leave out nothing that reaches ENOUGH."""
    from docnav.functions.udfs import ENOUGH, Same
    from docnav.operators import passages as P

    r, asked, ratio = random.Random(8), [], Same.ratio
    monkeypatch.setattr(Same, "ratio", lambda self, text: asked.append(text) or ratio(self, text))
    pool = ["".join(r.choices("etaoinshr", k=r.randrange(2, 9))) for _ in range(300)]
    words = r.choices(pool, k=25)
    body = r.choices(pool, k=400)
    body[200:203] = words[15:18]
    assert P.window_similarity(" ".join(words), " ".join(body), [(200, len(" ".join(words[:15])) + 1)])[0] is False and not asked
    body[180:205] = altered(r, words, 0.1, "typo")
    assert P.window_similarity(" ".join(words), " ".join(body), [(180, 0)])[0] is True and asked
    for k in range(300):
        quote = " ".join(words[: r.randrange(1, 25)])
        window = " ".join(altered(r, quote.split(), r.choice([0.1, 0.2, 0.4]), r.choice(["replace", "typo", "drop"])))[: len(quote)]
        if ratio(Same(quote), window) >= ENOUGH:
            assert P._Passage(quote).may_reach(window.encode(), ENOUGH), (k, quote, window)  # noqa: SLF001
