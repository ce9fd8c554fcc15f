"""Text and metric functions on small inputs with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docnav.functions import metrics as M
from docnav.functions import text as X
from docnav.functions.udfs import list_items, parse_list, quote_similarity


def values(spark, rows, schema, expr):
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, " + schema).orderBy("i").select(expr).collect()]


def test_tokens_are_distinct_and_have_compound_forms(spark):
    got = values(spark, ["Figure 01 and the Figure", "Fig. 1", "tab 7", "figures 1 figure 1a"], "s string", X.tokens(F.col("s")))
    assert got[0] == ["figure", "01", "and", "the", "figure01", "fig01", "figure1", "fig1"]
    assert got[1] == ["fig", "1"]
    assert set(got[2]) == {"tab", "7", "table7", "tab7", "table07", "tab07"}
    assert got[3] == ["figures", "1", "figure", "1a"]


def test_caption_lines(spark):
    lines = ["## Figure 2: A view **", "**Table 3. Counts", "Fig. 4 shows it", "see Figure 5: no", "Figure 6a: sub", "TABLE 07: " + "x" * 300]
    got = values(spark, lines, "s string", X.caption(F.col("s")))
    assert [g and g.text[:20] for g in got] == ["Figure 2: A view", "Table 3: Counts", None, None, "Figure 6: sub", "Table 7: " + "x" * 11]
    assert len(got[5].text) == 200


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_fixed_rounds_as_printf_does(spark, digits):
    r = random.Random(digits)
    ten = 10**digits
    near = [(2 * r.randrange(4 * ten) + 1) / (2 * ten) for _ in range(2000)]
    numbers = [0.0, 0.0005, 0.0015, 1e-9, 0.9995, 0.99951, 1.0545, 2.0, 123456789.0625, 1e9, 5e-324] + [i / 32 for i in range(130)] + near + [math.nextafter(x, s) for x in near for s in (0, 9)] + [r.random() * 3 for _ in range(2000)] + [r.random() / 1000 for _ in range(500)]
    assert values(spark, numbers, "x double", X.fixed(F.col("x"), digits)) == [f"{x:.{digits}f}" for x in numbers]
    assert values(spark, [None, 1.0], "x double", F.transform(F.array("x"), lambda x: X.fixed(x, digits)))[1] == [f"{1:.{digits}f}"]


def test_lines_are_cut_as_python_does(spark):
    texts = ["a\nb", "a\r\nb\n", "", "\n", "a\x0bb\x85c d", "a\n\nb"]
    assert values(spark, texts, "s string", X.lines(F.col("s"))) == [t.splitlines() for t in texts]


@pytest.mark.parametrize(("raw", "want"), [("The answer is: 51%.", "51%"), ("M.A.", "M.A."), ("This document does not contain it.", "Not answerable"), ("  Final answer: x...", "x")])
def test_extract_answer(spark, raw, want):
    assert values(spark, [raw], "s string", X.extract_answer(F.col("s"))) == [want]


def test_clean_reply(spark):
    rows = [("a</think> b<|im_end|>", True, "stop"), ("x\n\n\ny", True, "stop"), ("x", True, "stop"), ("x </think> y", True, "length"), (" x ", False, "length")]
    got = values(spark, rows, "c string, t boolean, f string", X.clean_reply(F.col("c"), F.col("t"), F.col("f")))
    assert [tuple(g) for g in got] == [("b", False), ("y", False), ("", True), ("", True), ("x", False)]


def test_clean_str_and_numbers(spark):
    assert values(spark, ["'Ab' ", "ab (c) (d)", '"x', "$5%", '""'], "s string", X.clean_str(F.col("s"))) == ["ab", "ab", '"x', "5", ""]
    assert values(spark, ["$1,234.5 million", "(12)", "-3", "none", "1.2.3"], "s string", X.to_float(F.col("s"))) == [1234.5, 12.0, -3.0, None, 1.2]


def test_decode_list_raises_on_what_is_no_list(spark):
    assert values(spark, ['["a"]', "null"], "s string", X.decode_list(F.col("s"))) == [["a"], []]
    with pytest.raises(Exception, match="no JSON list"):
        values(spark, ["[a"], "s string", X.decode_list(F.col("s")))


def test_arguments_are_masked(spark):
    assert values(spark, ["run --judge-api-key=x --api-key y --n 3"], "s string", X.mask_arguments(F.col("s"))) == ["run --judge-api-key=*** --api-key *** --n 3"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_anls_and_f1_equal_plain_functions(spark):
    r = random.Random(2)
    pairs = [("".join(r.choice("ab é") for _ in range(r.randrange(7))), "".join(r.choice("ab é") for _ in range(r.randrange(7)))) for _ in range(200)]
    got = values(spark, pairs, "p string, t string", M.anls_single(F.col("p"), F.col("t")))
    for (p, t), g in zip(pairs, got, strict=True):
        p, t = p.strip().lower(), t.strip().lower()
        n = max(len(p), len(t))
        d = lev(p, t) / n if n else 0
        assert g == pytest.approx(1.0 if not n else 0.0 if not p or not t else 1 - d if d < 0.5 else 0.0)
    got = values(spark, [("the cat sat", "cat sat sat"), ("", ""), ("a", "x"), ("10.5%", "105")], "p string, t string", M.f1_single(F.col("p"), F.col("t")))
    assert got == [pytest.approx(0.8), 1.0, 0.0, 1.0]


@pytest.mark.parametrize(
    ("gold", "pred", "kind", "want"),
    [("51%", "0.51", "Float", 1.0), ("51%", "50%", "Float", 0.0), ("3.9", "3", "Int", 1.0), ("x", "3", "Int", 0.0), ("Not answerable", "not answerable", "None", 1.0), ("apple", "aple", "Str", 0.8), ("www.a.b", "www.a.c", "Str", 0.0), ("a", "a", "Date", 0.0), ("['a', 'b']", "b; a", "List", 1.0), ("['a', 'b']", "a", "List", 0.0)],
)
def test_rule_score(spark, gold, pred, kind, want):
    assert values(spark, [(gold, pred, kind)], "g string, p string, k string", M.eval_score(F.col("g"), F.col("p"), F.col("k"))) == [pytest.approx(want)]


def test_list_score(spark):
    rows = [("['a', 'b']", "b, a"), ("[1, 2]", "2.0 and 1"), ("[1]", "x"), ("[]", "[]"), ("['a']", "['a', 'b']"), ("['kitten']", "kittin")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, p string").withColumn("gi", parse_list("g")).withColumn("pi", parse_list("p"))
    got = [r[0] for r in df.orderBy("i").select(M.score_list(F.col("g"), F.col("p"), F.col("gi"), F.col("pi"))).collect()]
    assert got == [1.0, 1.0, 0.0, 1.0, 0.0, pytest.approx(5 / 6)]
    assert list_items("a; b and c") == ["a", "b", "c"] and list_items("(1, 'x')") == ["1", "x"]


def test_quotes(spark):
    assert quote_similarity("", "x") == (False, 0.0) and quote_similarity("abc", "xabcx") == (True, 1.0)
    found, ratio = quote_similarity("the quick brown fox", "over the quick brown fix now")
    assert found and 0.8 <= ratio < 1
    assert values(spark, ["A  B-c\t% $5.0"], "s string", X.norm_quote(F.col("s"))) == ["a b c % $5.0"]


def test_quote_ratios_equal_a_plain_walk():
    import difflib

    def plain(q, t):
        n, best = len(q), 0.0
        for i in range(0, max(1, len(t) - n + 1), max(1, n // 4)):
            best = max(best, difflib.SequenceMatcher(None, q, t[i : i + n]).ratio())
            if best > 0.95:
                break
        return best >= 0.8, round(best, 3)

    r = random.Random(6)
    for _ in range(150):
        text = "".join(r.choice("abcde ") for _ in range(r.randrange(1, 400)))
        at = r.randrange(len(text))
        quote = "".join(c if r.random() > 0.1 else r.choice("xyz") for c in text[at : at + r.randrange(1, 260)]) + "#" * (r.random() < 0.3)
        assert quote_similarity(quote, text) == ((True, 1.0) if quote in text else plain(quote, text))


def test_hints(spark):
    page = "Some  prose; Figure 1: the quick brown fox jumps over"
    rows = [("figure 1 - The Quick brown", page), ("fig", page), ("figure 2 the quick brown", page)]
    assert values(spark, rows, "h string, p string", X.verified(F.col("h"), F.col("p"))) == [True, False, False]


def test_verdicts(spark):
    got = values(spark, ["Extracted answer:  5 \nVerdict: [incorrect]\nReason: off", "nothing"], "s string", X.parse_verdict(F.col("s")))
    assert tuple(got[0]) == ("5", "Incorrect", "off") and tuple(got[1]) == (None, None, "")
