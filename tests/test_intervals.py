import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docnav.operators import intervals as I
from docnav.operators import tree as T
from docnav.operators.retrieval import covered_by, explained, section_corpus, section_units
from docnav.plans.retrieval import wide_ranges

RANGES, PAGES = "corpus_id int, name int, start_page int, end_page int", "corpus_id int, page int, note string"


@pytest.mark.parametrize(("seed", "span"), [(1, 12), (2, 300), (3, 70_000), (4, 2_000_000_000)])
def test_pages_in_ranges(spark, seed, span):
    r = random.Random(seed)
    ranges = [(r.randrange(4), i, r.randrange(-span // 9, span), r.randrange(span)) for i in range(120)] + [(0, 900, None, 5), (None, 901, 1, span), (0, 902, -span, span), (0, 903, 7, 7), (3, 904, span, 1)]
    pages = [(r.choice([0, 1, 2, 9]), r.randrange(span), "x") for _ in range(150)] + [(0, 7, "x"), (0, 7, "x"), (None, 3, "x"), (1, None, "x")]
    got = I.pages_in(spark.createDataFrame(ranges, RANGES), spark.createDataFrame(pages, PAGES))
    want = Counter((c, n, a, b, p, x) for c, n, a, b in ranges if c is not None and a is not None and b is not None for d, p, x in pages if c == d and p is not None and a <= p <= b)
    assert Counter((q["corpus_id"], q["name"], q["start_page"], q["end_page"], q["page"], q["note"]) for q in got.collect()) == want


def test_rows_follow_pages_not_lengths(spark):
    """A thousand ranges of a thousand million numbers over few pages."""
    ranges = spark.range(1000).selectExpr("0 as corpus_id", "cast(id as int) as name", "cast(id as int) as start_page", "1000000000 as end_page")
    pages = spark.range(50).selectExpr("0 as corpus_id", "cast(id * 7 as int) as page")
    assert I.pages_in(ranges, pages).count() == sum(7 * p >= i for p in range(50) for i in range(1000))


def test_clashing_names(spark):
    ranges = spark.createDataFrame([(1, 1, 3, "a", "b")], "corpus_id int, start_page int, end_page int, level string, lo string")
    got = I.pages_in(ranges, spark.createDataFrame([(1, 2, "n")], "corpus_id int, page int, node string")).collect()
    assert [(r["level"], r["lo"], r["node"], r["page"]) for r in got] == [("a", "b", "n", 2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coverage(spark, seed):
    r = random.Random(seed)
    sizes = [(d, r.randrange(0, 30)) for d in range(6)]
    ranges = [(r.randrange(7), r.randrange(-3, 35), r.randrange(-3, 35)) for _ in range(40)]
    runs = I.coverage(spark.createDataFrame(ranges, "doc_id int, start_page int, end_page int"), spark.createDataFrame(sizes, "doc_id int, n_pages int")).collect()
    got = Counter({(x["doc_id"], p): x["times"] for x in runs for p in range(x["first"], x["last"] + 1)})
    want = Counter((d, p) for d, a, b in ranges for p in range(a, b + 1))
    assert {k: v for k, v in got.items() if v} == dict(want)
    assert {k for k in got if k not in want} == {(d, p) for d, n in sizes for p in range(1, n + 1)} - set(want)


def test_reversed_and_huge_sections(spark):
    """A section with a wrong end neither fills a task nor adds rows."""
    pages = spark.createDataFrame([(1, p, f"t{p}") for p in range(1, 6)], "corpus_id int, page int, text string")
    sections = spark.createDataFrame([(1, "S1", 0, "A", 1, 10**9), (1, "S2", 1, "B", 5, 2), (1, "S3", 2, "C", 4, 4), (2, "S1", 0, "D", 1, 3)], "corpus_id int, section_id string, ord int, title string, start_page int, end_page int")
    assert {(r["unit_id"], r["text"]) for r in section_units(pages, sections).collect()} == {("S1", "t1 t2 t3 t4 t5"), ("S3", "t4")}
    asked = spark.createDataFrame([(1, "q", 4), (1, "q", 4), (1, "r", 9)], "corpus_id int, question_id string, page int")
    assert [tuple(r) for r in covered_by(asked, sections, "ids").orderBy("question_id").collect()] == [(1, "q", ["S1", "S3"]), (1, "r", ["S1"])]
    bad = T.validate(sections.selectExpr("corpus_id as doc_id", "ord", "cast(null as int) as parent_ord", "start_page", "end_page").where("doc_id = 1"), spark.createDataFrame([(1, 5)], "doc_id int, n_pages int"))
    assert sorted((r["kind"], r["detail"]) for r in bad.collect()) == [("bad_range", 0), ("bad_range", 1), ("duplicate", 4)]


def test_section_corpus_keeps_sections_without_pages(spark):
    index = spark.createDataFrame([(1, 1, "One", "s", ["k"], None, None), (1, 2, "Two", None, None, ["Figure 1"], None)], "corpus_id int, page int, title string, summary string, keywords array<string>, figures array<string>, tables array<string>")
    sections = spark.createDataFrame([(1, "S1", 0, "A", 1, 2), (1, "S2", 1, "B", 7, 9), (2, "S1", 0, "C", 1, 1)], "corpus_id int, section_id string, ord int, title string, start_page int, end_page int")
    got = {(r["corpus_id"], r["unit_id"]): r["text"].split() for r in section_corpus(sections, index).collect()}
    assert got == {(1, "S1"): ["A", "One", "s", "k", "Two", "Figure", "1"], (1, "S2"): ["B"], (2, "S1"): ["C"]}


NODES = "doc_id int, node string, parent string, ord int"


def test_numbers_of_trees(spark):
    """Random trees beside cycles and nodes below missing ones."""
    r, rows = random.Random(4), []
    for d in range(5):
        rows += [(d, f"n{i}", None if i < 2 else f"n{r.randrange(max(1, i - 4), i) if d % 2 else r.randrange(i)}", r.randrange(3)) for i in range(60)]
    rows += [(0, "a", "b", 0), (0, "b", "a", 0), (0, "c", "b", 0), (1, "self", "self", 0), (1, "below", "self", 0), (2, "orphan", "gone", 0), (2, "child", "orphan", 0), (9, "x", "y", 0)]
    got = {(q["doc_id"], q["node"]): (q["id"], q["depth"], q["path"]) for q in T.number(spark.createDataFrame(rows, NODES)).collect()}
    kids, want = {}, {}
    for d, n, p, o in rows:
        kids.setdefault((d, p), []).append((o, n))

    def walk(d, p, path):
        for k, (_, n) in enumerate(sorted(kids.get((d, p), [])), 1):
            want[d, n] = ("S" + ".".join(map(str, [*path, k])), len(path), [*path, k])
            walk(d, n, [*path, k])

    for d in {x[0] for x in rows}:
        walk(d, None, [])
    assert got == want
    _, lost = T.climb(spark.createDataFrame(rows, NODES))
    assert {(q["doc_id"], q["node"]) for q in lost.collect()} == {(0, "a"), (0, "b"), (0, "c"), (1, "self"), (1, "below"), (2, "orphan"), (2, "child"), (9, "x")}


def test_deep_chain_in_few_rounds(spark, monkeypatch):
    rounds, original = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: rounds.append(1) or original(df))
    n = 100_000
    chain = spark.range(n).selectExpr("0 as doc_id", "id as node", "nullif(id, 0) - 1 as parent", "id as ord")
    found, lost = T.climb(chain, paths=False)
    assert found.where("depth = node").count() == n and lost.isEmpty() and len(rounds) < 20


def test_no_nodes(spark):
    assert T.number(spark.createDataFrame([], NODES)).count() == 0


def test_explained_takes_repeated_rows(spark):
    located = spark.createDataFrame([(1, [("Figure 1", [1], "caption", ["Figure 1: x"])], ["S1"], ["S1"], [1, 2])], "corpus_id int, refs array<struct<ref string, pages array<int>, via string, captions array<string>>>, ref_sections array<string>, sections array<string>, anchor_pages array<int>")
    index = spark.createDataFrame([(1, 1, "B", None, None), (1, 1, "A", None, None), (1, 2, "C", ["Figure 1"], None), (1, None, "N", None, None)], "corpus_id int, page int, title string, figures array<string>, tables array<string>")
    sections = spark.createDataFrame([(1, "S1", "T", 1, 2), (1, "S1", "T", 1, 2), (1, "S1", "R", 1, 1)], "corpus_id int, section_id string, title string, start_page int, end_page int")
    text = explained(located, index, sections).first()["explanation"]
    assert "- p1: A\n" in text and "S1: R (pages 1-1)" in text and "p2: C [Figure 1]" in text


def test_tasks_follow_rows(spark, monkeypatch):
    """What a task sorts does not grow with the tables: the rows are dealt to tasks by their number, with the same result."""
    r = random.Random(6)
    ranges = spark.createDataFrame([(r.randrange(30), i, r.randrange(-40, 400), r.randrange(400)) for i in range(300)], "corpus_id int, name int, start_page int, end_page int")
    pages = spark.createDataFrame([(r.randrange(30), r.randrange(400)) for _ in range(600)], "corpus_id int, page int")
    assert Counter(I.pages_in(ranges, pages, parts=21).collect()) == Counter(I.pages_in(ranges, pages).collect())
    few = wide_ranges(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(I, "TASK_ROWS", rows // 40)
    many = wide_ranges(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() >= 40 and Counter(few.collect()) == Counter(many.collect())


@pytest.mark.parametrize("after", [0, 1, 14, 15, 16, 17, 32, 33, 257])
def test_pieces_cover_once(spark, after):
    for first in (0, 1, 15, 16, 31):
        got = spark.range(1).select(I.pieces(F.lit(first), F.lit(after)).alias("p")).first()["p"]
        held = Counter(n for level, node in got for n in range(node * I.FAN**level, (node + 1) * I.FAN**level))
        assert held == Counter(range(first, after))
