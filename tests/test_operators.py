"""Operators on small tables against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docnav.operators import agent as G
from docnav.operators import captions as C
from docnav.operators import report as P
from docnav.operators import retrieval as R
from docnav.operators import tree as T


def test_bm25_ranks_within_its_corpus(spark):
    pages = [("d", 1, "cats and dogs"), ("d", 2, "breakdown by ios and android, pie chart"), ("d", 3, "pie"), ("e", 1, "ios pie chart breakdown")]
    units = spark.createDataFrame([(c, p, p, t) for c, p, t in pages], "corpus_id string, unit_id int, ord int, text string")
    q = spark.createDataFrame([("d", 0, "ios breakdown pie chart"), ("d", 1, "zzz-not-present")], "corpus_id string, qid int, query string")
    got = R.bm25(units, q).orderBy("rank").collect()
    assert [(r.corpus_id, r.qid, r.unit_id) for r in got] == [("d", 0, 2), ("d", 0, 3)]
    lens, df = [3, 7, 1], {"ios": 1, "breakdown": 1, "pie": 2, "chart": 1}
    want = sum(math.log(1 + (3 - df[t] + 0.5) / (df[t] + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 7 / (sum(lens) / 3))) for t in df)
    assert got[0].score == pytest.approx(want, abs=1e-8)


def test_ties_keep_the_order_of_pages(spark):
    units = spark.createDataFrame([("d", p, p, "same words") for p in (3, 1, 2)], "corpus_id string, unit_id int, ord int, text string")
    q = spark.createDataFrame([("d", 0, "words")], "corpus_id string, qid int, query string")
    assert [r.unit_id for r in R.bm25(units, q, 2).orderBy("rank").collect()] == [1, 2]


def test_page_selection_fills_up_with_early_pages(spark):
    pages = spark.createDataFrame([("d", p, t) for p, t in enumerate(["a", "b", "c", "needle"], 1)], "corpus_id string, page int, text string")
    q = spark.createDataFrame([("d", 0, "needle"), ("d", 1, "none")], "corpus_id string, qid int, query string")
    got = R.select_pages(pages, q, 2).groupBy("qid").agg(F.sort_array(F.collect_list("page"))).orderBy("qid").collect()
    assert [r[1] for r in got] == [[1, 4], [1, 2]]


def repaired(sections, n):
    kept = sorted(((max(1, a), min(b, n), t) for a, b, t in sections if max(1, a) <= min(b, n)), key=lambda s: s[0])
    out, cursor = [], 1
    for a, b, t in kept:
        if a > cursor:
            out.append((f"Pages {cursor}-{a - 1} (unassigned by LLM)", cursor, a - 1))
        if b >= cursor:
            out.append((t, max(a, cursor), b))
        cursor = max(cursor, b + 1)
    if cursor <= n:
        out.append((f"Pages {cursor}-{n} (unassigned by LLM)", cursor, n))
    return out


def test_repair_equals_a_plain_walk(spark):
    r = random.Random(7)
    trees = [([(r.randrange(-2, 12), r.randrange(-2, 14), f"t{i}") for i in range(r.randrange(6))], r.randrange(1, 11)) for _ in range(60)]
    rows = [(d, i, t, a, b) for d, (s, _) in enumerate(trees) for i, (a, b, t) in enumerate(s)]
    got = T.repair(spark.createDataFrame(rows, "doc_id int, ord int, title string, start_page int, end_page int"), spark.createDataFrame([(d, n) for d, (_, n) in enumerate(trees)], "doc_id int, n_pages int")).collect()
    assert sorted(map(tuple, got)) == sorted((d, *x) for d, (s, n) in enumerate(trees) for x in repaired(s, n))


def test_validation_names_each_problem(spark):
    s = spark.createDataFrame([("d", 1, None, 2, 3), ("d", 2, 1, 3, 4), ("d", 3, None, 3, 4)], "doc_id string, ord int, parent_ord int, start_page int, end_page int")
    got = T.validate(s, spark.createDataFrame([("d", 4)], "doc_id string, n_pages int")).collect()
    assert sorted((r.kind, r.detail) for r in got) == [("duplicate", 3), ("duplicate", 4), ("escapes_parent", 2), ("uncovered", 1), ("uncovered", 2)]


def test_numbers_and_outline(spark):
    nodes = spark.createDataFrame([(0, n, p, i) for i, (n, p) in enumerate([("a", None), ("b", None), ("b1", "b"), ("b2", "b"), ("b2x", "b2")])], "doc_id int, node string, parent string, ord int")
    ids = T.number(nodes)
    assert {r.node: r.id for r in ids.collect()} == {"a": "S1", "b": "S2", "b1": "S2.1", "b2": "S2.2", "b2x": "S2.2.1"}
    assert T.outline(ids, nodes.select("doc_id", "node", F.upper("node").alias("title"))).first().outline == "S1 A\nS2 B\n  S2.1 B1\n  S2.2 B2\n    S2.2.1 B2X"


def test_captions_mentions_and_structured_captions(spark):
    pages = spark.createDataFrame([("d", 1, "see Figure 1 and Table 12"), ("d", 2, "Figure 1: a view\n\nText on Figure 3\nTable 1. counts"), ("d", 3, "<!-- image -->")], "doc_id string, page int, md string")
    got = {r.page: r for r in C.page_visuals(pages).collect()}
    assert got[1].mentions_figures == [1] and got[1].mentions_tables == [12] and not got[1].has_visual_elements
    assert got[2].figures == ["Figure 1: a view"] and got[2].tables == ["Table 1: counts"] and got[2].mentions_figures == [3]
    assert got[3].has_visual_elements
    s = spark.createDataFrame([("d", 1, ["Figure 9: other"], [])], "doc_id string, page int, s_figures array<string>, s_tables array<string>")
    both = {r.page: r for r in C.with_structured(C.page_visuals(pages), s).collect()}
    assert both[1].figures == ["Figure 9: other"] and both[1].captions_source == "docling" and both[2].captions_source == "markdown"


def test_references_prefer_captions(spark):
    q = spark.createDataFrame([("d", 0, "What does Figure 1 show, and Table 5, and Fig. 9?")], "corpus_id string, qid int, query string")
    rows = lambda *x: spark.createDataFrame(list(x), "corpus_id string, page int, kind string, number int")
    got = R.resolve(q, rows(("d", 2, "Figure", 1)), rows(("d", 7, "Figure", 1), ("d", 5, "Table", 5))).orderBy("pos").collect()
    assert [(r.ref, r.pages, r.via) for r in got] == [("Figure 1", [2], "caption"), ("Table 5", [5], "mention"), ("Figure 9", [], "none")]


def test_anchors_put_references_first(spark):
    ranked = spark.createDataFrame([("d", 0, 0, 0, p, s, r) for p, s, r in ((4, 2.0, 1), (2, 1.0, 2))] + [("d", 1, 0, 1, 2, 3.0, 1)], "corpus_id string, qid int, question int, qno int, unit_id int, score double, rank int")
    fused = R.fuse(ranked)
    assert {r.unit_id: r.score for r in fused.collect()} == {4: 1.0, 2: 1.5}
    refs = spark.createDataFrame([("d", 0, [9, 9, 8, 7, 6])], "corpus_id string, question int, ref_pages array<int>")
    assert R.anchors(fused, refs).first().anchors == [9, 8, 7, 6, 2]


def test_quotes_found_exactly_and_nearly(spark):
    rows = [("The Cat sat!", "x the cat sat y"), ("the cat sat on the mat", "then the cat sat on a mat too"), ("zzz", "abc"), ("", "abc"), (None, None)]
    got = G.quotes_found(spark.createDataFrame(rows, "quote string, text string")).collect()
    assert {r.quote: r.found for r in got} == {"The Cat sat!": True, "the cat sat on the mat": True, "zzz": False, "": False, None: False}


def test_cache_calls_each_miss_once(spark):
    p = spark.createDataFrame([("answer", "a"), ("answer", "a"), ("answer", "b")], "kind string, prompt string")
    old = p.where("prompt = 'b'").select(G.cache_key("kind", "prompt").alias("key"), F.lit("old").alias("reply"))
    assert sorted((r.prompt, r.reply, r.from_cache) for r in G.cached_calls(p, old).collect()) == [("a", "answer to 'a'", False), ("b", "old", True)]


def test_summaries_of_nothing_are_zero_or_null(spark):
    none = spark.createDataFrame([], "format string, rules double, extraction double, judge double, extract_parse_ok boolean, verdict string, empty boolean, asked boolean")
    assert P.judge_summary(none).collect() in ([], [(None, 0, None, None, None, 0, 0, 0)])
    empty = spark.createDataFrame([], "format string, gold string, extracted string, score double, gold_pages int, gold_page_in_context boolean, truncated boolean, pages_sent int, pages_total int, prompt_tokens int, completion_tokens int")
    assert P.baseline_summary(empty).where("format is null").select("questions", "accuracy", "f1").collect() in ([], [(0, 0.0, 0.0)])


def test_latest_and_pending(spark):
    r = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (2, 1, "c", "bad")], "run_id int, ord int, v string, error string")
    assert sorted((x.run_id, x.v) for x in P.latest(r, "run_id", "ord").collect()) == [(1, "b"), (2, "c")]
    assert [x.run_id for x in P.pending(r.select("run_id").distinct(), r, "run_id").collect()] == [2]


def test_quotes_of_any_length_match_by_containment(spark, tmp_path):
    from docnav.plans.retrieval import quote_exact_match

    line = "Revenue of the northern region grew by 4.5% in 2021, mostly in spring; costs did not."
    texts = [line, f"before {line} after", "grew by 4.5%", "spring", "", None, "a b", "the northern region grew, by"]
    words = line.split()
    quotes = [None, "", "§§", *(" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)), *(line[i:] for i in range(1, 30)), *(line[3:j] for j in range(5, len(line)))]
    for name, column, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", quotes)):
        spark.createDataFrame(list(enumerate(rows)), f"{column} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")

    def norm(x):
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9%$., ]+", " ", (x or "").lower())).strip()

    want = {(i, k) for i, t in enumerate(texts) for k, q in enumerate(quotes) if norm(q) and norm(q) in norm(t)}
    got = quote_exact_match(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hints_of_a_page_meet_its_text_in_one_row(spark):
    """Repeated hints and pages keep their rows, and a page is normalised once whatever its hints."""
    from docnav.operators.captions import verified_hints

    pages = spark.createDataFrame([(1, 1, "The quick brown fox jumps."), (1, 1, "A quick brown fox!"), (1, 2, None)], "doc_id int, page int, md string")
    hints = spark.createDataFrame([(1, 1, "Quick  brown fox"), (1, 1, "Quick  brown fox"), (1, 1, "fox"), (1, 1, None), (1, 2, "Quick brown fox")], "doc_id int, page int, hint string")
    got = verified_hints(pages, hints)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "Quick  brown fox")] * 4
    # one generator spreads the hints after the only join
    plan = got._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")
