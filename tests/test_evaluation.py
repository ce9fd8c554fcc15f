"""Judging, evaluation rows, reports, the page index and chat texts on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from docnav.functions import chat as C
from docnav.operators import evaluation as E
from docnav.operators import indexing as I


def judged(spark, rows, model, mode="both"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, gold_answer string, gold_format string, response string")
    return E.judged(df, model, mode).orderBy("i").collect()


def test_judging_reads_replies_and_asks_nothing_about_empty_answers(spark):
    def model(kind, prompt):
        assert "EMPTY" not in prompt
        if "boom" in prompt:
            raise TimeoutError("late")
        if kind == "extract":
            return "Extracted answer: 21%\nAnswer format: Float" if "about a fifth" in prompt else "no idea"
        return "Extracted answer: 21\nVerdict: [Correct]\nReason: same" if "about a fifth" in prompt else "hm"

    rows = [("q", "0.21", "Float", "about a fifth"), ("q EMPTY", "x", "Str", "  "), ("q", "blue", "Str", "The answer is: blue."), ("boom", "x", "Str", "y")]
    a, b, c, d = judged(spark, rows, model)
    assert (a.extracted, a.extract_score, a.verdict, a.judge_score, a.judge_reason, a.judge_error) == ("21%", 1.0, "Correct", 1.0, "same", None)
    assert (b.empty, b.extracted, b.extract_score, b.verdict, b.judge_score, b.judge_error) == (True, "", 0.0, "Incorrect", 0.0, None)
    assert (c.extract_parse_ok, c.extracted, c.extract_score, c.verdict, c.judge_score) == (False, "blue", 1.0, None, None)
    assert d.judge_error == "TimeoutError: late" and d.judge_score is None and d.extract_score is None
    only = judged(spark, rows[:1], model, "judge")[0]
    assert only.extract_score is None and only.judge_score == 1.0
    with pytest.raises(ValueError, match="none of"):
        judged(spark, rows, model, "x")


def test_records_are_judged_once(spark):
    items = spark.createDataFrame([("a", "q", "x", "Str", "x" * 2000, 0.0), ("b", "q", "x", "Str", "x", 0.0)], "run_id string, question string, gold_answer string, gold_format string, response string, original_score double")
    done = spark.createDataFrame([("a", None), ("b", "failed")], "run_id string, judge_error string")
    assert [r.run_id for r in E.judge_records(items, done).collect()] == ["b"]
    assert {len(r.response) for r in E.judge_records(items, done.where("run_id = 'c'")).collect()} == {1500, 1}


def test_summaries_and_times(spark):
    results = spark.createDataFrame([("r", "q", "g", "Str", "a", 0.5, "rules", 0.5, False, "answered", "ACCEPT", None, True, 1, 3)], "run_id string, question string, gold_answer string, gold_answer_format string, raw_system_answer string, score double, score_source string, score_official_rule double, correct boolean, agent_status string, verifier_decision string, cited_page_hit boolean, gold_page_visited_by_agent boolean, rounds int, tool_calls_total int")
    stats = spark.createDataFrame([("r", 2, "OCR_ONLY (no text)"), ("r", 1, "EMPTY (x)"), ("r", 3, None)], "run_id string, page int, flag string")
    odd = spark.createDataFrame([("r", 2, "REPEATED_CALL", "x")], "run_id string, turn int, type string, detail string")
    text = E.run_summaries(results, stats, odd).first().summary
    assert "| Score | 0.50 (WRONG), rules |" in text and "p1: EMPTY; p2: OCR_ONLY" in text and "- REPEATED_CALL: x" in text and "| Gold page cited | None |" in text
    times = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "split string, seconds double")
    assert tuple(E.load_times(times).first()) == ("a", 2, 1.0, 3.0, 2.0)


PAGES = "doc_id string, page int, md string, chars int"
VISUALS = "doc_id string, page int, figures array<string>, tables array<string>, mentions_figures array<int>, mentions_tables array<int>, has_visual_elements boolean"


def parts(spark):
    pages = spark.createDataFrame([("d", 1, "# First page\nwith Figure 1: a long caption here", 60), ("d", 2, "", 0), ("d", 3, "third page boom", 50)], PAGES)
    return pages, spark.createDataFrame([("d", 1, ["Figure 1: a"], [], [], [], True), ("d", 2, [], [], [], [], False), ("d", 3, [], [], [], [], False)], VISUALS)


def model(kind, prompt):
    if "boom" in prompt and kind == "page_summary":
        raise ValueError("no")
    if kind == "page_summary":
        return json.dumps({"title": "T" * 200, "summary": "S" * 700, "keywords": [str(i) for i in range(20)], "figures": ["Figure 1: a long caption", "Figure 7: not there at all"]})
    if kind == "image_summary":
        return f"```json\n{json.dumps({'title': 'Seen', 'summary': prompt})}\n```"
    if "invalid" in prompt:
        return json.dumps([{"ord": 1, "title": "A", "start_page": 1, "end_page": 3}, {"ord": 2, "parent_ord": 1, "title": "B", "start_page": 1, "end_page": 2}, {"ord": 3, "parent_ord": 1, "title": "C", "start_page": 3, "end_page": 3}])
    return json.dumps([{"ord": 1, "title": "A", "start_page": 1, "end_page": 9}])


def test_index_of_a_document(spark):
    made = I.build(*parts(spark), model)
    r = {x.page: x for x in made["records"].collect()}
    assert (len(r[1].title), len(r[1].summary), len(r[1].keywords), r[1].figures, r[1].source) == (120, 600, 10, ["Figure 1: a", "Figure 1: a long caption"], "text")
    assert (r[2].source, r[2].title, r[2].summary, r[2].has_visual_elements, r[2].error) == ("image", "Seen", "d 2", True, None)
    assert (r[3].title, r[3].error, r[3].keywords) == ("third page boom", "ValueError: no", [])
    assert [(s.section_id, s.depth, s.leaf, s.title) for s in made["sections"].orderBy("ord").collect()] == [("S1", 0, False, "A"), ("S1.1", 1, True, "B"), ("S1.2", 1, True, "C")]
    d = made["diagnostics"].first()
    assert (d.n_pages, d.from_image, d.summary_failures, d.hierarchy_attempts, d.hierarchy_fallback_used, d.sections) == (3, 1, 1, 2, False, 1)
    text = made["outlines"].first().outline.split("\n")
    assert text[2] == "- [S1] A  (pages 1-3)" and text[4] == f"    - p1: {'T' * 120} [text] [Figures: Figure 1: a, Figure 1: a long caption]" and text[5] == "    - p2: Seen [image] [Visuals]"


def test_summarised_pages_are_kept_and_take_new_captions(spark):
    pages, visuals = parts(spark)
    old = I.summaries(pages, visuals, model=model).where("page = 1").withColumn("title", F.lit("kept"))
    new = visuals.withColumn("figures", F.array(F.lit("Figure 9: z")))
    got = {r.page: r for r in I.summaries(pages, new, old, model).collect()}
    assert len(got) == 3 and (got[1].title, got[1].figures) == ("kept", ["Figure 9: z"])


def test_trees_that_stay_invalid_are_repaired(spark):
    records = spark.createDataFrame([("d", p, f"t{p}", "s") for p in (1, 2, 3)], "doc_id string, page int, title string, summary string")
    bad = lambda kind, prompt: json.dumps([{"ord": 1, "title": "A", "start_page": 2, "end_page": 9}, {"ord": 2, "parent_ord": 1, "title": "sub", "start_page": 1, "end_page": 1}])
    got = I.hierarchy(records, bad).orderBy("ord").collect()
    assert [(r.title, r.start_page, r.end_page, r.attempts, r.fallback_used) for r in got] == [("Pages 1-1 (unassigned by LLM)", 1, 1, 2, True), ("A", 2, 3, 2, True)]


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_chat_texts(spark):
    assert one(spark, C.fill("{a} and {b}, {a}", a=F.lit("{b}"), b=F.lit("B"))) == "{b} and B, {b}"
    assert one(spark, C.after_thinking(F.lit("x</think> y</think> z"))) == "y</think> z"
    assert one(spark, C.caption_tokens(F.array(F.lit("Figure 01: a"), F.lit("Table 12. b"), F.lit("no")))) == ["figure1", "table12"]
    urls = [one(spark, f(F.lit(u))) for f in (C.chat_url, C.models_url) for u in ("http://h/v1/", "http://h", "http://h/v1/chat/completions")]
    assert urls == ["http://h/v1/chat/completions"] * 3 + ["http://h/v1/models"] * 3
    assert one(spark, C.data_uri(F.lit("x" * 100).cast("binary"), F.lit("jpg"))).startswith("data:image/jpeg;base64,eHh4") and "\n" not in one(spark, C.data_uri(F.lit("x" * 100).cast("binary"), F.lit("png")))
    none = F.lit(None).cast("array<string>")
    plan = F.struct(F.lit("figure").alias("question_type"), F.lit(None).cast("string").alias("expected_answer_format"), F.lit(True).alias("needs_visual_inspection"), F.array(F.lit("g1"), F.lit("g2")).alias("sub_goals"), F.array(F.lit("q")).alias("search_queries"), none.alias("candidate_sections"), F.array(F.lit(2), F.lit(3)).alias("anchor_pages"))
    more = F.create_map(F.lit("max_hops"), F.lit("3"), F.lit("_error"), F.lit("x"))
    assert one(spark, C.plan_markdown(plan, more)) == "- **Question Type**: figure (Expected Format: unspecified)\n- **Needs Visual Inspection**: True\n- **Sub-goals**:\n  - g1\n  - g2\n- **Search Queries**: `q`\n- **Anchor Pages**: 2, 3\n- **Max Hops**: 3"
    m = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(None).cast("string").alias("name"), F.lit(text).alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    flat = one(spark, C.flatten(F.array(m("system", "a"), m("user", "u"), m("system", "b"), m("system", "a"), m("tool", "t"))))
    assert [(x.role, x.content) for x in flat] == [("system", "a\n\nb"), ("user", "u"), ("tool", "t")]
    assert one(spark, C.redacted(F.lit('{"kind": "binary", "data": "QUJD"}'))) == '{"kind": "binary", "data": "<4 base64 chars>"}' and one(spark, C.redacted(F.lit('{"data": "QUJD"}'))) == '{"data": "QUJD"}'
    r = F.struct(F.struct(F.lit(5).alias("input_tokens"), F.lit(6).alias("output_tokens"), F.lit(None).cast("double").alias("cost")).alias("usage"), F.struct(F.lit(0.5).alias("cost")).alias("provider_details"))
    assert tuple(one(spark, C.usage(r))) == (5, 6, 0.5)
    kept = one(spark, C.sampling(F.create_map(F.lit("temperature"), F.lit("0"), F.lit("max_tokens"), F.lit("600")), True, scale=2.5))
    assert kept == {"max_tokens": "1500", "temperature": "0.6", "top_p": "0.95", "top_k": "20"}
    assert C.form_data({"ocr": True, "engine": None, "formats": ["json"]}) == {"ocr": "true", "formats": ["json"]}
