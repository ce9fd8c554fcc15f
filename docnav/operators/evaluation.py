"""Scores of answers: rules, extraction and judging by a model, evaluation rows, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docnav.functions.chat import fill
from docnav.functions.metrics import eval_score, pick_score, score_extracted
from docnav.functions.text import extract_answer, parse_extraction, parse_verdict, strip
from docnav.operators.calls import ModelFn, call_model

#: What a model is asked; both are parameters of ``judged``.
EXTRACTION = "Give the final answer of the analysis and its format (Integer, Float, String, List or None).\nReply with two lines:\nExtracted answer: [answer]\nAnswer format: [format]\n\nQuestion: {question}\nAnalysis: {response}\n"
JUDGEMENT = "Does the response give the same answer as the gold answer?\nReply with three lines:\nExtracted answer: [answer]\nVerdict: [Correct or Incorrect]\nReason: [one sentence]\n\nQuestion: {question}\nGold answer: {gold_answer}\nAnswer format: {answer_format}\nResponse: {response}\n"
CORRECT = 0.999


def scripted_judge(kind: str, prompt: str) -> str:
    """A deterministic judge: it takes the response for the answer, and calls it correct if it contains the gold answer."""
    field = lambda name: next((x.split(": ", 1)[1] for x in prompt.split("\n") if x.startswith(f"{name}: ")), "")
    if kind == "extract":
        return f"Extracted answer: {field('Analysis')}\nAnswer format: String"
    gold, response = field("Gold answer"), field("Response")
    return f"Extracted answer: {response}\nVerdict: {'Correct' if gold.lower() in response.lower() else 'Incorrect'}\nReason: compared"


def judged(answers: DataFrame, model: ModelFn = scripted_judge, mode: str = "judge", extraction: str = EXTRACTION, judgement: str = JUDGEMENT) -> DataFrame:
    """``answers(question, gold_answer, gold_format, response, ...)`` with mode, empty, extracted, extract_parse_ok, extract_score, judge_extracted, verdict, judge_reason,
    judge_score and judge_error.

    ``mode`` is extract, judge or both. An empty response is wrong without a call. A reply that cannot be read gives the rules' extraction, or a null score; a call
    that fails gives its message and no score.
    """
    if mode not in ("extract", "judge", "both"):
        raise ValueError(f"{mode} is none of extract, judge and both")
    empty = strip(F.coalesce("response", F.lit(""))) == ""
    parts = {"question": F.col("question"), "gold_answer": F.col("gold_answer"), "answer_format": F.col("gold_format"), "response": F.col("response")}
    ask = lambda on, template: F.when(~empty, fill(template, **parts)) if on else F.lit(None).cast("string")
    rows = answers.withColumn("__p", ask(mode != "judge", extraction))
    rows = call_model(rows, "extract", "__p", "extract_raw", model, error="__e1") if mode != "judge" else rows.withColumn("extract_raw", F.lit(None).cast("string")).withColumn("__e1", F.lit(None).cast("string"))
    # after a failed extraction nothing more is asked
    rows = rows.withColumn("__p", F.when(F.col("__e1").isNull(), ask(mode != "extract", judgement)))
    rows = call_model(rows, "judge", "__p", "judge_raw", model, error="__e2") if mode != "extract" else rows.withColumn("judge_raw", F.lit(None).cast("string")).withColumn("__e2", F.lit(None).cast("string"))
    told, verdict = parse_extraction(F.col("extract_raw")), parse_verdict(F.col("judge_raw"))
    replied = F.col("extract_raw").isNotNull()
    rows = rows.withColumn("extracted", F.when(empty, "").when(replied, F.coalesce(told["answer"], extract_answer(F.col("response")))))
    zero = lambda on: F.when(empty & F.lit(on), 0.0)
    return rows.withColumns(
        {
            "mode": F.lit(mode), "empty": empty, "extract_parse_ok": F.when(replied, told["answer"].isNotNull()), "extract_score": F.when(empty, 0.0).when(replied, score_extracted(F.col("gold_answer"), F.col("extracted"), F.col("gold_format"))),
            "judge_extracted": verdict["answer"], "verdict": F.when(empty, "Incorrect").otherwise(verdict["verdict"]), "judge_reason": F.when(F.col("judge_raw").isNotNull(), verdict["reason"]),
            "judge_score": zero(True).when(verdict["verdict"].isNotNull(), (verdict["verdict"] == "Correct").cast("double")), "judge_error": F.coalesce("__e1", "__e2"),
        }
    ).drop("__p", "__e1", "__e2", "extract_raw", "judge_raw")


def judge_records(items: DataFrame, done: DataFrame, model: ModelFn = scripted_judge, mode: str = "both") -> DataFrame:
    """Records of ``items(run_id, question, gold_answer, gold_format, response, original_score)`` that ``done(run_id, ..., judge_error)`` has not without an error, with responses cut at 1500
    characters. What is returned is to be appended to the table of ``done``."""
    todo = items.join(done.where("judge_error is null").select("run_id"), "run_id", "left_anti")
    return judged(todo, model, mode).withColumn("response", F.substring("response", 1, 1500)).drop("question")


def hits(pages: Column, gold: Column) -> Column:
    """Whether pages have one of the gold pages; null without gold pages."""
    return F.when(F.size(gold) > 0, F.arrays_overlap(pages, gold))


def evaluation_rows(runs: DataFrame, mode: str = "judge") -> DataFrame:
    """One result per run of ``runs(run_id, question, gold, final_answer, agent_status, decision, cited_pages, pages_read, inspected_pages, round, calls, judge)``.

    ``gold`` is a struct of answer, answer_format, evidence_pages (from 1) and evidence_sources, ``judge`` a struct of judge_score, extract_score and error, null without a judge.
    """
    extracted, gold = extract_answer(F.coalesce("final_answer", F.lit(""))), F.col("gold")
    rows = runs.withColumn("extracted_answer", extracted).withColumn("score_official_rule", eval_score(gold["answer"], F.col("extracted_answer"), gold["answer_format"]))
    failed = F.coalesce(F.col("judge.error").isNotNull(), F.lit(False))
    picked = pick_score(F.lit(mode), F.col("score_official_rule"), F.col("judge").isNotNull(), failed, F.col("judge.judge_score"), F.col("judge.extract_score"))
    none = F.array().cast("array<int>")
    visited = F.array_sort(F.array_union(F.coalesce("pages_read", none), F.coalesce("inspected_pages", none)))
    rows = rows.withColumn("__s", picked).withColumn("pages_visited", visited).withColumn("__g", F.coalesce(gold["evidence_pages"], none))
    return rows.select(
        "run_id", "question", gold["answer"].alias("gold_answer"), gold["answer_format"].alias("gold_answer_format"), F.col("__g").alias("gold_evidence_pages"), gold["evidence_sources"].alias("gold_evidence_sources"),
        F.col("final_answer").alias("raw_system_answer"), "extracted_answer", F.col("__s.score").alias("score"), F.col("__s.source").alias("score_source"), "score_official_rule", (F.col("__s.score") >= CORRECT).alias("correct"),
        "agent_status", F.col("decision").alias("verifier_decision"), "cited_pages", hits(F.coalesce("cited_pages", none), F.col("__g")).alias("cited_page_hit"), hits(F.col("pages_visited"), F.col("__g")).alias("gold_page_visited_by_agent"),
        "pages_visited", F.col("round").alias("rounds"), F.col("calls").alias("tool_calls_total"),
    )


def direct_rows(answers: DataFrame, mode: str = "judge") -> DataFrame:
    """Results of the direct-context baseline: its answers with ``gold`` and ``judge`` as above, and gold_page_in_context. A failed call scores 0."""
    none = F.array().cast("array<int>")
    runs = answers.select("*", F.col("raw_answer").alias("final_answer"), F.lit(None).cast("string").alias("agent_status"), F.lit(None).cast("string").alias("decision"), none.alias("cited_pages"), F.col("pages_sent").cast("array<int>").alias("pages_read"), none.alias("inspected_pages"), F.lit(1).alias("round"), F.lit(0).alias("calls"))
    scored = evaluation_rows(runs, mode).select("run_id", "gold_answer", "gold_answer_format", "gold_evidence_pages", F.col("gold_page_visited_by_agent").alias("gold_page_in_context"), "score", "score_source", "score_official_rule")
    both = answers.join(scored, "run_id")
    zero = lambda c: F.when(F.col("error").isNotNull(), 0.0).otherwise(F.col(c)).alias(c)
    return both.select(*[c for c in answers.columns if c not in ("gold", "judge")], "gold_answer", "gold_answer_format", "gold_evidence_pages", "gold_page_in_context", zero("score"), "score_source", zero("score_official_rule"))


def batch_report(results: DataFrame) -> DataFrame:
    """One row over a batch: ``results(status, score, score_source, score_official_rule, cost)``; failed runs have no scores."""
    ok = F.col("status") == "ok"
    return results.agg(
        F.count("*").alias("runs"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("score"))), 6).alias("mean_score"), F.round(F.avg(F.when(ok, F.col("score_official_rule"))), 6).alias("mean_rule_score"),
        F.count_if(ok & (F.col("score_source") == "rules_fallback")).alias("judge_failed"), F.round(F.sum(F.when(ok, F.col("cost"))), 4).alias("total_cost"),
    )


def run_summaries(results: DataFrame, stats: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(run_id, summary): a run's outcome, flags of its document's pages and anomalies as Markdown. ``stats(run_id, page, flag)``, ``anomalies(run_id, turn, type, detail)``."""
    text = lambda label, value: F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    flag = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": "), F.substring_index("flag", " (", 1))
    flags = stats.where("flag is not null").groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", flag.alias("f")))), lambda x: x["f"]), "; ").alias("flags"))
    one = F.concat(F.lit("- "), "type", F.lit(": "), F.substring("detail", 1, 300))
    odd = anomalies.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("a")))), lambda x: x["a"]), "\n").alias("odd"))
    both = results.join(flags, "run_id", "left").join(odd, "run_id", "left")
    score = F.concat(F.format_string("%.2f", "score"), F.when(F.col("correct"), " (CORRECT)").otherwise(" (WRONG)"))
    lines = [
        F.concat(F.lit("# "), "run_id"), F.lit(""), F.concat(F.lit("**Question:** "), "question"), F.concat(F.lit("**Gold:** "), word("gold_answer"), F.lit(" ("), word("gold_answer_format"), F.lit(")")), F.lit(""), F.lit("| | |"), F.lit("|---|---|"),
        text("System answer", word("raw_system_answer")), text("Score", F.concat(score, F.lit(", "), word("score_source"))), text("Rule-based score", F.format_string("%.2f", "score_official_rule")), text("Status / decision", F.concat(word("agent_status"), F.lit(" / "), word("verifier_decision"))),
        text("Gold page cited", word("cited_page_hit")), text("Gold page visited", word("gold_page_visited_by_agent")), text("Rounds / tool calls", F.concat(word("rounds"), F.lit(" / "), word("tool_calls_total"))), F.lit(""),
        F.lit("## Parser flags"), F.coalesce(F.nullif(F.substring("flags", 1, 1500), F.lit("")), F.lit("none")), F.lit("## Anomalies"), F.coalesce("odd", F.lit("- none")),
    ]
    return both.select("run_id", F.concat_ws("\n", *lines).alias("summary"))


def load_times(times: DataFrame) -> DataFrame:
    """(split, n, min, max, avg) of ``times(split, seconds)``."""
    return times.groupBy("split").agg(F.count("*").alias("n"), *[F.round(f("seconds"), 6).alias(name) for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def caption_totals(visuals: DataFrame) -> DataFrame:
    """(doc_id, figures, tables) captions of each document, from its pages."""
    return visuals.groupBy("doc_id").agg(F.sum(F.size("figures")).alias("figures"), F.sum(F.size("tables")).alias("tables"))
