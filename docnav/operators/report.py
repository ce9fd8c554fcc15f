"""Summaries of scored runs, and the choice and resumption of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean(c, where=None):
    """A mean that is 0 without rows."""
    return F.round(F.coalesce(F.avg(c if where is None else F.when(where, c)), F.lit(0.0)), 6)


def baseline_summary(results: DataFrame, total: int | None = None) -> DataFrame:
    """By format, and over all (format null), in one pass by grouping sets: ``results(format, gold, extracted, score, gold_pages, gold_page_in_context, truncated, pages_sent, pages_total,
    prompt_tokens, completion_tokens)``, where gold_pages and the page columns are numbers of pages. ``total`` is the number of questions asked: failed ones have no result and count as 0."""
    unanswerable = F.trim("gold") == "Not answerable"
    answered = ~F.lower(F.trim("extracted")).isin("not answerable", "")
    out = results.rollup("format").agg(
        F.count("*").alias("questions"), mean(F.col("score")).alias("accuracy"), mean(F.col("score"), ~unanswerable).alias("accuracy_answerable"), mean(F.col("score"), unanswerable).alias("accuracy_unanswerable"),
        mean(F.col("score"), answered).alias("precision"), mean(F.col("score"), F.col("gold_pages") == 1).alias("single_page"), mean(F.col("score"), F.col("gold_pages") > 1).alias("multi_page"),
        F.round(F.avg(F.when(F.col("gold_pages") > 0, F.coalesce(F.col("gold_page_in_context"), F.lit(False)).cast("double"))), 6).alias("gold_page_in_context"), F.count_if("truncated").alias("truncated"),
        F.count_if(F.col("pages_sent") < F.col("pages_total")).alias("documents_cut"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("completion_tokens"),
        F.sum("score").alias("__sum"),
    )
    p, r = F.col("precision"), F.col("accuracy_answerable")
    asked = F.when(F.col("format").isNull(), F.greatest(F.lit(1), F.lit(total) if total is not None else F.col("questions")))
    out = out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)).withColumn("accuracy_failed_counted_zero", F.round(F.coalesce("__sum", F.lit(0.0)) / asked, 6))
    return out.drop("__sum")


def judge_summary(scores: DataFrame) -> DataFrame:
    """By format, and over all (format null): ``scores(format, rules, extraction, judge, extract_parse_ok, verdict, empty, asked)``. Means skip nulls; ``asked`` tells that a verdict was asked for."""
    of = lambda c: F.round(F.avg(c), 6)
    return scores.rollup("format").agg(
        F.count("*").alias("judged"), of("rules").alias("rules_mean"), of("extraction").alias("extraction_mean"), of("judge").alias("judge_mean"), F.count_if(~F.col("extract_parse_ok")).alias("extraction_unparsed"),
        F.count_if(F.col("asked") & F.col("verdict").isNull() & ~F.col("empty")).alias("judge_unparsed"), F.count_if("empty").alias("empty_answers"),
    )


def agreement(scores: DataFrame, threshold: float = 0.999) -> DataFrame:
    """One row: how often two scorers call an answer right or wrong together."""
    a, b = F.col("rules") >= threshold, F.col("judge") >= threshold
    return scores.where("judge is not null").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("rules_only"), F.count_if(~a & b).alias("judge_only"), F.count_if(~a & ~b).alias("neither"))


def flips(scores: DataFrame, limit: int = 40, threshold: float = 0.999) -> DataFrame:
    """The first ``limit`` disagreements of each direction, by run."""
    a, b = F.col("rules") >= threshold, F.col("judge") >= threshold
    ways = scores.where("judge is not null").withColumn("direction", F.when(a & ~b, "rules_only").when(~a & b, "judge_only")).where("direction is not null")
    place = F.row_number().over(Window.partitionBy("direction").orderBy("run_id"))
    return ways.withColumn("n", place).where(F.col("n") <= limit).select("direction", "run_id")


def cost_rollup(calls: DataFrame) -> DataFrame:
    """By step, and over all (step null): ``calls(step, cached, prompt_tokens, completion_tokens, cost, latency)``; costs to 6 places, seconds to 2."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    return calls.rollup("step").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached"), total("prompt_tokens").cast("long").alias("prompt_tokens"), total("completion_tokens").cast("long").alias("completion_tokens"),
        F.round(total("cost"), 6).alias("cost"), F.round(total("latency"), 2).alias("latency"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; a maximum by key combines before the shuffle, where a window would not."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def pending(wanted: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """What is wanted and has not finished without an error."""
    return wanted.join(finished.where("error is null").select(key), key, "left_anti")


def match_sample_set(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Questions that a sample set asks for, each with its first match; a null question stands for all of its document.

    ``questions(doc_id, qa_id, question)``, ``wanted(ord, doc_id, question)``.
    """
    w = wanted.select("ord", "doc_id", F.col("question").alias("asked"))
    both = questions.join(w, "doc_id").where(F.col("asked").isNull() | (F.col("asked") == F.col("question")))
    first = both.groupBy("doc_id", "qa_id", "question").agg(F.min("ord").alias("ord"))
    return first


def unmatched(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted questions that no document asks in these words."""
    return wanted.where("question is not null").join(questions.select("doc_id", "question"), ["doc_id", "question"], "left_anti")


def first_documents(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n documents in order of appearance: ``rows(doc_id, ord, ...)``; the n documents are few and are broadcast by size."""
    docs = rows.groupBy("doc_id").agg(F.min("ord").alias("first")).orderBy("first").limit(n)
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi")


def per_document(rows: DataFrame, k: int, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def settings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that both have with different values."""
    return old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key").where("old <> new")
