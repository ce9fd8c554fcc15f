"""Files of runs: page texts, captions, results, manifests, reports."""

from __future__ import annotations

import html
import json
import os
import re
import shutil
import tarfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.functions.text import strip


def page_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, page, md) of files ``<doc>/page_NNN.md``."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path"))
    return text.select(F.regexp_extract("path", r"([^/]+)/(?:pages/)?page_\d+\.md$", 1).alias("doc_id"), F.regexp_extract("path", r"page_(\d+)\.md$", 1).cast("int").alias("page"), "md")


def with_fallback(parsed: DataFrame, native: DataFrame) -> DataFrame:
    """(doc_id, page, text): the parsed text unless it is blank, else the native one."""
    both = native.withColumnRenamed("text", "native").join(parsed, ["doc_id", "page"], "left")
    return both.select("doc_id", "page", F.when(strip(F.coalesce("md", F.lit(""))) != "", F.col("md")).otherwise(F.col("native")).alias("text"))


def structured_captions(items: DataFrame) -> DataFrame:
    """(doc_id, page, s_figures, s_tables) from ``items(doc_id, tables, pictures)``, arrays of struct<captions, pages>; items without caption or page are left out."""
    rows = None
    for column, name in (("pictures", "s_figures"), ("tables", "s_tables")):
        part = items.select("doc_id", F.posexplode(column).alias("i", "x")).select("doc_id", "i", F.array_min("x.pages").alias("page"), strip(F.concat_ws(" ", "x.captions")).alias("c"), F.lit(name).alias("kind"))
        rows = part if rows is None else rows.union(part)
    rows = rows.where("page is not null and c <> ''")
    lists = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", "c")))), lambda s: s["c"]).alias(kind)
    return rows.groupBy("doc_id", "page").agg(lists("s_figures"), lists("s_tables"))


RESULT = "run_id string, question string, gold_answer string, gold_answer_format string, raw_system_answer string, extracted_answer string, score double, score_official_rule double, error string"


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Scored runs from JSON lines or one JSON file a run; rows with an error are left out, old rows have the rules' score only."""
    found = spark.read.schema(RESULT).option("multiLine", "true").json([p for p in paths if p.endswith(".json")]) if any(p.endswith(".json") for p in paths) else None
    if lines := [p for p in paths if not p.endswith(".json")]:
        got = spark.read.schema(RESULT).json(lines)
        found = got if found is None else found.unionByName(got)
    return found.where("error is null and run_id is not null").withColumn("score", F.coalesce("score", "score_official_rule")).drop("error").orderBy("run_id")


QUESTION = "run_id string, doc_id string, question string, why_chosen string, gold struct<answer: string, answer_format: string, evidence_pages: array<int>, evidence_sources: array<string>>"


def batch_questions(spark: SparkSession, batch: str) -> DataFrame:
    """The questions of a finished batch, in order of their runs' folders."""
    return spark.read.schema(QUESTION).option("multiLine", "true").json(f"{batch}/*/00_input/question.json").orderBy("run_id")


def batch_scores(spark: SparkSession, batch: str) -> DataFrame:
    """(run_id, score) of a finished batch; old results have the rules' score only."""
    found = spark.read.schema(RESULT).option("multiLine", "true").json(f"{batch}/*/06_evaluation/result.json")
    return found.select("run_id", F.coalesce("score", "score_official_rule").alias("score"))


def newest_batch(spark: SparkSession, root: str) -> str:
    """The folder itself if it has a manifest, else the subfolder whose manifest is the newest, else the folder."""
    from pyspark.errors import AnalysisException

    listing = "path string, modificationTime timestamp, length long, content binary"
    for pattern in (f"{root}/manifest.json", f"{root}/*/manifest.json"):
        try:
            found = spark.read.schema(listing).format("binaryFile").load(pattern).agg(F.max_by("path", "modificationTime").alias("p")).first()["p"]
        except AnalysisException:
            continue
        if found:
            return found.rsplit("/", 1)[0]
    return root


def discovered_runs(spark: SparkSession, batch: str) -> DataFrame:
    """(ord, run_id) of the runs of a batch's manifest, each once at its first place, that have a question."""
    entries = spark.read.text(f"{batch}/manifest.json", wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.runs"), "array<struct<run_id: string>>")).alias("ord", "e"))
    once = entries.groupBy(F.col("e.run_id").alias("run_id")).agg(F.min("ord").alias("ord"))
    return once.join(batch_questions(spark, batch).select("run_id"), "run_id", "left_semi").select("ord", "run_id").orderBy("ord")


def collected(spark: SparkSession, batch: str) -> DataFrame:
    """(run_id, artefacts): the text files of each run of a batch, as a map from their path within the run's folder to their content."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl,md,txt,log}").text(batch, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    stem = batch.rstrip("/").split("://")[-1].lstrip("/")
    inside = text.withColumn("inner", F.substring_index("path", stem + "/", -1)).where("inner like '%/%'")
    entry = F.struct(F.regexp_replace("inner", "^[^/]+/", "").alias("k"), F.col("value").alias("v"))
    return inside.groupBy(F.substring_index("inner", "/", 1).alias("run_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("artefacts"))


def run_entries(results: DataFrame) -> DataFrame:
    """What a batch's manifest says of each run: ``results(run_id, doc_id, question, score, score_source, score_official_rule, raw_system_answer, error)``."""
    ok = F.col("error").isNull()
    return results.select("run_id", "doc_id", "question", F.when(ok, "ok").otherwise("failed").alias("status"), *[F.when(ok, F.col(c)).alias(n) for c, n in (("score", "score"), ("score_source", "score_source"), ("score_official_rule", "score_rules"), ("raw_system_answer", "answer"))], "error")


def write_visuals(visuals: DataFrame, path: str) -> None:
    """Captions and mentions of pages as JSON lines, dealt by document."""
    visuals.repartition("doc_id").write.mode("overwrite").json(path)


def publish(target: str, write: Callable[[str], None]) -> bool:
    """Let ``write`` fill a local folder that appears under its name only when it is complete; False if it is there already."""
    if os.path.exists(target):
        return False
    parent, name = os.path.split(os.path.abspath(target))
    os.makedirs(parent, exist_ok=True)
    half = os.path.join(parent, f".{name}.tmp")
    shutil.rmtree(half, ignore_errors=True)  # what an earlier, interrupted run has left
    os.makedirs(half)
    write(half)
    os.rename(half, target)
    return True


def extract_archive(archive: str, target: str) -> bool:
    """The files of a local tar archive in a folder that appears when all are there; members that would leave the folder are refused."""

    def write(folder: str) -> None:
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")

    return publish(target, write)


def export_images(pages: DataFrame, folder: str) -> DataFrame:
    """(doc_id, files): page images ``pages(doc_id, page, image)`` as ``folder/<doc_id>/<page>.png``; a document's folder appears when all its pages are written, and one that is there is left
    alone. The folder must be one that all executors share."""

    def run(batches):
        import pyarrow as pa

        at, held = None, []

        def close():
            def write(half: str) -> None:
                for page, image in held:
                    with open(f"{half}/{page}.png", "wb") as f:
                        f.write(image)

            publish(f"{folder}/{at}", write)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(held)], pa.int32())], ["doc_id", "files"])

        for batch in batches:
            for doc_id, page, image in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "image")), strict=True):
                if doc_id != at:
                    if held:
                        yield close()
                    at, held = doc_id, []
                held.append((page, image))
        if held:
            yield close()

    rows = pages.where("image is not null").selectExpr("cast(doc_id as string) as doc_id", "page", "image")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInArrow(run, "doc_id string, files int")


def markdown_html(md: str) -> str:
    """Headings, lists, tables, bold and code of Markdown as HTML; everything else is a paragraph, and all text is escaped."""

    def inline(t: str) -> str:
        return re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", html.escape(t)))

    out: list[str] = []
    kind = ""
    for line in [*md.splitlines(), ""]:
        now = "ul" if line.startswith("- ") else "table" if line.startswith("|") else ""
        if kind and now != kind:
            out.append(f"</{kind}>")
        if now and now != kind:
            out.append(f"<{now}>")
        kind = now
        if m := re.match(r"(#{1,6}) (.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif now == "ul":
            out.append(f"<li>{inline(line[2:])}</li>")
        elif now == "table":
            if not re.fullmatch(r"[|\s:-]+", line):
                out.append("<tr>" + "".join(f"<td>{inline(c.strip())}</td>" for c in line.strip("|").split("|")) + "</tr>")
        elif line.strip():
            out.append(f"<p>{inline(line)}</p>")
    return "\n".join(out)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_pages(pages: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Parsed pages by split, without documents that are there already."""
    new = pages if done is None else pages.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    new.write.mode("append").partitionBy("split").parquet(path)


def manifest(runs: DataFrame, most: int | None = None) -> DataFrame:
    """Runs of ``runs(run_id, ord)`` in order, each once at its first place, ``most`` at most."""
    once = runs.groupBy("run_id").agg(F.min("ord").alias("ord")).orderBy("ord")
    return once if most is None else once.limit(most)


def batch_name(label: str, date: str, taken: set[str]) -> str:
    """``<label>_<date>``, with a number behind it if that is taken."""
    base = f"{re.sub(r'[^A-Za-z0-9_-]+', '-', label).strip('-') or 'batch'}_{date}"
    return next(n for n in [base, *(f"{base}_{i}" for i in range(2, len(taken) + 3))] if n not in taken)


def html_report(runs: DataFrame, title: str, most: int = 20) -> str:
    """One page with the first ``most`` runs of the manifest order; only these rows reach the driver."""
    rows = [json.loads(x) for x in runs.orderBy("ord").limit(most).toJSON().collect()]
    names = [c for c in runs.columns if c != "ord"]
    cell = lambda r, c: f"<td>{html.escape(str(r.get(c, '')))}</td>"
    body = "".join("<tr>" + "".join(cell(r, c) for c in names) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in names)}</tr>{body}</table>"
