"""Readers of question-answering datasets: a registry of functions from a folder to DataFrames of pages and questions.

Pages and evidence pages are counted from 0 here; ``to_run_specs`` shifts them to 1 as the later steps count.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docnav.functions.udfs import parse_list

READERS: dict[str, Callable[[SparkSession, str, str], dict[str, DataFrame]]] = {}
SPLITS = {"mmlongbench_doc": ("train",), "mpdocvqa": ("train", "val", "test"), "slidevqa": ("train", "val", "test")}


class MissingData(FileNotFoundError):
    """Data that must be fetched by hand, with where it comes from."""


def register(name: str):
    def keep(f):
        READERS[name] = f
        return f

    return keep


def load(spark: SparkSession, name: str, path: str, split: str) -> dict[str, DataFrame]:
    if name not in READERS:
        raise ValueError(f"unknown dataset {name}; there are {', '.join(sorted(READERS))}")
    if split not in SPLITS[name]:
        raise ValueError(f"{name} has the splits {', '.join(SPLITS[name])}")
    return READERS[name](spark, path, split)


def require_path(path: str, homepage: str, instructions: str) -> str:
    """For local folders; other stores fail on reading."""
    if "://" not in path and not os.path.exists(path):
        raise MissingData(f"{path} is missing. Get it from {homepage}: {instructions}")
    return path


def _in_order(rows: DataFrame, key: str, item, name: str) -> DataFrame:
    """Items of a key as one ordered list."""
    return rows.groupBy(key).agg(F.min("ord").alias("ord"), F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("x")))), lambda s: s["x"]).alias(name))


def parse_mmlongbench(rows: DataFrame) -> DataFrame:
    """Rows with JSON evidence pages (from 1, become from 0) and Python-notation evidence sources, numbered within documents by ``ord``."""
    qa = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.select(
        "doc_id", F.first("doc_type").over(Window.partitionBy("doc_id").orderBy("ord")).alias("doc_type"), qa.alias("qa_id"), "question", F.col("answer").cast("string").alias("answer"),
        F.transform(F.from_json("evidence_pages", "array<int>"), lambda p: p - 1).alias("evidence_pages"), parse_list("evidence_sources").alias("evidence_sources"), "answer_format",
    )


def numbered(df: DataFrame) -> DataFrame:
    """Rows in the order of their files, by which groups and first rows are told."""
    return df.withColumn("ord", F.monotonically_increasing_id())


@register("mmlongbench_doc")
def mmlongbench_doc(spark: SparkSession, path: str, split: str) -> dict[str, DataFrame]:
    return {"questions": parse_mmlongbench(numbered(spark.read.parquet(path)))}


def parse_mpdocvqa(records: DataFrame) -> dict[str, DataFrame]:
    """Pages of each document from its first record, questions from all; the first answer counts, the rest are alternatives; test records have none."""
    answers = F.array_distinct(F.coalesce("answers", F.array().cast("array<string>")))
    questions = records.select(
        F.col("image_id").alias("doc_id"), F.col("question_id").alias("qa_id"), "question", F.get(answers, F.lit(0)).alias("answer"), F.slice(answers, F.lit(2), F.greatest(F.size(answers), F.lit(1))).alias("alternatives"),
        F.when(F.col("answer_page_idx").isNotNull(), F.array("answer_page_idx")).otherwise(F.array().cast("array<int>")).alias("evidence_pages"),
    )
    first = records.groupBy("image_id").agg(F.min_by(F.struct("image_name", "ocr_tokens", "ocr_normalized_boxes"), "ord").alias("r"))
    words = F.arrays_zip(F.element_at("r.ocr_tokens", F.col("page") + 1).alias("text"), F.element_at("r.ocr_normalized_boxes", F.col("page") + 1).alias("bbox"))
    pages = first.select(F.col("image_id").alias("doc_id"), "r", F.posexplode("r.image_name").alias("page", "image"))
    pages = pages.select("doc_id", "page", F.concat("doc_id", F.lit("#"), F.col("page").cast("string")).alias("sample_id"), "image", F.when(F.size(F.element_at("r.ocr_tokens", F.col("page") + 1)) > 0, words).alias("words"))
    return {"pages": pages, "questions": questions}


class ImdbReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted([os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".npy")] if os.path.isdir(self.path) else [self.path])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import numpy as np

        for i, r in enumerate(np.load(partition.value, allow_pickle=True)[1:]):  # the first record is a header
            answers = r.get("answers")
            yield (i, int(r["question_id"]), str(r["question"]), str(r["image_id"]), [str(x) for x in r["image_name"]], r.get("answer_page_idx"), None if answers is None else [str(a) for a in answers], [[str(t) for t in p] for p in r["ocr_tokens"]], [[[float(v) for v in b] for b in p] for p in r["ocr_normalized_boxes"]])


class ImdbSource(DataSource):
    """``spark.read.format("imdb").load(path)``: records of .npy files, one partition a file. Only files from a trusted source should be
    read, as the format holds pickled objects."""

    @classmethod
    def name(cls) -> str:
        return "imdb"

    def schema(self) -> str:
        return "ord long, question_id long, question string, image_id string, image_name array<string>, answer_page_idx int, answers array<string>, ocr_tokens array<array<string>>, ocr_normalized_boxes array<array<array<double>>>"

    def reader(self, schema) -> ImdbReader:
        return ImdbReader(self.options["path"])


@register("mpdocvqa")
def mpdocvqa(spark: SparkSession, path: str, split: str) -> dict[str, DataFrame]:
    spark.dataSource.register(ImdbSource)
    return parse_mpdocvqa(spark.read.format("imdb").load(os.path.join(require_path(path, "the task's site", "unpack the imdb archive here"), f"imdb_{split}.npy")))


BOXES = "array<struct<bbox_id: int, class: string, bbox: array<double>>>"


def parse_boxes(lines: DataFrame) -> DataFrame:
    """(deck_name, page, objects) from JSON lines ``(ord, value)``; the last line of a deck counts; pages become from 0; labels are numbered by place."""
    last = lines.where(F.trim("value") != "").select("ord", F.get_json_object("value", "$.deck_name").alias("deck_name"), F.from_json(F.get_json_object("value", "$.bboxes"), "array<array<string>>").alias("p"))
    last = last.groupBy("deck_name").agg(F.max_by("p", "ord").alias("p"))
    each = last.select("deck_name", F.explode("p").alias("x")).select("deck_name", (F.element_at("x", 1).cast("int") - 1).alias("page"), F.from_json(F.element_at("x", 2), BOXES).alias("b"))
    return each.select("deck_name", "page", F.transform("b", lambda o, i: F.struct(i.alias("label_value"), o["class"].alias("label_name"), o["bbox"].alias("bbox"))).alias("objects"))


def parse_slidevqa(rows: DataFrame, boxes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Questions ("None" expressions become null, pages from 0) and pages up to the first missing image, with their objects."""
    columns = sorted((c for c in rows.columns if c.startswith("page_")), key=lambda c: int(c[5:]))
    expression = F.nullif(F.col("arithmetic_expression"), F.lit("None"))
    questions = rows.select(F.col("deck_name").alias("doc_id"), "qa_id", "question", "answer", expression.alias("arithmetic_expression"), F.transform("evidence_pages", lambda p: p - 1).alias("evidence_pages"))
    images = F.array(*columns)
    gap = F.array_position(F.transform(images, lambda x: x.isNull()), True)
    first = rows.groupBy("deck_name").agg(F.min_by(F.struct(*columns), "ord").alias("r")).select("deck_name", "r.*")
    pages = first.select(F.col("deck_name").alias("doc_id"), F.posexplode(F.when(gap > 0, F.slice(images, F.lit(1), (gap - 1).cast("int"))).otherwise(images)).alias("page", "image"))
    if boxes is not None:
        pages = pages.join(boxes.withColumnRenamed("deck_name", "doc_id"), ["doc_id", "page"], "left")
    return {"pages": pages, "questions": questions}


@register("slidevqa")
def slidevqa(spark: SparkSession, path: str, split: str) -> dict[str, DataFrame]:
    boxes = numbered(spark.read.text(f"{path}/bboxes/{split}.jsonl"))
    return parse_slidevqa(numbered(spark.read.parquet(f"{path}/{split}")), parse_boxes(boxes))


def documents(questions: DataFrame) -> DataFrame:
    """(doc_id, qas): one row per document with its questions in order."""
    rows = questions.withColumn("ord", F.col("qa_id"))
    return _in_order(rows, "doc_id", F.struct(*[c for c in questions.columns if c != "doc_id"]), "qas").drop("ord")


def to_run_specs(questions: DataFrame, split: str = "train", per_document: int | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(run_id, doc_id, qa_id, question, why_chosen, gold): evidence pages from 1.

    Without ``chosen`` the first ``per_document`` questions of each document, named ``<split>_<document>_q<nn>``. With the samples ``chosen(ord, run_id, doc_id, question, why_chosen)`` the
    questions that they ask for: a question takes the first sample of its document that asks for it, or for all questions, and is named by it.
    """
    number = F.format_string("q%02d", F.col("qa_id").cast("long"))
    gold = F.struct(F.col("answer"), F.transform("evidence_pages", lambda p: p + 1).alias("evidence_pages"), F.col("qa_id").alias("qa_id"), F.lit(split).alias("split"))
    if chosen is None:
        stem = F.substring(F.regexp_replace(F.col("doc_id").cast("string"), r"\.[^.]*$", ""), 1, 24)
        out = questions.withColumn("run_id", F.concat_ws("_", F.lit(split), stem, number)).withColumn("why_chosen", F.lit(""))
        if per_document is not None:
            place = F.row_number().over(Window.partitionBy("doc_id").orderBy("qa_id"))
            out = out.withColumn("n", place).where(F.col("n") <= per_document)
    else:
        asked = chosen.select("doc_id", F.struct("ord", F.col("run_id").alias("set_run_id"), F.col("question").alias("asked"), "why_chosen").alias("w"))
        both = questions.join(asked, "doc_id").where(F.col("w.asked").isNull() | (F.col("w.asked") == F.col("question")))
        first = both.groupBy("doc_id", "qa_id").agg(F.min("w").alias("w"))
        out = questions.join(first, ["doc_id", "qa_id"]).withColumn("run_id", F.when(F.col("w.asked").isNull(), F.concat_ws("_", "w.set_run_id", number)).otherwise(F.col("w.set_run_id"))).withColumn("why_chosen", F.col("w.why_chosen"))
    return out.select("run_id", "doc_id", "qa_id", "question", "why_chosen", gold.alias("gold"))


def missing_files(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """``wanted(doc_id)`` without those whose file is in ``listed(path)``."""
    there = listed.select(F.element_at(F.split("path", "/"), -1).alias("doc_id")).distinct()
    return wanted.join(there, "doc_id", "left_anti")


def page_counts(items: DataFrame) -> DataFrame:
    """(doc_id, page, tables, pictures): items of a parsed document by the pages that they stand on, from ``items(doc_id, kind, pages)``. An item on several pages counts on its first."""
    at = items.select("doc_id", "kind", F.array_min("pages").alias("page")).where("page is not null")
    return at.groupBy("doc_id", "page").agg(F.count_if(F.col("kind") == "table").cast("int").alias("tables"), F.count_if(F.col("kind") == "picture").cast("int").alias("pictures"))


def whole_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of documents of which no page failed, (doc_id, failed, error) of the others): a document with holes is never kept."""
    bad = parsed.where("error is not null").groupBy("doc_id").agg(F.count("*").alias("failed"), F.min("error").alias("error"))
    return parsed.join(bad.select("doc_id"), "doc_id", "left_anti"), bad


def rendered(documents: DataFrame, render: Callable[[bytes, int, int], bytes], max_side: int = 1024) -> DataFrame:
    """(doc_id, page, image) of ``documents(doc_id, content, page)`` by ``render(content, page, max_side)``; a page that cannot be rendered is null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            images = []
            for content, page in zip(batch.column("content"), batch.column("page"), strict=True):
                try:
                    images.append(render(content.as_py(), page.as_py(), max_side))
                except Exception:  # noqa: BLE001  one corrupt page does not end a batch
                    images.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array(images, pa.binary())], ["doc_id", "page", "image"])

    return documents.selectExpr("cast(doc_id as string) as doc_id", "cast(page as int) as page", "content").mapInArrow(run, "doc_id string, page int, image binary")


def parse_remote(rows: DataFrame, client, attempts: int = 6) -> DataFrame:
    """``rows(doc_id, content)`` through a parsing service, with one client a partition made by ``client()``: (doc_id, page, md, tables, pictures, error).

    A call is tried ``attempts`` times with waits of 5 s, 10 s, ... up to 60 s; an error of the caller's (``PermissionError``, or one with a status_code of 400 to 499) is not tried again. A document of which a page fails gives
    one row with the error.
    """

    def run(batches):
        import time

        import pandas as pd

        parse = client()
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                for attempt in range(attempts):
                    try:
                        out += [(doc_id, page, md, tables, pictures, None) for page, md, tables, pictures in parse(content)]
                        break
                    except Exception as e:  # noqa: BLE001  the error becomes a row
                        status = getattr(e, "status_code", None)
                        if attempt == attempts - 1 or isinstance(e, PermissionError) or (isinstance(status, int) and 400 <= status < 500):
                            out.append((doc_id, None, None, None, None, f"{type(e).__name__}: {e}"[:400]))
                            break
                        time.sleep(min(60, 5 * 2**attempt))
            yield pd.DataFrame(out, columns=["doc_id", "page", "md", "tables", "pictures", "error"]).astype({"page": "Int32", "tables": "Int32", "pictures": "Int32"})

    return rows.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, md string, tables int, pictures int, error string")
