"""Captions and mentions of parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docnav.functions.text import caption, lines, mention_numbers, norm_caption, stands


def page_visuals(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, md)`` with figures, tables, mentions_figures, mentions_tables and has_visual_elements; no shuffle."""
    marked = F.transform(lines(F.col("md")), lambda x: F.struct(x.alias("line"), caption(x).alias("c")))
    own = lambda kind: F.array_distinct(F.transform(F.filter("marked", lambda x: x["c"]["kind"] == kind), lambda x: x["c"]["text"]))
    text = lambda table: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("marked", lambda x: x["c"].isNull()), lambda x: mention_numbers(x["line"], table)))))
    visual = (F.size(own("Figure")) > 0) | (F.size(own("Table")) > 0) | F.contains("md", F.lit("<!-- image -->"))
    out = pages.withColumn("marked", marked)
    return out.select(*pages.columns, own("Figure").alias("figures"), own("Table").alias("tables"), text(False).alias("mentions_figures"), text(True).alias("mentions_tables"), visual.alias("has_visual_elements"))


def with_structured(visuals: DataFrame, structured: DataFrame) -> DataFrame:
    """Captions of the parser's own structure win where a page has any; ``structured(doc_id, page, s_figures, s_tables)``."""
    both = visuals.join(structured, ["doc_id", "page"], "left")
    has = (F.size(F.coalesce("s_figures", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("s_tables", F.array().cast("array<string>"))) > 0)
    out = both.withColumn("figures", F.when(has, F.col("s_figures")).otherwise(F.col("figures"))).withColumn("tables", F.when(has, F.col("s_tables")).otherwise(F.col("tables")))
    return out.withColumn("captions_source", F.when(has, "docling").otherwise("markdown")).drop("s_figures", "s_tables")


def verified_hints(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints that stand on their page; ``hints(doc_id, page, hint)``. All hints of a page meet its text in one row, so that it is normalised once."""
    held = hints.groupBy("doc_id", "page").agg(F.collect_list("hint").alias("hints"))
    both = held.join(pages.select("doc_id", "page", norm_caption(F.col("md")).alias("text")), ["doc_id", "page"])
    return both.select("doc_id", "page", "text", F.explode("hints").alias("hint")).where(stands(F.col("hint"), F.col("text"))).select("doc_id", "page", "hint")
