"""Five stages from raw documents to token ids.

1. toxicity: documents that the classifier rejects (by the threshold of their language) go.
2. near_duplicates: of each group of documents linked by 5-word shingles with a Jaccard similarity of 0.8 or more the one with the
   smallest id stays.
3. secrets: what the scan finds is masked, and n_chars is counted anew.
4. mixing: a document is repeated as often as the mix takes its words, rounded (0 to 3 times); documents without words
   stay as they are.
5. tokens: ids of the whole texts, with digests of the ids and of the decoded text.

Defined results: each stage takes what its operator takes (null, empty and very long texts, repeated rows, empty tables, extra
columns of any names, which are kept up to stage 4). In stage 2, rows that are equal in id and text become one; a document is named by its id,
so of rows with one id and several texts all stay if one of them does; a row without an id cannot be named, so it
stays unless it equals another one. In stage 4, rows that are equal in all columns are mixed as rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, bounded_batches, load, unused
from docnav.llm.op1_toxicity import accepted, fit
from docnav.llm.op4_bpe import tokenize, vocabulary_path
from docnav.llm.op5_mixing import mix_sources
from docnav.llm.op6_ngram_join import jaccard_components
from docnav.llm.op7_secrets import redact

_NO_ID = -(1 << 63)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs.withColumn("doc_id", F.col("doc_id").cast("long")), load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    groups = jaccard_components(docs, k=5, t=(80, 100))
    key, copy = unused(docs, "key"), unused(docs, "copy")
    names = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    own = F.row_number().over(Window.partitionBy(key, F.md5("text")).orderBy(key))
    # named rows are dealt by the key already, so the numbers need no further shuffle; rows without an id are dealt by their texts
    named = docs.withColumn(key, F.col("doc_id").cast("long")).join(names, key).withColumn(copy, own)
    others = docs.where("doc_id is null").withColumn(key, F.lit(None).cast("long")).withColumn(copy, own)
    return named.unionByName(others).where(F.col(copy) == 1).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, whole, other, times, copy = (unused(docs, c) for c in ("key", "whole", "other", "times", "copy"))
    # 128 bits tell rows apart
    keyed = docs.withColumns({whole: F.xxhash64(*docs.columns), other: F.xxhash64(F.lit(7), *reversed(docs.columns)), key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))})
    mixed = mix_sources(keyed, keys=(key, whole, other))
    rounded = F.when(F.sum("size") == 0, F.count("*")).otherwise(F.floor(F.count("*") * F.sum("taken") / F.sum("size") + 0.5))
    copies = mixed.groupBy(key, whole, other).agg(rounded.cast("int").alias(times)).where(F.col(times) > 0)
    rows = keyed.join(copies, [key, whole, other])
    one = F.row_number().over(Window.partitionBy(key, whole, other).orderBy(key))
    rows = rows.withColumn(copy, one).where(F.col(copy) == 1).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return tokenize(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens),
]

#: A trained classifier and a hash order of documents are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
