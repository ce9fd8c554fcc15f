"""Scoring answers as they arrive: a folder of JSON lines is read as a stream, and each run is scored once."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docnav.functions.metrics import eval_score
from docnav.functions.text import extract_answer
from docnav.sources.keyed import KeyedTable

ANSWER = "run_id string, gold string, format string, response string"


def scored(answers: DataFrame) -> DataFrame:
    extracted = extract_answer(F.col("response"))
    return answers.withColumn("extracted", extracted).withColumn("score", eval_score(F.col("gold"), F.col("extracted"), F.col("format")))


SCORED = ANSWER + ", extracted string, score double"


def score_store(spark: SparkSession, target: str) -> KeyedTable:
    return KeyedTable(spark, target, SCORED, key="run_id")


def score_folder(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the scores of new answers to the keyed table ``target`` and stop when all files are read. A run that is there already is not scored again, for which
    only the buckets of the batch's runs are read; a batch that is written again after a restart has its name in the table already."""
    store = score_store(spark, target)

    def write(batch: DataFrame, number: int) -> None:
        part = f"{zlib.crc32(checkpoint.encode()):08x}-{number}"
        new = batch.dropDuplicates(["run_id"])
        known = store.lookup(new).select("run_id")
        store.append(scored(new.join(known, "run_id", "left_anti")), part)

    return spark.readStream.schema(ANSWER).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
