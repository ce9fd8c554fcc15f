import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from docnav.llm import op6_ngram_join, op7_secrets

from .conftest import DOCS, prose
from .test_op6_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows = []
    for i in range(240):
        toxic = i % 6 == 0
        words = prose(i, 40, 900).split()
        for k in range(5 if toxic else 0):
            words.insert(k * 7, ("vile", "rotten", "grubby")[k % 3])
        if i % 10 == 3:
            words.append("token = 04dbebab91ab85687d33eeaaf9ac699e1188f962")
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for j, i in enumerate((1, 2, 4, 1)):
        text = rows[i][1] + (" tail" if j % 2 else "")
        rows.append((300 + j, text, "en", "s1", len(text)))
    return rows, [(i, 1, int(i % 6 == 0)) for i in range(240)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_keep_the_columns_and_do_their_work(spark, folder):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = pipe.toxicity(spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and sum(i in ids for i in range(0, 240, 6)) <= 2 and sum(i in ids for i in range(240) if i % 6) >= 195
    one = pipe.near_duplicates(spark, docs, folder)
    want = {c for i, _, c in brute(rows, 5, (80, 100)) if i == c}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(want)
    masked = pipe.secrets(spark, docs, folder).collect()
    assert len(masked) == len(rows) and not any(re.search("[0-9a-f]{16}", r.text) for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    mixed = pipe.mixing(spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    before, after = size(docs), size(mixed)
    for s, w in zip(sorted(before), (5, 2, 1, 5), strict=True):
        assert after[s] == pytest.approx(sum(before.values()) * w / 13, rel=0.1)
    assert pipe.tokens(spark, docs, folder).count() == len(rows)


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipe.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    digest = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert digest(pipe.run(spark, folder)) == digest(docs)


def test_stages_take_odd_rows(spark, odd, none, folder):
    for name, stage in pipe.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns, name
        assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in odd.collect()}
        assert stage(spark, none, folder).count() == 0, name
    kept = [r.text for r in pipe.near_duplicates(spark, odd, folder).collect()]
    assert kept.count("one") == 1 and len(kept) == len(set(kept)) + 1  # texts without words are not linked: no text stays with id 0 and without an id
    assert pipe.tokens(spark, odd, folder).count() == odd.count()


def test_every_stage_uses_its_operator():
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    assert pipe.jaccard_components is op6_ngram_join.jaccard_components and pipe.redact is op7_secrets.redact
    assert DOCS.startswith("doc_id")
