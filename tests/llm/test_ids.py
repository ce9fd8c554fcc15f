"""Ids beyond 2^53 stay whole in every operator, also beside nulls in one Arrow batch."""

import pytest

import corpus_pipeline as pipe
from docnav.llm import op1_toxicity, op2_quality, op3_licenses, op4_bpe, op5_mixing, op6_ngram_join, op7_secrets, op9_exact_topk, op10_fingerprint

from .conftest import LARGE

RUNS = {
    "op1": lambda d: op1_toxicity.score_documents(d, None),
    "op2": lambda d: op2_quality.score_documents(d, None),
    "op3": op3_licenses.scan,
    "op4": lambda d: op4_bpe.tokenize(d, op4_bpe.vocabulary_path(), with_ids=False),
    "op5": op5_mixing.mix_sources,
    "op6": op6_ngram_join.jaccard_components,
    "op7": op7_secrets.scan,
    "op7 redact": op7_secrets.redact,
    "op10": op10_fingerprint.fingerprints,
    "near_duplicates": lambda d: pipe.near_duplicates(d.sparkSession, d, ""),
    "mixing": lambda d: pipe.mixing(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", RUNS)
def test_ids_stay_whole(large, name):
    got = {r.doc_id for r in RUNS[name](large).collect()}
    assert got == {LARGE, None} | ({LARGE + 2} if name != "near_duplicates" else set())


def test_components_of_large_ids(large):
    assert {(r.doc_id, r.component_id) for r in op6_ngram_join.jaccard_components(large).collect()} == {(LARGE, LARGE), (LARGE + 2, LARGE), (None, None)}
    assert dict(op6_ngram_join.jaccard_components(large).dtypes)["n_shingles"] == "bigint"


def test_vector_ids(spark):
    rows = [(LARGE * 50, [0.5, 0.25]), (LARGE, [1.0, 0.5]), (None, [1.0, 1.0])]
    v = op9_exact_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert [tuple(r) for r in op9_exact_topk.exact_topk(v, v.where("id % 50 = 0")).collect()] == [(LARGE * 50, 1, LARGE, 128 * 256 + 64 * 128)]
