"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from docnav.llm.op1_toxicity import op1_toxicity
    from docnav.llm.op2_quality import op2_quality
    from docnav.llm.op3_licenses import op3_licenses
    from docnav.llm.op4_bpe import op4_bpe
    from docnav.llm.op5_mixing import op5_mixing
    from docnav.llm.op6_ngram_join import op6_ngram_join
    from docnav.llm.op7_secrets import op7_secrets
    from docnav.llm.op8_warc import op8_warc
    from docnav.llm.op9_exact_topk import op9_exact_topk
    from docnav.llm.op10_fingerprint import op10_fingerprint
    from docnav.llm.op11_alignment import op11_alignment
    from docnav.llm.op12_divergence import op12_divergence
    from docnav.llm.op13_language_model import op13_language_model

    found = (
        op1_toxicity, op2_quality, op3_licenses, op4_bpe, op5_mixing, op6_ngram_join, op7_secrets, op8_warc, op9_exact_topk, op10_fingerprint,
        op11_alignment, op12_divergence, op13_language_model,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from docnav.llm import op7_secrets, op8_warc, op9_exact_topk, op12_divergence

    parts = {"op7_secrets": op7_secrets, "op8_warc": op8_warc, "op9_exact_topk": op9_exact_topk, "op12_divergence": op12_divergence}
    return {name: part.ORACLE for name, part in parts.items()}
