import random
import zlib

import numpy as np

from docnav.llm import op2_quality as op

from .conftest import DOCS, prose


def corpus(n=600):
    r = random.Random(4)
    for i in range(n):
        text, bad = prose(i, 30 + i % 200, 3000).capitalize() + ".", i % 4 == 0
        if bad:
            text = [" ".join(w + "##" for w in text.split()), text.upper(), (text[:40] + "\n") * 9, " | ".join(text.split())][r.randrange(4)]
        yield i, text, int(not bad)


def test_held_out_rows_are_told_apart(spark):
    rows = list(corpus())
    docs = spark.createDataFrame([(i, x, "en", "s", None, "", "", 0) for i, x, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in op.score_documents(docs, op.fit(docs, labels)).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([[g > b for g, q in held if q] for b, q in held if not q]) > 0.97
    assert np.mean([(s >= op.CUT) == q for s, q in held]) > 0.93


def test_traversal_equals_walking_one_by_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(op.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(int)
    forest = op.grow(x, y, np.ones(500))
    assert np.mean((forest.score(x) > 0.5) == y) > 0.9
    for row, score in zip(x[:50], forest.score(x[:50]), strict=True):
        z = forest.bias
        for feature, value, leaf in zip(forest.feature, forest.value, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > value[node] else 1)
            z += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_statistics_use_the_whole_text():
    text = prose(1, 30000, 5000)
    assert op.statistics(text) != op.statistics(text + " ***" * 2000)
    assert len(op.statistics("x")) == len(op.FEATURES) and all(np.isfinite(op.statistics("é\n\nü")))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    forest = op.fit(odd, labels)
    got = op.score_documents(odd, forest).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert op.score_documents(none, forest).count() == 0
    assert op.fit(none, labels) is None
    assert {r.score for r in op.score_documents(odd, None).collect()} == {0.0}
