import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docnav.llm import op9_exact_topk as op

SCHEMA = "vec_id long, embedding array<float>, label int, v int, block int"


def brute(rows, k=5):
    import math

    seen = sorted({(r[0], tuple(math.floor(256 * np.float64(np.float32(c))) for c in r[1])) for r in rows if r[0] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1])})
    out = []
    for i, q in seen:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in seen if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def run(frame, k=5):
    v = op.quantised(frame, "vec_id", "embedding")
    return sorted(tuple(r) for r in op.exact_topk(v, v.where(F.col("id") % 50 == 0), k).collect())


@pytest.mark.parametrize("scale", [0.01, 0.3, 40.0])
def test_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(op, "INDEX_BLOCK", 100)
    monkeypatch.setattr(op, "QUERY_BLOCK", 3)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, scale) for _ in range(16)], 0, 0, 0) for i in range(700)]
    rows += [(1000 + i, rows[50][1], 0, 0, 0) for i in range(120)]  # one very common vector
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2], 0, 0, 0), (0, [0.1, 0.2], 0, 0, 0), (0, [0.5, 0.5], 0, 0, 0), (1, None, 0, 0, 0), (2, [nan, 1.0], 0, 0, 0), (3, [inf, 1.0], 0, 0, 0), (4, [None, 1.0], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0), (5, [], 0, 0, 0), (6, [1.0, 2.0, 3.0], 0, 0, 0), (7, [0.0, 0.0], None, None, None), (8, [-0.5, 0.25], 0, 0, 0), (50, [1.0] * 3, 0, 0, 0), (100, [2.0**22] * 3, 0, 0, 0)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_it_stops_early_only_with_proof():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(0, 60, (500, 32))), np.floor(rng.normal(0, 60, (20, 32)))
    x[:, 1:] *= rng.random((500, 31)) < 0.2  # few large components
    best, work = op.Best(20, 5), [0]
    for part in np.split(np.arange(500), 5):
        op.search_block(q, np.arange(1000, 1020), op.indexed(part, x[part]), best, work)
    for i in range(20):
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]))[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.score[i], best.id[i], strict=True)] == want
    assert work[0] < 0.9 * np.count_nonzero(x) * 20


def test_segments_hold_each_posting_once_by_falling_impact():
    x = np.floor(np.random.default_rng(2).normal(0, 90, (60, 8)))
    b = op.indexed(np.arange(60), x)
    seen = np.zeros_like(x)
    for s in range(len(b.level)):
        vec = b.vec[b.start[s] : b.start[s + 1]]
        value = x[vec, b.dim[s]]
        assert ((2.0 ** b.level[s] <= np.abs(value)) & (np.abs(value) < 2.0 ** (b.level[s] + 1))).all()
        seen[vec, b.dim[s]] += value
    assert (seen == x).all() and (np.diff(b.level) <= 0).all()


def test_rounds_of_queries_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "QUERY_BLOCK", 2)
    monkeypatch.setattr(op, "ROUND_BYTES", 300)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 0.2, 12)], 0, 0, 0) for i in range(600)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
