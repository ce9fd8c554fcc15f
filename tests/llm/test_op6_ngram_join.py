import re

import pytest
from pyspark.sql import functions as F

from docnav.llm import op6_ngram_join as op

from .conftest import DOCS, prose


def brute(rows, k, t):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and t[1] * both >= t[0] * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(seed, n, copies, edits):
    """Copies of one text with a few words changed each."""
    import random

    r = random.Random(seed)
    base = prose(seed, n, 3000).split()
    for c in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(n)] = f"e{seed}_{c}_{r.random()}"
        yield " ".join(w)


@pytest.mark.parametrize(("k", "t"), [(3, (90, 100)), (5, (80, 100))])
def test_components_equal_brute_force(spark, k, t, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)  # several block pairs in a group, and in a list
    monkeypatch.setattr(op, "LIST", 24)
    texts = [x for s, (n, c, e) in enumerate([(12, 8, 1), (13, 6, 1), (22, 12, 1), (25, 9, 2), (33, 9, 2), (60, 20, 3), (150, 70, 8), (400, 12, 15)]) for x in family(s, n, c, e)]
    texts += [prose(900 + i, 5 + i % 30, 6) for i in range(60)]  # few words: many common shingles
    rows = [(1000 - i, x, "en", "s", None, "", "", 0) for i, x in enumerate(texts)]
    got = sorted((tuple(r) for r in op.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(7), k, t).collect()), key=str)
    assert got == brute(rows, k, t)


@pytest.mark.parametrize("boundary", [0, 9, 19])
def test_any_boundary_finds_the_same(spark, monkeypatch, boundary):
    monkeypatch.setattr(op, "_boundary", lambda *a: boundary)
    rows = [(i, x, "en", "s", None, "", "", 0) for i, x in enumerate(x for s in range(40) for x in family(s, 8 + s % 17, 4, 1))]
    got = sorted((tuple(r) for r in op.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == brute(rows, 3, (90, 100))


def test_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in op.jaccard_components(odd).collect()), key=str)
    assert got == brute(odd.collect(), 3, (90, 100))
    assert op.jaccard_components(none).count() == 0


def test_forest_spans_a_large_group_without_all_pairs(spark):
    rows = [(i, prose(5, 100) + f" end{i}", "en", "s", None, "", "", 0) for i in range(600)]
    got = op.jaccard_components(spark.createDataFrame(rows, DOCS))
    assert got.agg(F.countDistinct("component_id"), F.min("component_id")).first()[:] == (1, 0)


def test_forest_of_a_group_has_fewer_links_than_rows():
    import numpy as np

    sets = [np.unique(np.r_[np.arange(100), 1000 + i].astype(np.uint64)) for i in range(50)]
    size, maps = np.array([len(s) for s in sets]), [op._parity(s) for s in sets]
    for given in (None, sets):
        assert len(op.forest(list(range(50)), size, maps, np.zeros(50), (90, 100), given)) == 49


def test_maps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (10, 300, 2500, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[int(n * 0.05) :], rng.integers(0, 2**63, int(n * 0.04)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 90 * (len(a) + len(b) - both)
        found = op.forest([0, 1], np.array([len(a), len(b)]), [op._parity(a), op._parity(b)], np.zeros(2), (90, 100))
        assert found or not linked
