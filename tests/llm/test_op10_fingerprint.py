import hashlib

import numpy as np
import pytest

from docnav.llm import op10_fingerprint as op

from .conftest import DOCS, prose


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_hot_ids_and_rows_without_one_are_dealt_into_parts(spark):
    texts = [prose(i, 8, 10**6) for i in range(300)]
    rows = [(5 if i < 120 else None if i < 220 else 2**53 + 1 + i, t, "en", "s", None, "", "", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    sizes = [r["count"] for r in op.with_next(frame, 12).where("halo = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 50
    got = {r.fingerprint: r for r in op.fingerprints(frame, 12).collect()}
    assert {r.doc_id for r in got.values()} == {r[0] for r in rows}
    h = {r.text: r.h for r in op.with_next(frame, 12).collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    for r, after in zip(line, line[1:] + line[:1], strict=True):
        k = len(r[1]) // 3
        assert got[op.fingerprint(r[1]).hex()].edited_sha256 == hashlib.sha256((r[1][:-k] + after[1][:k]).encode()).hexdigest()


@pytest.mark.parametrize("parts", [2, 3, 90])
def test_edits_and_neighbours_equal_brute_force(spark, parts):
    rows = [(i * 3, prose(i, i % 50, 50) + "é" * (i % 4), "en", "s", None, "", "", 0) for i in range(150)]
    got = {r.doc_id: r for r in op.fingerprints(spark.createDataFrame(rows, DOCS).repartition(4), parts).collect()}
    line = ordered(rows)
    assert len(got) == len(rows)
    for r, after in zip(line, line[1:] + line[:1], strict=True):
        text, k = r[1], len(r[1]) // 3
        edited = (text[:-k] if k else text) + after[1][:k]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == op.fingerprint(text).hex() and g.edited_fingerprint == op.fingerprint(edited).hex()
        assert g.near_edited == op.likeness(op.fingerprint(text), op.fingerprint(edited))
        assert g.near_next == op.likeness(op.fingerprint(text), op.fingerprint(after[1]))


def test_estimates_are_near_the_true_similarity():
    off = []
    for n in (10, 40, 200, 2000):
        for seed in range(40):
            a, b = prose(seed, n, 10**6).split(), prose(seed + 999, n, 10**6).split()
            text, other = " ".join(a), " ".join(a[: n * (seed % 10) // 10] + b[n * (seed % 10) // 10 :])
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split(), other.split()))
            off.append(op.likeness(op.fingerprint(text), op.fingerprint(other)) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_odd_rows(spark, odd, none):
    got = op.fingerprints(odd, 3).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    by_text = {}
    for r in odd.collect():
        by_text.setdefault(op.fingerprint(r.text).hex(), set()).add(r.text or "")
    assert {r.fingerprint for r in got} == set(by_text)
    assert op.fingerprints(none).count() == 0
    one = op.fingerprints(odd.where("doc_id = 12"), 3).first()
    assert one.near_next == 1.0
    assert op.likeness(b"", b"") == 1.0 and op.likeness(b"", op.fingerprint("a")) == 0.0


@pytest.mark.parametrize("n", [1, 3, 5, 6, 8, 12])
def test_texts_of_few_shingles_that_share_none_are_not_alike(n):
    marks = [op.fingerprint(prose(seed, n, 10**6)) for seed in range(300)]
    assert len(set(marks)) == len(marks)
    near = [op.likeness(a, b) for a, b in zip(marks, marks[1:], strict=False)]
    assert max(near) < 0.1 and np.mean(near) < 0.02
