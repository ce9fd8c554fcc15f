import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docnav.llm import op13_language_model as op


def words(text):
    return [w.decode() for w in (text or "").encode().translate(op.LOWER).split()]


def out_of_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows):
    """The unigram columns, token by token."""
    c = Counter(w for i, text in rows if not out_of_fold(i) for w in [*words(text), ""])
    n, v = sum(c.values()), len(c)
    return [(i, out_of_fold(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), ""]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), ""])) for i, t in rows]


def agree(got, want):
    def key(r):
        return (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert all(r[6] <= 1e-9 and math.isfinite(r[6]) for r in got)


def tables(texts):
    """A vocabulary of the texts, and all words with their counts."""
    c = Counter(w for t in texts for w in [*words(t), ""])
    head = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: op.HEAD]
    rank = {w: i for i, (w, _) in enumerate(head)}
    n, many = np.zeros(op.TAIL, np.int64), np.zeros(op.TAIL, np.int64)
    for w, k in c.items():
        if w not in rank:
            n[op.tail_class(w)] += k
            many[op.tail_class(w)] += 1
    return op.Vocabulary(rank, np.array([k for _, k in head]), n + 0.5 * (many + 1), sum(c.values()), len(c)), c


TEXTS = [" ".join(random.Random(i).choices([f"w{k}" for k in range(90)], k=5 + 7 * (i % 9))) for i in range(40)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(op, "HEAD", 40)
    monkeypatch.setattr(op, "CLASS", 8)
    monkeypatch.setattr(op, "TAIL", 5)


def test_columns_and_learning(spark):
    """Whole query on the small tables: counts as by brute force, and texts that were not learned from are likelier than by single words."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = op.score_documents(df).collect()
    agree(got, brute([(r["doc_id"], r["text"]) for r in df.collect()]))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    again = op.score_documents(df.repartition(3)).collect()
    assert np.allclose(*(np.array(sorted((r["doc_id"], r["score"]) for r in x)) for x in (got, again)), rtol=1e-5)


def test_odd_rows(spark, odd, none):
    agree(op.score_documents(odd).collect(), brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert op.score_documents(none).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(40) if out_of_fold(i)][:3]
    rows = [(i, x) for i, x in zip(ids, ("a b", "", None), strict=True)]
    got = op.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    agree(got, brute(rows))
    assert all(abs(r["base_score"]) < 1e-9 and r["train_tokens"] == 0 for r in got)


def test_probabilities_add_up(small):
    """After any history the head's words, and the tail's known words with one unseen word in each class, make up one."""
    v, c = tables(TEXTS)
    net = op.train(op.Network.start(v), op.stream_of(pa.array(TEXTS), v)[0], v, 30)
    h = np.random.default_rng(1).normal(0, 0.5, (3, op.STATE)).astype(np.float32)
    head, total = len(v.count), np.zeros(3)
    for target in range(head + op.TAIL):
        total += np.exp(net.log_prob(h, np.full(3, target), head))
    assert np.allclose(total, 1, atol=1e-4)
    for k in range(op.TAIL):
        own = [w for w in c if w not in v.rank and op.tail_class(w) == k]
        assert sum((c[w] + 0.5) / v.tail[k] for w in own) + 0.5 / v.tail[k] == pytest.approx(1)


def test_starts_as_unigrams(small):
    v, c = tables(TEXTS)
    net = op.Network.start(v)
    ids, ends, numbers, found = op.stream_of(pa.array(TEXTS), v)
    got = op.log_probs(net, net.entered(), ids, ends, v)
    names = found.to_pylist()
    for d, text in enumerate(TEXTS):
        tail = [w for w in words(text) if w not in v.rank]
        want = sum(math.log((c[w] + 0.5) / (v.total + 0.5 * v.distinct)) for w in [*words(text), ""])
        mine = got[d] + sum(math.log((c[w] + 0.5) / v.tail[op.tail_class(w)]) for w in tail)
        assert mine == pytest.approx(want, rel=0.02)
    assert len(names) == len(c) - 1


@pytest.mark.parametrize("lanes", [1, 3, 64])
@pytest.mark.parametrize("window", [1, 5, 64])
def test_state_is_carried(small, monkeypatch, lanes, window):
    """Whatever the lanes and windows, a document's probability is that of one plain pass over its words."""
    monkeypatch.setattr(op, "LANES", lanes)
    monkeypatch.setattr(op, "WINDOW", window)
    v, _ = tables(TEXTS)
    net = op.train(op.Network.start(v), op.stream_of(pa.array(TEXTS), v)[0], v, 30)
    texts = [*TEXTS[:9], "", None, " ".join(TEXTS[:30]), "never seen"]
    ids, ends, _, _ = op.stream_of(pa.array(texts), v)
    got = op.log_probs(net, net.entered(), ids, ends, v)
    for d, text in enumerate(texts):
        own, h, total, before = v.ids([*words(text), ""]), np.zeros(op.STATE), 0.0, v.end
        for i in own.tolist():
            a, x = h @ net.keep, net.embed[before] @ net.enter + net.shift
            z, r = 1 / (1 + np.exp(-(x + a)[: op.STATE])), 1 / (1 + np.exp(-(x + a)[op.STATE : 2 * op.STATE]))
            c = np.tanh(x[2 * op.STATE :] + r * a[2 * op.STATE :])
            h = (1 - z) * c + z * h
            total += float(net.log_prob(h.astype(np.float32)[None], np.array([i]), len(v.count))[0])
            before = i
        assert got[d] == pytest.approx(total, rel=1e-4)


def test_gradients(small):
    v, _ = tables(TEXTS)
    net = op.train(op.Network.start(v), op.stream_of(pa.array(TEXTS), v)[0], v, 20)
    net = op.Network(*[a.astype(np.float64) for a in net.arrays()])
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, len(v.count) + op.TAIL, (6, 4)) for _ in range(2))
    x[2, 1] = v.end
    h0 = rng.normal(0, 0.3, (4, op.STATE))
    g, _, _ = op.gradients(net, x, y, h0, v.end, len(v.count))
    for a, b in zip(net.arrays(), g, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if a is net.embed:
                at = (int(x[3, 2]), at[1])
            if a[at] < -1e6:
                continue
            old, e, loss = a[at], 1e-2, []
            for step in (e, -e):
                a[at] = old + step
                loss.append(op.gradients(net, x, y, h0, v.end, len(v.count))[2])
            a[at] = old
            assert (loss[0] - loss[1]) / (2 * e) == pytest.approx(float(b[at]), rel=0.05, abs=2e-4)


def test_every_document_is_learned_from(spark, monkeypatch):
    """Words that follow each other in long texts only, and in rows beyond any sample, are learned; shards and rounds see each row."""
    long = " ".join(["ping pong"] * 4000)
    rows = [(i, long if i % 7 == 0 else " ".join(random.Random(i).choices([f"w{k}" for k in range(30)], k=20))) for i in range(210)]
    got = op.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["score"] > 0.5 * r["base_score"] for r in got if r["n_tokens"] > 8000)
    for shard, least in ((50, 0), (10**9, 1)):
        monkeypatch.setattr(op, "SHARD_TOKENS", shard)
        monkeypatch.setattr(op, "LEAST", least)
        seen = []
        monkeypatch.setattr(op, "averaged", lambda weights: seen.append(weights) or None)
        v, _ = tables(TEXTS)
        docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
        op.fit(docs, v)
        assert len(seen) == op.ROUNDS


def test_tail_classes_are_those_of_each_word():
    """From sliced arrays too; the vocabulary's ids take Arrow words as well as lists."""
    r = random.Random(3)
    some = ["", "a", "ab", "é", "中", "abc", "\x00", "x" * 300, *("".join(r.choices("aé中😀z\x00", k=r.randrange(0, 7))) for _ in range(500))]
    array = pa.array(some, pa.string())
    assert op.tail_classes(array).tolist() == [op.tail_class(w) for w in some]
    assert op.tail_classes(array.slice(3, 100)).tolist() == [op.tail_class(w) for w in some[3:103]]
    assert op.tail_classes(pa.array([], pa.string())).tolist() == [] and op.tail_classes(pa.array([""], pa.string())).tolist() == [op.tail_class("")]
    v, c = tables(TEXTS)
    assert v.ids(pa.array([*c, "unseen"])).tolist() == v.ids([*c, "unseen"]).tolist() == [v.rank[w] for w in c] + [len(v.count) + op.tail_class("unseen")]


def test_softmax_without_a_shift_is_the_same():
    x = np.random.default_rng(1).normal(0, 9, (50, 96)).astype(np.float32)
    shifted, bare = op.softmax(x.copy(), 7), op.softmax(x.copy(), 7, True)
    assert np.allclose(shifted, bare, rtol=1e-4) and np.allclose(shifted.sum(1) * 7, 1, atol=1e-4)
    weight, bias = np.abs(x).max(0) * 0, x[0]
    assert op.near(weight, bias) and not op.near(weight, bias + 100) and not op.near(weight, bias - 200) and not op.near(weight + 200, bias)


def test_counts_that_come_along_need_no_join(spark, monkeypatch):
    """Frequent words outside the head are counted without being asked for; what is asked for are the others; results are those without any such words."""
    rows = [(i, t) for i, t in enumerate([*TEXTS, "rare once", "w1 " + "x" * 200 + " " + "x" * 200, None])]
    docs, asked, original = spark.createDataFrame(rows, "doc_id long, text string"), [], op.block_values
    monkeypatch.setattr(op, "HEAD", 40)
    monkeypatch.setattr(op, "block_values", lambda blocks, keys, *rest: asked.append({w for r in blocks.select(keys).collect() for w in r[keys]}) or original(blocks, keys, *rest))
    results = []
    for known in (0, 70, 1 << 17):
        monkeypatch.setattr(op, "KNOWN", known)
        got = op.score_documents(docs).collect()
        agree(got, brute(rows))
        results.append(sorted((r["doc_id"], r["score"]) for r in got))
    assert np.allclose(results[0], results[1], rtol=1e-6) and np.allclose(results[0], results[2], rtol=1e-6)
    assert len(asked[0]) > len(asked[1]) > len(asked[2]) and "x" * 200 in asked[2]


def test_states_of_planes(small):
    """Training and scoring step through the same states, lane by lane, as the plain equations; starting states are left as they are."""
    v, _ = tables(TEXTS)
    net, rng = op.Network.start(v), np.random.default_rng(5)
    x, h = rng.integers(0, len(v.count) + op.TAIL, (7, 5)), rng.normal(0, 0.3, (5, op.STATE)).astype(np.float32)
    x[0, 1] = x[3, 2] = x[4, 2] = v.end
    planes, first = net.planes(net.entered()).take(x.reshape(-1), axis=1).reshape(3, 7, 5, op.STATE), h.copy()
    advanced = net.advance(planes.copy(), x == v.end, h, net.planes(net.keep))
    before, after, _ = net.steps(planes, x == v.end, h)
    assert (h == first).all() and np.allclose(advanced, after, atol=1e-6)
    for t in range(7):
        own = np.where((x[t] == v.end)[:, None], 0, h if t == 0 else after[t - 1])
        a, e = own @ net.keep, net.entered()[x[t]]
        z, r = (1 / (1 + np.exp(-(e + a)[:, i * op.STATE : (i + 1) * op.STATE])) for i in (0, 1))
        c = np.tanh(e[:, 2 * op.STATE :] + r * a[:, 2 * op.STATE :])
        assert np.allclose(before[t], own, atol=1e-6) and np.allclose(after[t], c + z * (own - c), atol=1e-5)
