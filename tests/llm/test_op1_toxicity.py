import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docnav.llm import op1_toxicity as op

from .conftest import DOCS, prose


def corpus(n=700):
    r = random.Random(9)
    bad = {"en": ["vile", "rotten", "grubby", "foul"], "xx": [f"mukta{x}" for x in "abcdefgh"]}
    for i in range(n):
        lang, toxic = ("en", "xx")[i % 3 == 0], i % 5 == 0
        words = prose(i, 20 + i % 150, 900).split()
        for _ in range(r.randrange(3, 7) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad[lang]))
        yield i, " ".join(words), lang, int(toxic)


def frames(spark):
    rows = list(corpus())
    docs = spark.createDataFrame([(i, x, lang, "s", None, "", "", 0) for i, x, lang, _ in rows], DOCS)
    return rows, docs, spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark):
    rows, docs, labels = frames(spark)
    net = op.fit(docs, labels)
    got = {r.doc_id: r for r in op.score_documents(docs, net).collect()}
    held = [(got[i].score, t, got[i].flagged) for i, _, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    good, bad = [s for s, t, _ in held if not t], [s for s, t, _ in held if t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.97
    assert np.mean([f == bool(t) for _, t, f in held]) > 0.95
    assert op.BOUNDS[0] <= net.thresholds["en"] <= op.BOUNDS[1]


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark):
    rows, docs, labels = frames(spark)
    few = labels.where("doc_id < 150")
    turned = few.withColumn("toxic", F.when(op.crc("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("source", F.lit("t"))
    one = op.score_documents(docs, op.fit(docs, few)).select("doc_id", "score").collect()
    two = op.score_documents(other, op.fit(other, turned)).select("doc_id", "score").collect()
    assert sorted(one) == sorted(two)


def test_cached_scores_equal_scores_without_cache(spark, monkeypatch):
    rows = list(corpus(120))
    net = op.train([r[1] for r in rows], np.array([r[3] for r in rows]), np.ones(len(rows)))
    monkeypatch.setattr(op, "MOST_CACHED", 50)
    scorer = op.Scorer(net)
    for _, x, _, _ in rows[:40]:
        assert abs(scorer.score(x) - op.Scorer(net).score(x)) < 1e-6


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    net = op.fit(odd, labels)
    got = op.score_documents(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id == 0} == {op.Scorer(net).score(None)}
    assert op.score_documents(none, net).count() == 0
    assert op.fit(none, labels) is None
    assert {r.score for r in op.score_documents(odd, None).collect()} == {0.0}


def test_long_texts_and_all_rows_are_learned_from(spark, monkeypatch):
    """Toxic rows of more characters than a bounded sample would take, and as many shards as rows ask for."""
    rows = [(i, " ".join([x, *["plain filler"] * (4000 if t else 1)]), lang, t) for i, x, lang, t in corpus(300)]
    docs = spark.createDataFrame([(i, x, lang, "s", None, "", "", 0) for i, x, lang, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, toxic int")
    assert op.fit(docs, labels) is not None
    rows, docs, labels = frames(spark)
    monkeypatch.setattr(op, "SHARD_ROWS", 100)
    for steps in (100, 12_000):
        monkeypatch.setattr(op, "STEPS", steps)
        net = op.fit(docs, labels)
        got = {r.doc_id: r.score for r in op.score_documents(docs, net).collect()}
        held = [(got[i], t) for i, _, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
        good, bad = [s for s, t in held if not t], [s for s, t in held if t]
        assert np.mean([[b > g for g in good] for b in bad]) > 0.9


def test_rows_without_a_label_are_not_shuffled(spark):
    """The bitmap keeps each labelled row, with repeats, and next to nothing else; other kinds of ids too."""
    rows = spark.range(-5000, 5000).selectExpr("id as doc_id", "cast(id as string) as text", "0 as bits").union(spark.sql("select 7L, 'again', 0 union all select null, 'null', 0"))
    keys = spark.range(0, 5000, 10).selectExpr("cast(id + 7 as int) as doc_id")
    got = [r.doc_id for r in op.among(rows, keys, "doc_id").collect()]
    assert set(got) >= set(range(7, 5000, 10)) and got.count(7) == 2 and len(got) < 520 and op.among(rows, keys, "doc_id").columns == rows.columns
    named = rows.selectExpr("text as doc_id", "text")
    assert {r.doc_id for r in op.among(named, keys.selectExpr("cast(doc_id as string) as doc_id"), "doc_id").collect()} >= {str(i) for i in range(7, 5000, 10)}
    assert op.among(named, keys, "doc_id").count() == named.count()


def test_features_are_those_of_pooled():
    r = np.random.default_rng(4)
    net = op._start(r.integers(0, 9, op.BUCKETS + 1), r.integers(0, 9, op.BUCKETS + 1), 20, 20)  # noqa: SLF001
    for n in (0, 1, 2, 3, 4, 5, 60):
        x = r.normal(0, 1, (n, op.OFFSETS * op.FILTERS)).astype(np.float32)
        assert np.array_equal(net.features(x), net.pooled(x)[0])


def test_words_are_hashed_together(monkeypatch):
    """The same hashes as one by one, in all lengths and scripts; the library is asked for words of more than 16 bytes only, whatever number of words a group has."""
    r = random.Random(5)
    words = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcxyz_09", "aé漢Ж𝒳ñ") for n in [*range(1, 20), 40, 300] for _ in range(30)]
    assert np.array_equal(op.bucket_rows(words), [op.buckets(w) for w in words])
    assert op.bucket_rows([]).shape == (0, 7) and np.array_equal(op.bucket_rows(words[:3]), [op.buckets(w) for w in words[:3]])
    calls, library = [], op._hash  # noqa: SLF001
    monkeypatch.setattr(op, "_hash", lambda *a: calls.append(a) or library(*a))
    net = op._start(np.ones(op.BUCKETS + 1), np.ones(op.BUCKETS + 1), 20, 20)  # noqa: SLF001
    texts = [" ".join(f"word{r.randrange(5000)}" for _ in range(100)) for _ in range(50)] + ["longer" * 4, None, ""]
    scores = op.Scorer(net).scores(texts)
    assert len(calls) == 1
    assert np.allclose(scores, [op.Scorer(net).score(t) for t in texts], atol=1e-6)


def test_groups_of_texts_and_clearing_change_no_row(monkeypatch):
    texts = [None, "", *[x for _, x, _, _ in corpus(80)], "a", None]
    whole = list(op.Words().each(texts))
    assert len(whole) == len(texts) and all(np.array_equal(a, np.array([op.buckets(w) for w in op.tokens(t)], int).reshape(-1, 7)) for a, t in zip(whole, texts, strict=True))
    monkeypatch.setattr(op, "GROUP", 700)
    monkeypatch.setattr(op, "MOST_CACHED", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, op.Words().each(texts), strict=True))
    assert list(op.Words().each([])) == []
