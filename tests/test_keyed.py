import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from docnav.operators.calls import ReplyCache
from docnav.sources import keyed as K
from docnav.streaming.incremental import score_store

SCHEMA = "key string, value int"


def table(spark, path, **more):
    return K.KeyedTable(spark, f"file://{path}", SCHEMA, **more)


def rows(spark, items):
    return spark.createDataFrame(list(items), SCHEMA)


def content(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_writers_at_the_same_time_lose_and_double_nothing(spark, tmp_path):
    logs = [K.CommitLog(spark, f"file://{tmp_path}/log") for _ in range(6)]
    names = [[f"w{w}-{i}" for i in range(12)] for w in range(6)]

    def work(log, own):
        for n in own:
            log.commit([n])
            log.commit([n])  # sent again

    threads = [threading.Thread(target=work, args=x) for x in zip(logs, names, strict=True)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, parts = logs[0].latest()
    assert sorted(parts) == sorted(n for own in names for n in own) and number == 72
    assert [p for p in parts if p.startswith("w3")] == names[3]
    assert not [f for f in os.listdir(tmp_path / "log") if not f.endswith(".json") and not f.endswith(".crc")]


def test_replacing(spark, tmp_path):
    log = K.CommitLog(spark, f"file://{tmp_path}/log")
    for n in "abc":
        log.commit([n])
    log.commit(["ab"], ["a", "b"])
    assert log.latest() == (4, ["ab", "c"])
    with pytest.raises(K.Conflict):
        log.commit(["x"], ["a"])
    assert json.loads((tmp_path / "log" / f"{2:020d}.json").read_text()) == {"parts": ["a", "b"]}  # earlier states stay


def test_two_writers_append(spark, tmp_path):
    t = [table(spark, tmp_path / "t", buckets=4) for _ in range(2)]
    work = [threading.Thread(target=lambda w=w: [t[w].append(rows(spark, [(f"{w}-{i}", i)]), f"b{w}{i}") for i in range(3)]) for w in range(2)]
    [x.start() for x in work]
    [x.join() for x in work]
    assert content(t[0].table()) == {f"{w}-{i}": i for w in range(2) for i in range(3)}


def test_latest_wins_and_batches_are_taken_once(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=4)
    assert content(t.table()) == {} and content(t.lookup(rows(spark, [("a", 0)]))) == {}
    t.append(rows(spark, [("a", 1), ("b", 1)]), "one")
    t.append(rows(spark, [("a", 9), ("z", 9)]), "one")
    t.append(rows(spark, [("a", 2), ("c", None)]), "two")
    t._write(rows(spark, [("a", 99)]), "lost")  # written, never named
    assert content(t.table()) == {"a": 2, "b": 1, "c": None}
    assert content(t.lookup(rows(spark, [("a", 0), ("a", 0), ("c", 0), ("q", 0), (None, 0)]))) == {"a": 2, "c": None}
    t.compact()
    assert len(t.log.latest()[1]) == 1 and content(t.table()) == {"a": 2, "b": 1, "c": None}
    t.append(rows(spark, [("b", 5)]), "three")
    assert content(t.table())["b"] == 5


def test_many_parts_become_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_PARTS", 3)
    t = table(spark, tmp_path / "t", buckets=2)
    for i in range(6):
        t.append(rows(spark, [("a", i), (f"k{i}", i)]))
    assert len(t.log.latest()[1]) <= 3 and content(t.table()) == {"a": 5, **{f"k{i}": i for i in range(6)}}


def test_a_lookup_reads_few_files(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=64)
    t.append(rows(spark, ((f"key {i}", i) for i in range(20_000))), "one")
    some = rows(spark, ((f"key {i}", 0) for i in random.Random(1).sample(range(20_000), 5)))
    every = t.spark.read.parquet(t.root).select(F.input_file_name()).distinct().count()
    found = t.candidates(some)
    assert found.select(F.input_file_name()).distinct().count() <= 5 < every / 10
    assert "PartitionFilters: [bucket#" in found._jdf.queryExecution().executedPlan().toString()
    assert len(content(t.lookup(some))) == 5


def test_replies_and_scores_use_it(spark, tmp_path):
    cache = ReplyCache(f"file://{tmp_path}/c")
    ask = spark.createDataFrame([("answer", "x"), ("answer", "y")], "kind string, prompt string")
    assert {r.from_cache for r in cache.answer(ask).collect()} == {False} and {r.from_cache for r in cache.answer(ask).collect()} == {True}
    assert cache.table(spark).count() == 2
    assert score_store(spark, f"file://{tmp_path}/s").table().columns == ["run_id", "gold", "format", "response", "extracted", "score"]
