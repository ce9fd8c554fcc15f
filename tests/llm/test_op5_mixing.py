import re

import pytest

from docnav.llm.op5_mixing import MOST, WEIGHTS, mix_sources, schedule, targets

from .conftest import DOCS, prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(totals: dict) -> dict:
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(totals.values())
    while True:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > MOST * totals[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = MOST * totals[s]
        left -= sum(target[s] for s in over)
        free -= over


def check(rows, got):
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size(r[1])
    want = brute_targets(totals)
    assert len(got) == len(rows)
    taken = dict.fromkeys(totals, 0)
    for g in got:
        assert g.source_size == totals[g.source]
        assert g.target == pytest.approx(want[g.source], rel=1e-9)
        assert 0 <= g.taken <= MOST * g.size
        taken[g.source] += g.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(8, 0.02 * want[s]), s


def test_targets_and_takes_follow_the_brute_force(spark):
    rows = [(i, prose(i, 20 + i % 70), "en", f"s{min(i % 40, 11)}" if i % 13 else None, None, "", "", 0) for i in range(900)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mix_sources(frame).collect()
    check(rows, got)
    again = mix_sources(frame.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_scarce_source_stops_at_three_times_its_size(spark):
    rows = [(0, prose(0, 10), "en", "a", None, "", "", 0), *[(i, prose(i, 50), "en", "b", None, "", "", 0) for i in range(1, 20)]]
    got = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].target == 30 and got[0].taken == 30
    assert got[1].target == 930


def test_odd_rows(spark, odd, none):
    check(odd.collect(), mix_sources(odd).collect())
    assert mix_sources(none).count() == 0


def test_small_sources_of_a_large_corpus_meet_their_targets(spark):
    # a null source, sources of 100 to 1,100 words, and one large enough for slots of 512 words
    small = {None: 130, "b": 100, "c": 200, "d": 400, "e": 1100, "f": 1}
    rows = [(i, " ".join(["w"] * n), "en", s, None, "", "", 0) for i, (s, n) in enumerate(small.items())]
    large = spark.range(100, 500).selectExpr("id as doc_id", "repeat('w ', 170000 + cast(id as int)) as text", "'en' as lang", "'a' as source", "null as n_chars", "'' as key", "'' as cls", "0 as n")
    got = mix_sources(spark.createDataFrame(rows, DOCS).union(large)).collect()
    assert sum(g.size for g in got) > 512 << 17
    assert {g.source: g.taken for g in got if g.source != "a"} == {s: MOST * n for s, n in small.items()}
    assert sum(g.taken for g in got if g.source == "a") == round(next(g.target for g in got if g.source == "a"))


def test_slots_hold_the_words_that_are_taken(spark):
    sizes = [(None, 40), ("a", 90_000), ("b", 7), ("c", 30_000), ("d", 0)]
    plan = targets(spark.createDataFrame(sizes, "source string, source_size long"))
    want = {r.source: int(r.target + 0.5) for r in plan.collect()}
    assert schedule(plan).count() >= sum(want.values())
    slots = schedule(plan, 200).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots) >= 200
    for s, n in want.items():
        own = [(r.first, r.after) for r in slots if r.source == s]
        assert [a for a, _ in own] + [n] * bool(own) == [0] * bool(own) + [b for _, b in own], s
        assert bool(own) == (n > 0)


def test_takes_follow_the_slots(spark, monkeypatch):
    """What a document gives is what the schedule's slots hold of it: another schedule takes other words."""
    from docnav.llm import op5_mixing as op

    rows = [(i, prose(i, 1 + i % 37), "en", f"s{i % 4}" if i % 4 else None, None, "", "", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, DOCS)
    usual = {r.doc_id: r for r in mix_sources(frame).collect()}
    original = op.schedule
    monkeypatch.setattr(op, "schedule", lambda plan: original(plan).where("slot % 3 <> 0"))
    fewer = {r.doc_id: r for r in mix_sources(frame).collect()}
    assert all(fewer[i].taken <= usual[i].taken for i in usual)
    plan = targets(spark.createDataFrame([(s, sum(r.size for r in usual.values() if r.source == s)) for s in {r.source for r in usual.values()}], "source string, source_size long"))
    held = {r.source: r.n for r in original(plan).where("slot % 3 <> 0").groupBy("source").agg({"after": "sum", "first": "sum"}).selectExpr("source", "`sum(after)` - `sum(first)` as n").collect()}
    assert {s: sum(r.taken for r in fewer.values() if r.source == s) for s in held} == held
    monkeypatch.setattr(op, "schedule", lambda plan: original(plan, 7))
    few = {r.doc_id: r.taken for r in mix_sources(frame).collect()}
    assert few == {i: r.taken for i, r in usual.items()}  # blocks of other lengths hold the same words in all


def test_points_keep_their_digits():
    from fractions import Fraction

    from docnav.llm import op5_mixing as op

    golden = Fraction(op._GOLDEN)
    for j in (1, 10**6, 10**9 + 7, 4 * 10**10 + 1):
        got = ((j // op._HIGH) * (op._GOLDEN * op._HIGH % 1) + (j % op._HIGH) * op._GOLDEN) % 1.0
        assert abs(got - float(j * golden % 1)) < 1e-9
