import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docnav.llm import op12_divergence as op

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, top=op.TOP):
    """All terms, all pairs, in whole numbers of any size; rows are (lang, source, text)."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(SMALL))
        groups[lang].add(source)
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in df[lang].items() if d >= op.LEAST)
        v = len(kept)
        all_n = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(all_n)

        def put(part, source, values):
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, item, value, r) for r, (item, value) in enumerate(ranked, 1) if part == "pair" or r <= top)

        for s in sources:
            put("pair", s, {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in sources if o != s})
            put("term", s, {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if n[lang, s][t] and p[s][t] > q[t]})
    return Counter(out)


def rows_of(seed, many, vocab=60, sources=7):
    r = random.Random(seed)
    pool = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocab)] + ["été", "Été", "\U0001f600", "café"]
    rows = []
    for _ in range(many):
        words = [pool[min(int(r.expovariate(0.08)), len(pool) - 1)] for _ in range(r.randrange(30))]
        rows.append((r.choice(["en", "de", None, ""]), r.choice([f"s{min(int(r.expovariate(0.6)), sources)}", None]), r.choice([" ", ", ", "7"]).join(words) if words else r.choice([None, "", " 12 "])))
    return rows


def test_equal_to_brute_force(spark):
    rows = rows_of(1, 400) + [("xx", "only", "one two"), ("yy", "a", None), ("yy", "b", "...")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "lang string, source string, text string, n int, term string")
    assert Counter(map(tuple, op.audit(df.repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, op.audit(odd).select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows)
    assert op.audit(none).count() == 0


@pytest.mark.parametrize(("seed", "size", "most"), [(2, 1, 5), (3, 7, 40), (4, 1000, 10**6)])
def test_scans_by_small_batches(monkeypatch, seed, size, most):
    """Blocks, sorted batches and cells of any size give the same sums."""
    monkeypatch.setattr(op, "MOST_ENTRIES", most)
    monkeypatch.setattr(op, "BLOCK", 10 * size)
    monkeypatch.setattr(op, "EXPANDED", 3 * size)
    monkeypatch.setattr(op, "CELL", 4 * size)
    monkeypatch.setattr(op, "TOP", 4)
    rows = [(a or "", b or "", c or "") for a, b, c in rows_of(seed, 150)]

    def batches(table, width):
        return iter(table.combine_chunks().to_batches(max_chunksize=width)) if len(table) else iter([])

    def run(f, table):
        got = list(f(batches(table, size)))
        return pa.Table.from_batches(got)

    entries = run(op.count_terms, pa.table(dict(zip(("lang", "source", "text"), map(list, zip(*rows, strict=True)), strict=True))))
    kept = run(op.keep_runs, entries.sort_by([(c, "ascending") for c in ("lang", "term", "source", "document")])).to_pylist()
    v, total, groups, out = Counter(), Counter(), defaultdict(set), Counter()
    for k in kept:
        v[k["lang"]] += k["first"]
        total[k["lang"], k["source"]] += k["n"]
        groups[k["lang"]].add(k["source"])
    cells = 3
    body = [{"lang": k["lang"], "cell": sum(k["term"].encode()) % cells, "kind": 1, "term": k["term"], "source": k["source"], "n": k["n"], "v": 0} for k in kept if k["term"]]
    head = [{"lang": g, "cell": c, "kind": 0, "term": "", "source": s, "n": total[g, s], "v": v[g]} for g, ss in groups.items() for s in ss for c in range(cells)]
    table = pa.Table.from_pylist(head + body).sort_by([(c, "ascending") for c in ("lang", "cell", "kind", "term", "source")])
    terms = defaultdict(list)
    for r in run(op.scan_cells, table).to_pylist():
        if r["part"] == "pair":
            out[r["lang"], r["source"], r["item"]] += r["value"]
        else:
            terms[r["lang"], r["source"]].append((-r["value"], r["item"].encode()))
    want = brute(rows, 4)
    assert {k: x for k, x in out.items() if x} == {(a, b, i): x for a, b, part, i, x, _ in want if part == "pair" and x}
    best = {(a, b, sorted(t)[k][1].decode(), -sorted(t)[k][0], k + 1) for (a, b), t in terms.items() for k in range(min(4, len(t)))}
    assert best == {(a, b, i, x, r) for a, b, part, i, x, r in want if part == "term"}


def test_shares_are_exact():
    r = random.Random(1)
    total = np.array([r.randrange(1, 10 ** r.randrange(1, 16)) for _ in range(2000)])
    count = np.array([r.randrange(t + 1) for t in total.tolist()])
    assert op.share(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_equal_to_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(op.ORACLE).fetchall()
    assert Counter(map(tuple, op.op12_divergence(spark, folder).select("lang", "source", "part", "item", "value", "rank").collect())) == Counter(want)
