import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docnav.llm import op11_alignment as op

PATHS = op.tokenizer_paths()
HARD = [
    " x", "x ", " ", "a  b", "a \n b", "\n", "a\u00a0 b", "a \u3000b", "tab\tand\x1c\x00nul", "say \u2581 it", "\u2581", "<|endoftext|> <s> <0x0A> </s>", "I'll don't", "caf\u00e9 e\u0301 \ufb01 \uff21", "\U0001f600 ok \U0001f468\u200d\U0001f469",
    "\u0627\u0644\u0639 \u4e2d\u6587 x", "1234567 12.5%", "x" * 700, "word\u2028next", "\ufeffbom", "end.\nNext  line ",
]


def brute(rows):
    """Whole texts through the libraries, all pairs of tokens by their ends."""
    t = op.Tokenizers(*PATHS)
    out, counts, links_of = [], Counter(), []
    for i, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            whole = f" {text}".encode()
            if b"".join(t.bytes_a[x] for x in a) != whole or b"".join(t.bytes_b[x] for x in b) != whole:
                a, b = [], []
            ends_a, ends_b = np.cumsum([len(t.bytes_a[x]) for x in a]).tolist(), np.cumsum([len(t.bytes_b[x]) for x in b]).tolist()
            at_b = {e: k for k, e in enumerate(ends_b)}
            ga, gb, last = [], [], 0
            for k, e in enumerate(ends_a):
                ga.append(str(a[k]))
                if e in at_b:
                    gb = [str(x) for x in b[last : at_b[e] + 1]]
                    last = at_b[e] + 1
                    links.append((a[k], b[at_b[e]]))
                    groups.append(",".join(ga) + "|" + ",".join(gb))
                    ga = []
        counts.update(links)
        links_of.append(links)
        out.append([i, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for row, links in zip(out, links_of, strict=True):
        row[5:5] = [sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)]
    return Counter(map(tuple, out)), counts


def check(spark, rows, df=None):
    df = df if df is not None else spark.createDataFrame(rows, "doc_id long, text string")
    got, pairs = op.align_documents(df)
    want, counts = brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)


def test_equal_to_the_libraries(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows + [(None, x) for x in HARD])


def test_odd_rows(spark, odd, none):
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()], odd)
    assert op.align_documents(none)[0].count() == 0


def test_blocks_and_whole_texts(spark, monkeypatch):
    """Small blocks, and vocabularies that do not allow cutting, give the same rows."""
    r = random.Random(5)
    alphabet = "ab c\n\u00e9 \u2581'\u4e2d.  "
    rows = [(i, "".join(r.choice(alphabet[: r.choice((4, 7, 15))]) for _ in range(r.randrange(40)))) for i in range(300)] + [(1, "the the cat")] * 50
    t = op.tokenizers(*PATHS)
    small = [x for block in (3, 300) for x in _local(rows, block)]
    assert t.separable
    monkeypatch.setattr(t, "separable", False)
    assert Counter(small) == Counter({k: 2 * n for k, n in Counter(_local(rows, 10**6)).items()})
    monkeypatch.undo()
    check(spark, rows)


def _local(rows, block):
    import pyarrow as pa

    out = []
    for k in range(0, len(rows), block):
        part = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows[k : k + block]], "text": [x for _, x in rows[k : k + block]]})
        original, op.in_blocks = op.in_blocks, lambda batches, *_: [(0, pa.Table.from_batches(batches))]
        try:
            for b in op._blocks(PATHS)(iter([part])):
                out += [tuple(d.values()) for d in b.column("docs")[0].as_py()]
        finally:
            op.in_blocks = original
    return out


def test_ranks_equal_rules():
    """Merging by the ranks of results alone is merging by rules: each token, merged on its own by smaller ranks, ends in its rule's two sides."""
    import json

    t = op.Tokenizers(*PATHS)
    with open(PATHS[0], encoding="utf-8") as f:
        file = json.load(f)
    rank = {t.bytes_a[i]: i for i in file["model"]["vocab"].values() if i < 256 + len(file["model"]["merges"])}
    assert t.ranks is not None
    for m in file["model"]["merges"]:
        x, y = (m.split(" ") if isinstance(m, str) else m)
        u, v = (t.bytes_a[file["model"]["vocab"][s]] for s in (x, y))
        parts, limit = [bytes([c]) for c in u + v], rank[u + v]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], limit))
            if rank.get(parts[k] + parts[k + 1], limit) >= limit:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [u, v]


@pytest.mark.parametrize("seed", range(5))
def test_align(seed):
    r = np.random.default_rng(seed)
    total = 60
    a, b = (np.unique(np.append(r.integers(1, total, 25), total)) for _ in range(2))
    cuts, ga, gb, left, right = op.align(a, b)
    assert set(cuts) == set(a) & set(b)
    assert sorted(zip(left, right, strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    assert all(ga[i] == sum(c < a[i] for c in cuts) for i in range(len(a))) and all(gb[j] == sum(c < b[j] for c in cuts) for j in range(len(b)))
