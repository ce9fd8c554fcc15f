import hashlib
import random
import struct

import pytest
import tokenizers

from docnav.llm import op4_bpe as op

from .conftest import prose


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(op.vocabulary_path())


@pytest.fixture(scope="module")
def bpe():
    return op.compiled(op.specification(op.vocabulary_path()))


def samples():
    r = random.Random(5)
    letters = "aaabbcdeeefghiiijlmnnoooprsstttuuvwxyz"
    for n in (1, 2, 3, 5, 8, 13, 30):
        for _ in range(300):
            yield "".join(r.choice(letters) for _ in range(n))
    for n in range(1, 40):
        yield "a" * n
        yield "!" * n
        yield "ha" * n
    yield from ["", "Don't they'LL we've I'm 'tis", "ΣΑΣ İstanbul ẞ ﬁ ½ ٣٤ 你好 𝒜 é", "x<|endoftext|>Y <|startoftext|><|END|>", "a b c\u0085d\x1ce\x1ff​g", "🙂🙂 naïve café", "\x00\x01", "12345 3.14", prose(1, 500), "ab" * 5000, "_" * 3000]


def test_ids_and_text_equal_the_library(bpe, library):
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == want, text[:50]
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False)


def test_arcs_are_those_of_the_plain_merge(bpe, library):
    """A pair of tokens is an arc exactly if merging its symbols gives the pair back."""
    rank = {(bpe.left[w], bpe.right[w]): (bpe.born[w], w) for w in range(bpe.size) if bpe.born[w] >= 0}

    def base(t):
        return [t] if bpe.born[t] < 0 else base(bpe.left[t]) + base(bpe.right[t])

    def merged(s):
        while found := sorted((rank[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank):
            i = found[0][1]
            s = s[:i] + [rank[s[i], s[i + 1]][1]] + s[i + 2 :]
        return s

    r = random.Random(1)
    inner = [t for t in range(49406) if not bpe.label[t].endswith(op.END)]
    for _ in range(4000):
        t, w = r.choice(inner), r.randrange(49406)
        assert bpe.arc(t, w) == (merged(base(t) + base(w)) == [t, w])


def test_odd_rows(spark, odd, none, library):
    got = op.tokenize(odd, op.vocabulary_path()).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        data, text = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), data, text))
    assert sorted((tuple(g) for g in got), key=str) == sorted(want, key=str)
    assert op.tokenize(none, op.vocabulary_path()).count() == 0


def test_every_code_point_equals_the_library(bpe, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}b" for c in points[i : i + 4096])
        if bpe.encode(text) != library.encode(text, add_special_tokens=False).ids:
            bad = [hex(c) for c in points[i : i + 4096] if bpe.encode(f"a{chr(c)}b") != library.encode(f"a{chr(c)}b", add_special_tokens=False).ids]
            assert not bad, bad[:20]


def test_a_full_table_changes_no_result(bpe, library, monkeypatch):
    monkeypatch.setattr(op, "MOST_STATES", 50)
    monkeypatch.setattr(op, "MOST_ARCS", 20)
    bpe._reset()
    for i in range(60):
        word = "".join(random.Random(i).choice("abcdeilnorst") for _ in range(9))
        assert bpe.encode_word(word.encode()) == library.encode(word, add_special_tokens=False).ids
    assert len(bpe.ends) < 80


def test_a_worker_keeps_no_words_between_tasks(spark):
    import pyarrow as pa

    class Spec:
        value = op.specification(op.vocabulary_path())

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(1, 200), None]})
    assert [b.num_rows for b in op._tokens(Spec, False)(iter([batch]))] == [2]
    kept = op.compiled(Spec.value)
    assert not kept.words and not kept.older and not kept.arcs and len(kept.ends) == 1
