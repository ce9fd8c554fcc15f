"""BPE encoding and decoding by a tokenization automaton.

The automaton over tokens accepts exactly the sequences that merging by rank produces. It is built by one gadget for each merge
(u, v) -> w, in order: the state after u loses its arc v, and w's arcs and state derive from u's and v's. A gadget is kept as what it
changes (a full table of arcs would be the vocabulary's size squared); an arc's presence follows from the gadgets.

Words are encoded by a deterministic automaton over bytes that is compiled from it: a state holds the tokens under way (places
in a trie of the vocabulary, each with the token before it) and the one token that ends here. States and transitions are put into a table
when a word first needs them, as the whole table has far more states than texts ever reach; encoding is one look-up a byte, and the
tokens are read off backward from the states. Texts are cut into words as the
tokenizer's file says (NFC, lower case by code point, pattern), words are cached, and special tokens in the text are
cut out first. Decoding emits the labels of the arcs, joined by spaces, as a file without decoder asks.

Letters, digits and lower case are those of Unicode 16 and 17 that the tokenizers library has and Python's tables lack;
sequences of such new characters are not composed.

Defined results: null text is empty, with 0 tokens; repeated rows give repeated rows; a null doc_id stays null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docnav.llm.common import lean, load

END = "</w>"
#: Words whose encodings a worker keeps, in each of two generations: a full one takes the place of the older one, so words that keep coming stay.
MOST_CACHED = 140_000
#: States in the table of the automaton over bytes, and arcs looked up, that a worker keeps. Beyond a full table transitions are computed.
MOST_STATES, MOST_ARCS = 30_000, 300_000

# Letters, digits and lower-case forms (first, last, distance) newer than Unicode 15.1.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def _usual(text: str) -> bool:
    """Whether all characters are of Latin-1, or at least below U+0530, where none is odd."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < "\u0530"
    return True


@cache
def character_classes() -> tuple[str, str, str, dict[int, int]]:
    """Sets for a pattern: letters and digits (those of Python's tables, and the newer ones), and the characters of which the regex module
    thinks otherwise; and the newer lower-case forms."""
    every = [chr(c) for c in range(0x110000)]
    kind = [unicodedata.category(c)[0] for c in every]
    for k, newer in (("L", NEW_LETTERS), ("N", NEW_DIGITS)):
        for first, last in newer:
            kind[first : last + 1] = [k] * (last + 1 - first)
    theirs = [unicodedata.category(c)[0] for c in every]
    for k in "LN":
        for m in regex.finditer(rf"\p{{{k}}}", "".join(every)):
            theirs[m.start()] = k

    def ranges(points: list[int]) -> str:
        out: list[list[int]] = []
        for c in points:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    lower = {c: c + d for a, b, d in NEW_LOWER for c in range(a, b + 1)}
    odd = [c for c in range(0x110000) if (kind[c] in "LN" or theirs[c] in "LN") and kind[c] != theirs[c] or c in lower]
    return *(ranges([c for c in range(0x110000) if kind[c] == k]) for k in "LN"), ranges(odd), lower



def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.size = max([*vocab.values(), *special.values(), -1]) + 1
        self.label = [""] * self.size
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        for s, i in [*vocab.items(), *special.items()]:
            self.label[i] = s
        self.left, self.right, self.born = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.lost: dict[tuple[int, int], int] = {}
        self.length, self.special = [0] * self.size, special
        leaf: dict[int, int] = {}
        self.child: list[dict[int, int]] = [{}]  # leaves share an empty one
        self.token = [-1]
        symbols: dict[int, tuple[int, ...]] = {}
        for b, s in enumerate(letters):
            symbols[vocab[s]], symbols[vocab[s + END]] = (b,), (256 + b,)
        for step, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            symbols[w] = symbols[u] + symbols[v]
            self._gadget(step, u, v, w)
        for t, s in symbols.items():
            node = 0
            for x in s:
                if self.child[node] is leaf:
                    self.child[node] = {}
                if x not in self.child[node]:
                    self.child[node][x] = len(self.token)
                    self.child.append(leaf)
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node], self.length[t] = t, len(s)
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self._reset()

    def _reset(self) -> None:
        """An automaton over bytes with its first state only."""
        self.states: dict[tuple, int] = {}
        self.under_way: list[tuple[tuple[int, int], ...]] = []
        self.ends: list[int] = []
        self.table: dict[int, int] = {}  # state * 512 + symbol to state
        self._state(-1, ((0, -1),))

    def forget(self) -> None:
        """Drop what was kept for speed, so that a worker between tasks holds the vocabulary's tables alone."""
        self.words, self.older, self.arcs = {}, {}, {}
        self._reset()

    def _state(self, token: int, under_way: tuple[tuple[int, int], ...]) -> int:
        key = (token, under_way)
        if key not in self.states:
            self.states[key] = len(self.ends)
            self.ends.append(token)
            self.under_way.append(under_way)
        return self.states[key]

    def _step(self, under_way, symbol: int) -> tuple[int, list[tuple[int, int]]]:
        """The token that ends with ``symbol``, and the tokens under way after it. Of the tokens that end there just one may follow what is before it."""
        ending, on = -1, []
        for node, before in under_way:
            node = self.child[node].get(symbol, -1)
            if node < 0:
                continue
            if symbol < 256:  # nothing follows a word's last byte
                on.append((node, before))
            w = self.token[node]
            if w >= 0 and ending < 0 and (before < 0 or self.follows(before, w)):
                ending = w
        if symbol < 256 and ending >= 0:
            on.append((0, ending))
        return ending, on

    def _compile(self, state: int, symbol: int) -> int:
        """The state after ``symbol``, entered into the table."""
        ending, on = self._step(self.under_way[state], symbol)
        to = self.table[state * 512 + symbol] = self._state(ending, tuple(on))
        return to

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        """Note that the state after u loses its arc v, and that w's arcs derive from u's and its state from v's."""
        self.lost.setdefault((u, v), step)
        if self.born[w] < 0:
            self.left[w], self.right[w], self.born[w] = u, v, step

    def arc(self, t: int, w: int) -> bool:
        """Whether the state after token t has an arc w, read back from the steps at which either came to be."""
        before = len(self.lost) + 1
        while True:
            if self.lost.get((t, w), before) < before:
                return False
            bt, bw = self.born[t], self.born[w]
            if bt < 0 and bw < 0:
                return True
            before = max(bt, bw)
            if bw > bt:
                if self.left[w] == self.right[w] == t:
                    return False  # merging goes from left to right: t t t is (t t) t
                w = self.left[w]
            elif bt > bw:
                t = self.right[t]
            else:
                t, w = self.right[t], self.left[t]

    def follows(self, t: int, w: int) -> bool:
        """Whether an arc is there, looked up or read back from the gadgets."""
        key = t * self.size + w
        ok = self.arcs.get(key)
        if ok is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            ok = self.arcs[key] = self.arc(t, w)
        return ok

    def _search(self, symbols: list[int], at: int, under_way, path: list[int]) -> None:
        """The rest of ``path`` from a state whose transition is not in a full table: each token under way is followed to its end before the next
        begins, which are the same transitions without states to keep."""
        child, token, arcs, size, n = self.child, self.token, self.arcs, self.size, len(symbols)
        path += [-1] * (n - at)
        starts = [(at, node, before) for node, before in under_way]
        for begin in range(at, n):
            if begin > at:
                starts = ((begin, 0, path[begin - 1]),)
            for place, node, before in starts:
                for j in range(place, n):
                    node = child[node].get(symbols[j], -1)
                    if node < 0:
                        break
                    w = token[node]
                    if w >= 0 and path[j] < 0:
                        if before >= 0:
                            ok = arcs.get(before * size + w)
                            if not (self.follows(before, w) if ok is None else ok):
                                continue
                        path[j] = w

    def encode_word(self, word: bytes) -> list[int]:
        table, ends, full = self.table, self.ends, len(self.ends) >= MOST_STATES
        symbols = [*word[:-1], word[-1] + 256]
        state, path = 0, []
        for i, symbol in enumerate(symbols):
            to = table.get(state * 512 + symbol)
            if to is None:
                if full:
                    self._search(symbols, i, self.under_way[state], path)
                    break
                to = self._compile(state, symbol)
            state = to
            path.append(ends[to])
        n, out, length = len(word), [], self.length
        while n:
            w = path[n - 1]
            out.append(w)
            n -= length[w]
        return out[::-1]

    def entry(self, word: str) -> tuple[bytes, str]:
        """A word's ids as bytes, and its labels."""
        got = self.words.get(word) or self.older.get(word)
        if got is None:
            ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
            got = (b"".join([self.packed[i] for i in ids]), self.decode(ids))
        if len(self.words) >= MOST_CACHED:
            self.older, self.words = self.words, {}
        self.words[word] = got
        return got

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids)

    @cache  # noqa: B019  one automaton a worker
    def _patterns(self):
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters, digits, odd, lower = character_classes()
        forms = r"'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^\p{{White_Space}}{0}{1}]+"
        return cut, regex.compile(forms.format(r"\p{L}", r"\p{N}")), regex.compile(forms.format(letters, digits)), regex.compile(f"[{odd}]"), lower

    def _cut(self, part: str) -> list[str]:
        """Words of a text without special tokens."""
        _, usual, exact, odd, lower = self._patterns()
        if part.isascii():
            return usual.findall(part.lower())
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        # the regex module's classes are quick, and the same but for the odd characters
        if _usual(part) or not odd.search(part):
            return usual.findall(part.lower())
        return exact.findall(part.lower().translate(lower))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """The entries of a text's words and special tokens, in order."""
        cut, out = self._patterns()[0], []
        for part in cut.split(text) if cut else [text]:
            if part in self.special:
                out.append((self.packed[self.special[part]], part))
                continue
            known = self.words.get  # of the generation at hand; entry looks into the others
            out += [known(x) or self.entry(x) for x in self._cut(part)]
        return out

    def encode(self, text: str) -> list[int]:
        data = b"".join(p[0] for p in self.pieces(text))
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


_LOADED: dict[str, Automaton] = {}


def compiled(spec: str) -> Automaton:
    """The automaton of a tokenizer's file, compiled once in a process."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        s = json.loads(spec)
        _LOADED[key] = Automaton(s["vocab"], [tuple(m) for m in s["merges"]], s["special"])
    return _LOADED[key]


def specification(path: str) -> str:
    """What the workers need of a tokenizer's file; its size depends on the vocabulary alone."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in t["model"]["merges"]]
    return json.dumps({"vocab": t["model"]["vocab"], "merges": merges, "special": {a["content"]: a["id"] for a in t["added_tokens"]}})


def _tokens(spec, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(spec.value)
        try:
            for batch in batches:
                n, ids_sum, text_sum, all_ids, all_text = [], [], [], [], []
                for text in batch.column("text"):
                    pieces = bpe.pieces(text.as_py() or "")
                    ids = b"".join([p[0] for p in pieces])
                    decoded = " ".join([p[1] for p in pieces])
                    n.append(len(ids) // 4)
                    ids_sum.append(hashlib.sha256(ids).hexdigest())
                    text_sum.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_text.append(decoded)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())]
                columns += [pa.array(all_ids, pa.binary()), pa.array(all_text, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])
        finally:
            bpe.forget()

    return run


def tokenize(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids (little-endian unsigned 32-bit) and the decoded text."""
    spec = docs.sparkSession.sparkContext.broadcast(specification(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(_tokens(spec, with_ids)), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(load(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
