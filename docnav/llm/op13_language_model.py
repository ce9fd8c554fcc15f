"""Language-model scoring: a gated recurrent network over words, and the unigram model of the whole corpus beside it.

Words are counted over all documents of the learning folds. The HEAD most frequent words (the end of a text among them) are outputs of the network, in classes
of CLASS words by frequency; any other word, known or not, belongs to one of TAIL classes by its spelling. The output is factored: a softmax over all classes, then
one over the words of a head class, or the smoothed share of the word among all words of its tail class. So every text has a probability, and the network
starts as the unigram model that its biases hold.

Training is truncated backpropagation in numpy over windows of STEPS words in up to MOST_LANES lanes; the state goes on from window to window and is reset at the start of a
document. All documents of the learning folds are learned from, whole: they are dealt by a hash to shards of about SHARD_TOKENS tokens, each shard is trained block by block in one task, and the weights are averaged in
Spark, ROUNDS times over. A round takes a quarter of the documents, or all of them while few; a block has further turns only where the corpus has fewer than LEAST tokens. In scoring, the documents of a block lie end to
end in LANES lanes that step together, and again the state is carried from window to window, so a text of any length is scored whole.

Counts of up to KNOWN further words, the most frequent ones, go along with the head's. Those of all others never leave Spark: each block asks for them by a join.

Defined results: null and empty texts have one token, the end; repeated rows are documents of their own; a null doc_id is not held out;
very long texts are whole; without documents to learn from every base_score is 0 and the network is untrained; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.llm.common import WEIGHTS, Scratch, averaged, block_values, bounded_batches, in_blocks, lean, load, only_chunk, packed, split_words, unpacked, weight_rows

HEAD, CLASS, TAIL = 4096, 64, 32
#: Words outside the head whose counts need no join (at most), and bytes of such a word (at most).
KNOWN, KNOWN_BYTES = 1 << 17, 64
EMBED, STATE = 16, 16
#: Training: lanes (at least, at most), words of a window, tokens of a shard, shards at most, rounds, tokens to learn from at least (in further turns), bytes of a block, rate.
TRAIN_LANES, MOST_LANES, STEPS, SHARD_TOKENS, MOST_SHARDS, ROUNDS, LEAST, TRAIN_BLOCK, RATE = 24, 256, 16, 4_000_000, 256, 4, 3_700_000, 4 << 20, 0.006
#: Scoring: bytes of text in a block, lanes, words of a window. Counting: bytes in a block, words held until they are emitted.
BLOCK, LANES, WINDOW, COUNT_BLOCK, MOST_WORDS = 4 << 20, 256, 64, 4 << 20, 1 << 20
#: Rows of a softmax at once, words whose probabilities are taken at once, and the largest logit (a cut above it keeps probabilities below 1).
ROWS, AT_ONCE, BOUND = 2048, 1 << 16, 60.0
FOLDS, HELD_OUT, END = 5, 1, ""
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

BLOCKS = "block long, docs array<struct<doc_id: bigint, held_out: boolean, n_tokens: bigint, n_known: bigint, base: double, score: double>>, items binary, words array<string>"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tail_class(word: str) -> int:
    """By the first and the last two bytes."""
    raw = word.encode()
    return zlib.crc32(raw[:2] + b" " + raw[-2:]) % TAIL


#: A checksum of five bytes is the exclusive or of what each place adds.
_PLACES = [np.array([zlib.crc32(bytes(b if k == i else 0 for k in range(5))) ^ zlib.crc32(bytes(5)) for b in range(256)], np.uint32) for i in range(5)]
_NONE = np.uint32(zlib.crc32(bytes(5)) ^ int(_PLACES[2][0x20]))


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each of the words."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, first, size = np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends)
    out = np.empty(len(words), np.int64)
    long = size >= 2
    a, b = first[long], ends[1:][long]
    out[long] = (_PLACES[0][raw[a]] ^ _PLACES[1][raw[a + 1]] ^ _PLACES[3][raw[b - 2]] ^ _PLACES[4][raw[b - 1]] ^ _NONE) % TAIL
    for i in np.flatnonzero(~long):
        out[i] = tail_class(words[int(i)].as_py())
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, cls) summed over blocks; the end of a text is END."""
    parts, rows = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cls = tail_classes(only_chunk(table.column("word")))
        yield from table.append_column("cls", pa.array(cls, pa.int32())).combine_chunks().to_batches(max_chunksize=1 << 14)

    for _, block in in_blocks(batches, COUNT_BLOCK):
        number, _, words = split_words(only_chunk(block.column("text")), LOWER)
        n = np.bincount(number, minlength=len(words))
        parts.append(pa.table({"word": pa.concat_arrays([words, pa.array([END], pa.string())]), "n": pa.array(np.append(n, len(block)), pa.int64())}))
        rows += len(words)
        if rows > MOST_WORDS:
            parts = [merged()]
            rows = len(parts[0])
            if rows > MOST_WORDS // 2:
                yield from out(parts[0])
                parts, rows = [], 0
    if parts:
        yield from out(merged())


@dataclass
class Vocabulary:
    """The head's words by rank, and the logarithms of what the unigram model knows of them and of the tail's classes."""

    rank: dict[str, int]
    count: np.ndarray  # of the head's words
    tail: np.ndarray  # smoothed total of each tail class, unseen words included
    total: int
    distinct: int
    known: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))  # frequent words outside the head
    known_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def classes(self) -> int:
        return -(-len(self.count) // CLASS)

    def ids(self, words: pa.Array | list[str]) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        rank = np.asarray(pc.fill_null(pc.index_in(words, pa.array(self.rank, pa.string())), -1)).astype(np.int64)
        return np.where(rank >= 0, rank, len(self.count) + tail_classes(words))

    @property
    def end(self) -> int:
        return self.rank[END]


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def softmax(x: np.ndarray, parts: int = 1, near: bool = False) -> np.ndarray:
    """In place, divided by ``parts``; the rows' largest values are ``near`` 0 or are first made 0."""
    if not near:
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x *= 1 / (x @ np.full((x.shape[-1], 1), parts, np.float32))
    return x


def near(weight: np.ndarray, bias: np.ndarray) -> bool:
    """Whether the largest logit of each row lies within BOUND of 0 for any state, which has values between -1 and 1."""
    high, low = (bias + weight).max(-1), (bias - weight).max(-1)
    return bool((high <= BOUND).all() and (low >= -BOUND).all())


def by_class(cls: np.ndarray) -> np.ndarray:
    """The order of small numbers, as 16 bits sort faster."""
    return np.argsort(cls.astype(np.int16) if cls.size and cls.max() < 1 << 15 else cls, axis=None, kind="stable")


def loss_of(p: np.ndarray) -> float:
    return -float(np.log(np.maximum(p, 1e-37)).sum())


def picked(logits: np.ndarray, rows: np.ndarray, at: np.ndarray, one: np.ndarray, total: np.ndarray, most: float = np.inf) -> np.ndarray:
    """The logit at one place of each row, and in ``total`` the sum of the row's exponentials; overwrites ``logits``, which stay far from what exp can hold (BOUND; ``most`` is a known bound of them)."""
    if most > BOUND:
        np.minimum(logits, BOUND, out=logits)
    found = logits[rows, at]
    np.exp(logits, out=logits)
    np.matmul(logits, one[: logits.shape[1]], out=total)
    return found


def with_one(h: np.ndarray) -> np.ndarray:
    """States beside a one, whose weights are the biases."""
    out = np.empty((len(h), STATE + 1), h.dtype)
    out[:, :STATE] = h
    out[:, STATE] = 1
    return out


def advanced(x: np.ndarray, a: np.ndarray, h: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The state ``new`` after ``h`` from the ``planes`` of the input and of what the state adds; ``x`` becomes the gates and the candidate."""
    gates, c = x[:2], x[2]
    gates += a[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], a[2], out=a[1])
    c += a[1]
    np.tanh(c, out=c)
    np.subtract(h, c, out=new)
    new *= gates[0]
    new += c
    return new


@dataclass
class Network:
    embed: np.ndarray  # (head + tail classes, EMBED)
    enter: np.ndarray  # (EMBED, 3 STATE): update gate, reset gate, candidate
    shift: np.ndarray
    keep: np.ndarray  # (STATE, 3 STATE)
    to_class: np.ndarray  # (STATE, classes)
    class_bias: np.ndarray
    to_word: np.ndarray  # (head classes, CLASS, STATE)
    word_bias: np.ndarray  # (head classes, CLASS); slots without a word are out of reach

    @classmethod
    def start(cls, v: Vocabulary) -> Network:
        rng = np.random.default_rng(13)

        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        head, c = len(v.count), v.classes
        mass = np.full((c, CLASS), -1e9)
        mass.reshape(-1)[:head] = np.log(v.count + 0.5)
        top = mass.max(1, keepdims=True)
        head_mass = top[:, 0] + np.log(np.exp(mass - top).sum(1))
        class_mass = np.concatenate([head_mass, np.log(v.tail)])
        top = class_mass.max()
        return cls(
            normal(0.3, head + TAIL, EMBED), normal(EMBED**-0.5, EMBED, 3 * STATE), np.zeros(3 * STATE, np.float32), normal(STATE**-0.5, STATE, 3 * STATE),
            np.zeros((STATE, c + TAIL), np.float32), (class_mass - top - np.log(np.exp(class_mass - top).sum())).astype(np.float32),
            normal(0.01, c, CLASS, STATE), (mass - head_mass[:, None]).clip(-1e9).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        """A network of these weights in the shapes of this one."""
        ends = np.cumsum([a.size for a in self.arrays()])[:-1]
        return Network(*[part.reshape(a.shape).copy() for part, a in zip(np.split(flat, ends), self.arrays(), strict=True)])

    def copy(self) -> Network:
        return Network(*[a.copy() for a in self.arrays()])

    def entered(self) -> np.ndarray:
        """What each input adds to the gates."""
        return self.embed @ self.enter + self.shift

    def planes(self, weight: np.ndarray) -> np.ndarray:
        """A (rows, 3 STATE) table as (3, rows, STATE), so that what a step reads lies together; the gates negated, as their exponentials are taken of it."""
        out = np.ascontiguousarray(weight.reshape(len(weight), 3, STATE).transpose(1, 0, 2))
        np.negative(out[:2], out=out[:2])
        return out

    def steps(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """States before and after each step, the gates and candidates (in place of ``x``) and what the reset gate lets through, of (3, steps, lanes, STATE)
        ``planes`` of inputs; ``fresh`` lanes start anew."""
        keep, many = self.planes(self.keep), x.shape[1]
        before, after, passed = (np.empty(x.shape[1:], x.dtype) for _ in range(3))
        a = np.empty((3, *h.shape), x.dtype)
        for t in range(many):
            own, new = before[t], after[t]
            own[...] = h
            own[fresh[t]] = 0
            np.matmul(own, keep, out=a)
            passed[t] = a[2]
            h = advanced(x[:, t], a, own, new)
        return before, after, passed

    def advance(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """``steps`` without what backpropagation needs; ``keep`` are the ``planes`` of the weights."""
        states, a = np.empty(x.shape[1:], x.dtype), np.empty((3, *h.shape), x.dtype)
        anew, h = fresh.any(1).tolist(), h.copy()
        for t, some in enumerate(anew):
            if some:
                h[fresh[t]] = 0
            h = advanced(x[:, t], np.matmul(h, keep, out=a), h, states[t])
            if t + 1 < len(anew) and anew[t + 1]:
                h = h.copy()
        return states

    def log_prob(self, h: np.ndarray, target: np.ndarray, head: int) -> np.ndarray:
        """Natural logarithms: of the class, and within a head class of the word."""
        c, n = len(self.to_word), len(h)
        # states lie between -1 and 1
        most, most_word = float((np.abs(self.to_class).sum(0) + self.class_bias).max()), (np.abs(self.to_word).sum(2) + self.word_bias).max(1).tolist()
        cls = np.where(target < head, target // CLASS, c + target - head)
        h = with_one(h)
        to_class = np.vstack([self.to_class, self.class_bias[None]])
        to_word = np.ascontiguousarray(np.concatenate([self.to_word, self.word_bias[:, :, None]], 2).transpose(0, 2, 1))
        found, total = np.empty(n), np.empty(n, np.float32)
        logits, rows, one = np.empty((min(n, ROWS), to_class.shape[1]), h.dtype), np.arange(min(n, ROWS)), np.ones(max(to_class.shape[1], CLASS), np.float32)
        for at in range(0, n, ROWS):
            part = h[at : at + ROWS]
            found[at : at + ROWS] = picked(np.matmul(part, to_class, out=logits[: len(part)]), rows[: len(part)], cls[at : at + ROWS], one, total[at : at + ROWS], most)
        found -= np.log(total)
        # words of head classes, class after class
        order = by_class(cls)
        ends = np.searchsorted(cls[order], np.arange(c + 1)).tolist()
        order = order[: ends[-1]]
        slot, inner, words = target[order] % CLASS, np.empty(len(order)), np.empty((min(n, ROWS), CLASS), h.dtype)
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            for at in range(i, j, ROWS):
                to = min(j, at + ROWS)
                inner[at:to] = picked(np.matmul(h.take(order[at:to], axis=0), to_word[k], out=words[: to - at]), rows[: to - at], slot[at:to], one, total[at:to], most_word[k])
        inner -= np.log(total[: len(order)])
        found[order] += inner
        return found


def gradients(net: Network, x: np.ndarray, y: np.ndarray, h0: np.ndarray, end: int, head: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Of the mean loss over one window of (steps, lanes) inputs and targets, the state after it, and the loss."""
    c, lanes, steps, kind = len(net.to_word), x.shape[1], len(x), net.keep.dtype
    fresh = x == end
    gates = net.planes(net.entered()).take(x.reshape(-1), axis=1).reshape(3, steps, lanes, STATE)
    before, states, passed = net.steps(gates, fresh, h0)
    h, target = with_one(states.reshape(-1, STATE)), y.reshape(-1)
    n = len(target)
    cls, every = np.where(target < head, target // CLASS, c + target - head), np.arange(n)
    d = h @ np.vstack([net.to_class, net.class_bias[None]])
    softmax(d, n, near(np.abs(net.to_class).sum(0), net.class_bias))
    loss = loss_of(d[every, cls] * n)
    d[every, cls] -= 1 / n
    of_class = h.T @ d
    dh = d @ net.to_class.T
    # words of head classes, class after class
    rows = by_class(cls)
    ends = np.searchsorted(cls[rows], np.arange(c + 1)).tolist()
    rows = rows[: ends[-1]]
    own, at = h.take(rows, axis=0), (np.arange(len(rows)), target[rows] % CLASS)
    present = [(k, i, j) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
    to_word, of_word = np.concatenate([net.to_word, net.word_bias[:, :, None]], 2), np.zeros((c, CLASS, STATE + 1), kind)
    d, back_h = np.empty((len(rows), CLASS), kind), np.empty((len(rows), STATE), kind)
    for k, i, j in present:
        np.dot(own[i:j], to_word[k].T, out=d[i:j])
    softmax(d, n, near(np.abs(net.to_word).sum(2), net.word_bias))
    loss += loss_of(d[at] * n)
    d[at] -= 1 / n
    for k, i, j in present:
        np.dot(d[i:j].T, own[i:j], out=of_word[k])
        np.dot(d[i:j], net.to_word[k], out=back_h[i:j])
    dh[rows] += back_h
    dh = dh.reshape(steps, lanes, STATE)
    # what a step back is multiplied by: for the gates, the candidate's part of the state, the candidate and the state itself
    (z, r, cand), by, da = gates, np.empty((4, steps, lanes, STATE), kind), np.empty((4, steps, lanes, STATE), kind)
    np.subtract(before, cand, out=by[0])
    by[0] *= z
    rest = 1 - z
    by[0] *= rest
    np.multiply(cand, cand, out=by[3])
    np.subtract(1, by[3], out=by[3])
    by[3] *= rest
    np.multiply(by[3], r, out=by[2])
    np.subtract(1, r, out=by[1])
    by[1] *= by[2]
    by[1] *= passed
    back, keep = np.zeros((lanes, STATE), kind), np.ascontiguousarray(net.keep.reshape(STATE, 3, STATE).transpose(1, 2, 0))
    added = np.empty((3, lanes, STATE), kind)
    for t in range(steps - 1, -1, -1):
        back += dh[t]
        np.multiply(back, by[:, t], out=da[:, t])
        np.matmul(da[:3, t], keep, out=added)
        back *= z[t]
        back += added[0]
        back += added[1]
        back += added[2]
        back[fresh[t]] = 0
    flat = da.reshape(4, n, STATE)
    d_keep = np.matmul(before.reshape(-1, STATE).T, flat[:3])
    # the candidate's input does not pass the reset gate
    flat = flat[[0, 1, 3]]
    inputs = np.ones((n, EMBED + 1), kind)
    inputs[:, :EMBED] = net.embed.take(x.reshape(-1), axis=0)
    entering = np.matmul(inputs.T, flat)
    side = [np.ascontiguousarray(part.transpose(1, 0, 2).reshape(len(part[0]), 3 * STATE)) for part in (d_keep, entering)]
    order = by_class(x)
    word = x.reshape(-1)[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    d_embed = np.zeros_like(net.embed)
    to_embed = np.matmul(flat, net.enter.reshape(EMBED, 3, STATE).transpose(1, 2, 0))
    d_embed[word[first]] = np.add.reduceat((to_embed[0] + to_embed[1] + to_embed[2]).take(order, axis=0), first)
    g = [d_embed, side[1][:EMBED], side[1][EMBED], side[0], of_class[:STATE], of_class[STATE], of_word[:, :, :STATE], of_word[:, :, STATE]]
    return g, states[-1], loss / n


class Training:
    """A network with the means of Adam, learning from one stream (documents end to end, each with its end) after the other."""

    def __init__(self, net: Network):
        self.net, self.i = net, 0
        self.m, self.s, self.moved = ([np.zeros_like(a) for a in net.arrays()] for _ in range(3))

    def learn(self, stream: np.ndarray, v: Vocabulary, lanes: int, windows: int | None = None, turns: int = 1) -> None:
        """So many windows of the stream, or all of them in so many turns."""
        lanes_of, per = lanes, len(stream) // lanes
        if per < 2:
            # fewer tokens than two steps of all lanes: one lane
            lanes_of, per = 1, len(stream)
        if per < 2:
            return
        # what does not fill the lanes is a last step of some of them: the stream is filled up with ends
        per = -(-len(stream) // lanes_of)
        filled = np.concatenate([stream, np.full(per * lanes_of - len(stream), v.end, np.int64)])
        y = filled.reshape(lanes_of, per).T
        x = np.vstack([np.full((1, lanes_of), v.end), y[:-1]])
        h, many = np.zeros((lanes_of, STATE), np.float32), -(-per // STEPS)
        for k in range(many * turns if windows is None else windows):
            at = k % many * STEPS
            if at == 0:
                h = np.zeros_like(h)
            g, h, _ = gradients(self.net, x[at : at + STEPS], y[at : at + STEPS], h, v.end, len(v.count))
            self._step(g)

    def _step(self, g: list[np.ndarray]) -> None:
        self.i += 1
        i, g = self.i, [np.ascontiguousarray(a) for a in g]
        norm = float(np.sqrt(sum(float(a.reshape(-1) @ a.reshape(-1)) for a in g)))
        rate, scale, of_square = RATE * min(1.0, i / 20) / (1 - 0.9**i), min(1.0, 1 / max(norm, 1e-9)), 1 / (1 - 0.99**i)
        for a, b, mean, square, moved in zip(self.net.arrays(), g, self.m, self.s, self.moved, strict=True):
            np.multiply(b, 0.1 * scale, out=moved)
            mean *= 0.9
            mean += moved
            moved *= moved
            square *= 0.99
            square += moved
            np.multiply(square, of_square, out=moved)
            np.sqrt(moved, out=moved)
            moved += 1e-6
            np.divide(mean, moved, out=moved)
            moved *= rate
            a -= moved


def train(net: Network, stream: np.ndarray, v: Vocabulary, windows: int) -> Network:
    """The network after so many windows of the stream."""
    learning = Training(net)
    learning.learn(stream, v, TRAIN_LANES, windows)
    return learning.net


def stream_of(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Ids of all texts end to end, each with its end, the place after each text, word numbers (-1 for ends), and the distinct words."""
    number, owner, words = split_words(texts, LOWER)
    size = np.bincount(owner, minlength=len(texts)) + 1
    ends = np.cumsum(size)
    ids, at = np.full(int(ends[-1]) if len(ends) else 0, v.end, np.int64), np.arange(len(owner)) + owner
    numbers = np.full(len(ids), -1, np.int64)
    ids[at], numbers[at] = v.ids(words)[number], number
    return ids, ends, numbers, words


def log_probs(net: Network, entered: np.ndarray, ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Natural logarithm of the network's part of each document's probability. Documents are dealt to lanes, longest first; lanes of fewer words stop earlier."""
    sizes = np.diff(ends, prepend=0)
    order, lanes = np.argsort(-sizes, kind="stable"), min(LANES, len(sizes))
    load_of, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for d in order.tolist():
        k = int(load_of.argmin())
        dealt[k].append(d)
        load_of[k] += sizes[d]
    rank = np.argsort(-load_of, kind="stable")
    load_of, dealt = load_of[rank], [dealt[k] for k in rank]
    # the words of all lanes, lane after lane
    place = np.concatenate([np.arange(ends[d] - sizes[d], ends[d]) for lane in dealt for d in lane]) if lanes else np.zeros(0, np.int64)
    own, begin, head = ids[place], np.cumsum(load_of) - load_of, len(v.count)
    found, h, last = np.zeros(len(ids)), np.zeros((lanes, STATE), np.float32), np.full(lanes, v.end)
    table, keep, held, size = net.planes(entered), net.planes(net.keep), [], 0

    def emit() -> None:
        states, targets, where = (np.concatenate(part) for part in zip(*held, strict=True))
        found[where] = net.log_prob(states, targets, head)
        held.clear()

    for at in range(0, int(load_of.max(initial=0)), WINDOW):
        live, t = int((load_of > at).sum()), np.arange(at, min(at + WINDOW, int(load_of[0])))[:, None]
        real, here = t < load_of[:live], begin[:live] + t
        y = np.where(real, own[np.minimum(here, len(own) - 1)], v.end)
        x = np.vstack([last[None, :live], y[:-1]])
        states = net.advance(table.take(x.reshape(-1), axis=1).reshape(3, *x.shape, STATE), x == v.end, h[:live], keep)
        h, last = states[-1], y[-1]
        every = real.all()
        held.append((states.reshape(-1, STATE), y.reshape(-1), here.reshape(-1)) if every else (states[real], y[real], here[real]))
        size += len(held[-1][1])
        if size >= AT_ONCE:
            emit()
            size = 0
    if held:
        emit()
    out = np.empty(len(ids))
    out[place] = found
    return np.add.reduceat(out, ends - sizes) if len(ends) else np.zeros(0)


def _scored(model, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = model.value, learned.value
        entered, head = net.entered(), len(v.count)
        log_head, log_tail, log_known = np.log10(v.count + 0.5), np.log10(v.tail), np.log10(v.known_count + 0.5)
        log_all = np.log10(v.total + 0.5 * (v.distinct + 1))
        for number, block in in_blocks(batches, BLOCK):
            ids, ends, numbers, words = stream_of(only_chunk(block.column("text")), v)
            sizes = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            in_head = ids < head
            of_head, rest = np.where(in_head, ids, 0), np.where(in_head, 0, ids - head)
            base = np.bincount(owner, np.where(in_head, log_head[of_head], 0.0), len(sizes)) - sizes * log_all
            known = np.bincount(owner, in_head & (v.count[of_head] > 0), len(sizes)).astype(np.int64)
            score = log_probs(net, entered, ids, ends, v) / np.log(10) - np.bincount(owner, np.where(in_head, 0.0, log_tail[rest]), len(sizes))
            # words of the tail: those whose counts came along, and those that are asked for
            own, number_of = owner[~in_head], numbers[~in_head]
            at = np.asarray(pc.fill_null(pc.index_in(words, v.known), -1))
            more = np.bincount(own, np.append(log_known, 0.0)[at][number_of], len(sizes))
            base, score, told = base + more, score + more, (at >= 0)[number_of]
            known += np.bincount(own[told], minlength=len(sizes))
            own, number_of = own[~told], number_of[~told]
            asked = np.flatnonzero(np.bincount(number_of, minlength=len(words)))
            place, width = np.searchsorted(asked, number_of), max(1, len(asked))
            item, times = np.unique(own * width + place, return_counts=True)
            docs = pa.StructArray.from_arrays(
                [block.column("doc_id").combine_chunks(), block.column("held_out").combine_chunks(), *map(pa.array, (sizes, known, base, score))], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )
            docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            words = pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), words.take(pa.array(asked)))
            yield pa.RecordBatch.from_arrays([pa.array([number]), docs, pa.array([packed(item // width, item % width, times)], pa.binary()), words], ["block", "docs", "items", "words"])

    return run


def _finished(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch.column("docs").slice(r, 1).flatten()
                found = batch.column("found").slice(r, 1).flatten()
                count = np.zeros(len(found), np.int64)
                if len(found):
                    count[np.asarray(found.field(0))] = np.asarray(pc.fill_null(found.field(1), 0))
                owner, word, times = unpacked(batch.column("items")[r].as_py())
                more = np.bincount(owner, times * np.log10(count + 0.5)[word], len(docs)) if len(owner) else np.zeros(len(docs))
                known = np.zeros(len(docs), np.int64)
                np.add.at(known, owner, times * (count[word] > 0))
                own = [docs.field(i) for i in range(6)]
                out = [*own[:3], pa.array(np.asarray(own[3]) + known), pa.array(np.full(len(docs), total)), pa.array(np.asarray(own[4]) + more), pa.array(np.asarray(own[5]) + more)]
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in RESULT.split(", ")])

    return run


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, n, cls): the head, the sums of TAIL classes and the KNOWN words reach the driver."""
    band = F.floor(F.log2("n") * 4).cast("int")
    bands = counts.groupBy("cls", band.alias("band")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    head = [(r["word"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(HEAD).collect()]
    if END not in (w for w, _ in head):
        ends = counts.where(F.col("word") == END).select("n").first()
        head = [*head[: HEAD - 1], (END, ends["n"] if ends else 0)]
    n, words, in_band = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64), Counter()
    for r in bands:
        n[r["cls"]] += r["n"]
        words[r["cls"]] += r["words"]
        in_band[r["band"]] += r["words"]
    total, distinct = int(n.sum()), int(words.sum())
    for w, c in head:
        if c:
            n[tail_class(w)] -= c
            words[tail_class(w)] -= 1
    # bands of the most frequent words, as many as hold no more than KNOWN with the head's
    ranked = sorted(in_band, reverse=True)
    whole = int(np.searchsorted(np.cumsum([in_band[k] for k in ranked]), KNOWN, "right"))
    known = counts.where((band >= ranked[whole - 1]) & (F.octet_length("word") <= KNOWN_BYTES)).select("word", "n").toArrow() if whole else pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    rank = {w: i for i, (w, _) in enumerate(head)}
    known = known.filter(pc.invert(pc.is_in(known.column("word"), value_set=pa.array(rank, pa.string()))))
    return Vocabulary(rank, np.array([c for _, c in head], np.int64), n + 0.5 * (words + 1), total, distinct, only_chunk(known.column("word")), np.asarray(known.column("n"), np.int64))


def _trained(model, learned, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, shard, learning, held, size = model.value, None, None, [], 0

        def learn() -> None:
            ids = stream_of(pa.array(held, pa.string()), v)[0]
            learning.learn(ids, v, max(TRAIN_LANES, min(MOST_LANES, len(ids) // (8 * STEPS))), turns=turns)
            held.clear()

        for batch in batches:
            for own, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held and (own != shard or size >= TRAIN_BLOCK):
                    learn()
                    size = 0
                if own != shard:
                    if learning:
                        yield weight_rows(shard, learning.net.flat())
                    shard, learning = own, Training(learned.value.copy())
                held.append(text)
                size += len(text)
        if held:
            learn()
        if learning:
            yield weight_rows(shard, learning.net.flat())

    return run


def fit(docs: DataFrame, v: Vocabulary) -> Network:
    """The network of all of ``docs``: shards are trained in tasks of their own, their weights are averaged."""
    spark, net = docs.sparkSession, Network.start(v)
    shards = min(MOST_SHARDS, max(1, v.total // SHARD_TOKENS))
    # a short corpus is taken whole in each round
    whole = v.total * ROUNDS <= LEAST
    turns = max(1, round(LEAST / max(1, v.total * (ROUNDS if whole else 1))))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).withColumn("turn", F.pmod(F.xxhash64("h"), F.lit(ROUNDS)))
    model = spark.sparkContext.broadcast(v)
    for i in range(ROUNDS):
        learned = spark.sparkContext.broadcast(net)
        own = rows if whole else rows.where(F.col("turn") == i)
        own = own.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("h", F.lit(i)), "text").select("shard", "text")
        mean = averaged(own.mapInArrow(lean(_trained(model, learned, turns)), WEIGHTS))
        if mean is not None:
            net = net.filled(mean)
        learned.unpersist()
    return net


def score_documents(docs: DataFrame) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    learn = docs.where(~F.col("held_out"))
    counts = scratch.keep(learn.select("text").mapInArrow(count_words, "word string, n long, cls int").groupBy("word").agg(F.sum("n").alias("n"), F.max("cls").alias("cls")))
    v = vocabulary(counts)
    model, learned = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(fit(learn, v))
    blocks = scratch.keep(docs.mapInArrow(_scored(model, learned), BLOCKS))
    found = block_values(blocks, "words", counts.select("word", "n"), "word")
    rows = blocks.select("block", "docs", "items").join(found, "block", "left").select("docs", "items", "found")
    return rows.mapInArrow(_finished(v.total), RESULT)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))
