"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its prefixes. Filters of several widths slide over the
word vectors, and of each filter the POOL largest activations in the whole text are kept (max pooling that also shows
how often a pattern comes). A logistic layer gives the score. One embedding dimension starts from the shrunken
log-odds of each hash, the rest at random; all of it is then trained by Adagrad.

All labelled rows of the learning fold are learned from, whole, those of the rarer label with more weight: three quarters of them (by a hash of the id) train the network, the others calibrate
a threshold for each language (F1, within BOUNDS; languages with few rows take the threshold of all). Shards of about SHARD_ROWS rows are trained in tasks of their own, row by row, and
their weights and the sums of Adagrad are averaged in Spark, ROUNDS times over. In each round every row has its turn, or a quarter of them once all rounds would make more than STEPS steps: so each row is
learned from at least once and the work grows with the rows. Language decides the threshold of ``flagged`` only; it is no input of the score.

Defined results: null and empty texts get the score of a text without words; repeated rows repeat; a null doc_id is
not held out; null labels are left out, and of the rows of a repeated id the one with the smallest text is learned from; without labels of both
kinds every score is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from docnav.llm.common import WEIGHTS, Scratch, averaged, lean, load, unused, weight_rows

BUCKETS, DIM, WIDTHS, FILTERS, POOL = 1 << 15, 8, (1, 2, 3), 6, 4
PREFIXES = (3, 4, 5, 6, 7, 8)
EPOCHS, RATE = 4, 0.08
#: Rows of a shard, shards at most, averages, steps beyond which a row has one turn.
SHARD_ROWS, MOST_SHARDS, ROUNDS, STEPS = 10_000, 256, 4, 12_000
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
BOUNDS, LEAST_ROWS = (0.4, 0.8), 40
#: Bits of the map that tells labelled rows before they are shuffled.
BITS = 1 << 25
#: Words that a worker keeps from one group of texts to the next, characters of a group, words from which on they are hashed in numpy.
MOST_CACHED, GROUP, MANY = 60_000, 1 << 20, 64
_WORD = re.compile(r"\w+")
_hash = xxhash.xxh3_64_intdigest
OFFSETS = sum(WIDTHS)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets(word: str) -> list[int]:
    """Hashes of the word and its proper prefixes; BUCKETS itself pads."""
    n = len(word)
    return [_hash(word) % BUCKETS, *[_hash(word[:k], k) % BUCKETS if n >= k else BUCKETS for k in PREFIXES]]


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exclusive or of both halves of the products of 128 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    mid = a1 * b0 + (a0 * b0 >> half)
    rest = (mid & low) + a0 * b1
    return a * b ^ (a1 * b1 + (mid >> half) + (rest >> half))


def _hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """``_hash`` of the ``size`` bytes (one at least) of ``raw`` from each ``at``: XXH3 of up to 16 bytes in numpy, of more by its library. ``raw`` ends with 8 further bytes."""
    out, u = np.empty(len(at), np.uint64), np.uint64
    eight = np.ndarray(len(raw) - 7, u, raw, strides=1)
    i = np.flatnonzero(size < 4)
    if len(i):
        p, n = at[i], size[i]
        c = [raw[q].astype(u) for q in (p, p + n // 2, p + n - 1)]
        h = (c[0] << u(16) | c[1] << u(24) | c[2] | n.astype(u) << u(8)) ^ u(0x87275A9B + seed)
        h = (h ^ h >> u(33)) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
        out[i] = h ^ h >> u(32)
    i = np.flatnonzero((size >= 4) & (size <= 8))
    if len(i):
        p, n = at[i], size[i]
        flip = (0xC73AB174C5ECD5A2 - (seed ^ int.from_bytes(seed.to_bytes(4, "little")) << 32)) % (1 << 64)
        h = ((eight[p + n - 4] & u(0xFFFFFFFF)) + (eight[p] << u(32))) ^ u(flip)
        h ^= (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))
        h *= u(0x9FB21C651E98DF25)
        h ^= (h >> u(35)) + n.astype(u)
        h *= u(0x9FB21C651E98DF25)
        out[i] = h ^ h >> u(28)
    i = np.flatnonzero((size > 8) & (size <= 16))
    if len(i):
        p, n = at[i], size[i]
        a, b = eight[p] ^ u(0x6782737BEA4239B9 + seed), eight[p + n - 8] ^ u((0xAF56BC3B0996523A - seed) % (1 << 64))
        h = n.astype(u) + a.byteswap() + b + _folded(a, b)
        h = (h ^ h >> u(37)) * u(0x165667919E3779F9)
        out[i] = h ^ h >> u(32)
    for i in np.flatnonzero(size > 16):
        out[i] = _hash(raw[at[i] : at[i] + size[i]].tobytes(), seed)
    return out


def bucket_rows(words: list[str]) -> np.ndarray:
    """``buckets`` of each word; no word is empty."""
    if len(words) < MANY:
        return np.array([buckets(w) for w in words], np.int32).reshape(-1, 1 + len(PREFIXES))
    _, offsets, data = pa.array(words, pa.large_string()).buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1)
    raw = np.zeros(ends[-1] + 8, np.uint8)
    raw[:-8] = np.frombuffer(data, np.uint8, ends[-1])
    letters = np.append(np.flatnonzero((raw[:-8] & 0xC0) != 0x80), ends[-1])  # where characters begin
    first, at = np.searchsorted(letters, ends), ends[:-1]
    n, rows = np.diff(first), np.full((len(words), 1 + len(PREFIXES)), BUCKETS, np.int32)
    rows[:, 0] = _hashes(raw, at, np.diff(ends), 0) % np.uint64(BUCKETS)
    for j, k in enumerate(PREFIXES):
        i = np.flatnonzero(n >= k)
        rows[i, 1 + j] = _hashes(raw, at[i], letters[first[i] + k] - at[i], k) % np.uint64(BUCKETS)
    return rows


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Network:
    table: np.ndarray
    filters: np.ndarray  # (OFFSETS, DIM, FILTERS): the offsets of width 1, then of width 2, ...
    shift: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    bias: float
    thresholds: dict = field(default_factory=dict)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Features of one text from its responses (words, OFFSETS * FILTERS), and the positions that they come from."""
        n, at, feats, places = len(x), 0, [], []
        for i, w in enumerate(WIDTHS):
            s = np.zeros((n, FILTERS), np.float32)
            for o in range(w):
                s[: n - o] += x[o:, (at + o) * FILTERS : (at + o + 1) * FILTERS]
            at += w
            s += self.shift[i]
            if n > POOL:
                p = np.argpartition(s, n - POOL, axis=0)[n - POOL :]
                p = np.take_along_axis(p, np.argsort(-np.take_along_axis(s, p, 0), axis=0, kind="stable"), 0)
            else:
                p = np.argsort(-s, axis=0, kind="stable")
            top = np.zeros((POOL, FILTERS), np.float32)
            top[: len(p)] = np.maximum(np.take_along_axis(s, p, 0), 0)
            feats.append(top)
            places.append(p)
        return np.stack(feats), places

    def features(self, x: np.ndarray) -> np.ndarray:
        """Those of ``pooled`` without their positions, which takes less time: the largest values lie in rows of memory."""
        n, at, x, feats = len(x), 0, np.ascontiguousarray(x.T), np.zeros((len(WIDTHS), POOL, FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            s = x[at * FILTERS : (at + 1) * FILTERS].copy()
            for o in range(1, w):
                s[:, : n - o] += x[(at + o) * FILTERS : (at + o + 1) * FILTERS, o:]
            at += w
            s += self.shift[i][:, None]
            top = np.partition(s, n - POOL, axis=1)[:, n - POOL :] if n > POOL else s
            feats[i, : min(n, POOL)] = np.maximum(np.sort(top, axis=1)[:, ::-1], 0).T
        return feats

    def score(self, x: np.ndarray) -> float:
        z = float((self.features(x) * self.out).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _start(pos: np.ndarray, neg: np.ndarray, p: float, n: float) -> Network:
    """From the numbers of documents of both labels that hold each hash, and of all of them."""
    rng = np.random.default_rng(11)
    p, n = max(1, p), max(1, n)
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1))
    table = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[:, 0] = odds * (pos + neg) / (pos + neg + 8)
    table[BUCKETS] = 0
    filters = rng.normal(0, 0.1, (OFFSETS, DIM, FILTERS)).astype(np.float32)
    filters[:, 0, : FILTERS // 2] = np.abs(filters[:, 0, : FILTERS // 2]) + 0.3
    return Network(table, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), np.full((len(WIDTHS), POOL, FILTERS), 0.02, np.float32), float(np.log(p / n)))


class Words:
    """A row of numbers for each word of texts, their hashes unless ``made`` gives others; the rows of about MOST_CACHED words are kept."""

    def __init__(self, made: Callable[[list[str]], np.ndarray] = bucket_rows):
        self.made = made
        self._clear()

    def _clear(self) -> None:
        self.index, self.known, self.rows = _Numbers(), 0, None

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The rows of each text's words in order; the new words of a group of texts are looked up together."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= GROUP or i == len(texts) - 1:
                yield from self._group(texts[first : i + 1])
                first, size = i + 1, 0

    def _group(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        found = [tokens(t) for t in texts]
        if self.known > MOST_CACHED:
            self._clear()
        ends = np.cumsum([0, *map(len, found)]).tolist()
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, ends[-1])
        if len(self.index) > self.known or self.rows is None:
            fresh = self.made(list(islice(reversed(self.index), len(self.index) - self.known))[::-1])
            if self.rows is None:
                self.rows = fresh
            while len(self.rows) < len(self.index):
                self.rows = np.concatenate([self.rows, np.zeros((max(1024, len(self.rows)), *fresh.shape[1:]), fresh.dtype)])
            self.rows[self.known : len(self.index)] = fresh
            self.known = len(self.index)
        for first, end in zip(ends, ends[1:], strict=False):
            yield self.rows[ids[first:end]]

    def of(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))


class Learner:
    """A network with the sums of Adagrad, learning from one text after the other."""

    ARRAYS = ("table", "filters", "shift", "out")

    def __init__(self, net: Network):
        self.net, self.seen_bias = net, 1e-2
        self.state = {k: np.full(np.shape(getattr(net, k)), 1e-2, np.float32) for k in self.ARRAYS}

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self.net, k) for k in self.ARRAYS] + [self.state[k] for k in self.ARRAYS]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(a.reshape(-1) for a in self.arrays()), np.array([self.net.bias, self.seen_bias], np.float32)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for a in self.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        self.net.bias, self.seen_bias = float(flat[-2]), float(flat[-1])

    def _step(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        state = self.state[name]
        state[at] += grad**2
        getattr(self.net, name)[at] -= RATE * grad / np.sqrt(state[at])

    def learn(self, words: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One step from a text's word hashes."""
        net, n = self.net, len(words)
        vec = net.table[words].sum(1)
        feats, places = net.pooled(vec @ net.filters.transpose(1, 0, 2).reshape(DIM, -1))
        z = np.clip(float((feats * net.out).sum()) + net.bias, -30, 30)
        g = np.float32((1 / (1 + np.exp(-z)) - label) * weight)
        gf = g * net.out * (feats > 0)
        self._step("out", g * feats)
        self.seen_bias += float(g) ** 2
        net.bias -= RATE * float(g) / self.seen_bias**0.5
        self._step("shift", gf.sum(1))
        grad_filters, at, where, grads = np.zeros_like(net.filters), 0, [], []
        for i, w in enumerate(WIDTHS):
            p = places[i]
            r, f = np.nonzero(gf[i, : len(p)])
            part, first = gf[i, r, f][:, None], p[r, f]
            for o in range(w):
                inside = first + o < n
                q, own, fo = first[inside] + o, part[inside], f[inside]
                np.add.at(grad_filters[at + o].T, fo, own * vec[q])
                where.append(q)
                grads.append(own * net.filters[at + o].T[fo])
            at += w
        self._step("filters", grad_filters)
        where = np.concatenate(where)
        if len(where):
            unique, inverse = np.unique(words[where], return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse.ravel(), np.repeat(np.concatenate(grads), words.shape[1], 0))
            total[unique == BUCKETS] = 0
            self._step("table", total, unique)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Network:
    """A network of texts that lie in one process, after EPOCHS turns of each."""
    words = Words()
    docs = list(words.each(texts))
    held = {1: np.zeros(BUCKETS + 1), 0: np.zeros(BUCKETS + 1)}
    for d, label in zip(docs, y, strict=True):
        held[int(label)][np.unique(d)] += 1
    learner, rng = Learner(_start(held[1], held[0], float(y.sum()), float((1 - y).sum()))), np.random.default_rng(12)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(docs)):
            learner.learn(docs[d], int(y[d]), float(weight[d]))
    return learner.net


class Scorer:
    """Scores texts; a word's filter responses are kept from one text to the next."""

    def __init__(self, net: Network):
        self.net, self.flat = net, net.filters.transpose(1, 0, 2).reshape(DIM, -1)
        self.words = Words(self._responses)

    def _responses(self, words: list[str]) -> np.ndarray:
        held = bucket_rows(words).T
        vec = self.net.table[held[0]]
        for k in held[1:]:
            vec += self.net.table[k]
        return vec @ self.flat

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.net.score(x) for x in self.words.each(texts)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold within BOUNDS of the best weighted F1; the middle one among equals."""
    at = np.linspace(*BOUNDS, 41)
    f1 = [2 * (w := weight[(score >= a) & (y == 1)].sum()) / max(1e-9, w + weight[y == 1].sum() + weight[(score >= a) & (y == 0)].sum()) for a in at]
    good = at[np.array(f1) >= max(f1) - 1e-12]
    return float(good[len(good) // 2])


def crc(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, n): in how many texts of each label a hash is."""
    words, n = Words(), np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        for rows, toxic in zip(words.each(batch.column("text").to_pylist()), batch.column("toxic").to_pylist(), strict=True):
            here = np.zeros(BUCKETS + 1, bool)
            here[rows] = True
            n[toxic] += here
    toxic, bucket = np.nonzero(n)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "toxic": pa.array(toxic, pa.int32()), "n": pa.array(n[toxic, bucket])})


def _learned(model, weight: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, learner = Words(), None, None

        for batch in batches:
            for own, rows, toxic in zip(batch.column("shard").to_pylist(), words.each(batch.column("text").to_pylist()), batch.column("toxic").to_pylist(), strict=True):
                if own != shard:
                    if learner:
                        yield weight_rows(shard, learner.flat())
                    shard, learner = own, deepcopy(model.value)
                learner.learn(rows, toxic, weight[toxic])
        if learner:
            yield weight_rows(shard, learner.flat())

    return run


def _graded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, grid = Scorer(model.value), np.linspace(*BOUNDS, 41)
        for batch in batches:
            grade = np.searchsorted(grid, scorer.scores(batch.column("text").to_pylist()), "right")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(grade, pa.int32())], ["lang", "toxic", "grade"])

    return run


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``keys``, told by a bitmap of hashes (BITS, 4 MB at most), so that a join need not shuffle them; rows that
    are in ``keys`` all stay."""
    kinds = [df.schema[column].dataType for df in (rows, keys)]
    if not all(isinstance(k, IntegralType) for k in kinds) and kinds[0] != kinds[1]:
        return rows
    at = F.pmod(F.xxhash64(F.col(column).cast("long") if isinstance(kinds[0], IntegralType) else F.col(column)), F.lit(BITS))
    bucket, bits, place = (unused(rows, x) for x in ("bucket", "bits", "place"))
    maps = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits))
    met = rows.withColumn(place, F.bitmap_bit_position(at)).withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(maps), bucket)
    return met.where(F.expr(f"conv(hex(substring(`{bits}`, cast(`{place}` div 8 as int) + 1, 1)), 16, 10) & shiftleft(1, cast(`{place}` % 8 as int)) <> 0")).select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network of the labelled rows outside the held-out fold; None without rows of both labels."""
    spark, inside = docs.sparkSession, crc("doc_id", FOLDS) != HELD_OUT
    scratch = Scratch(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & inside).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.where(inside).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = among(rows, known, "doc_id").join(known, "doc_id")
    # an id that is repeated gives one row
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    rows = scratch.keep(rows.withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0))
    counts = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    if len({toxic for _, toxic in counts}) < 2:
        return None
    own = rows.where("not check").select("doc_id", "text", "toxic")
    p, n = (counts.get((False, toxic), 0) for toxic in (1, 0))
    learner, n = Learner(_begun(own, p, n)), n + p
    # the rarer label weighs more, by the root of what it is rarer
    weight = tuple(float(np.clip((n - x) / max(1, x), 1, 100) ** 0.5) for x in (n - p, p))
    shards = min(MOST_SHARDS, max(1, n // SHARD_ROWS))
    own = own.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")).withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(ROUNDS)))
    for i in range(ROUNDS):
        # each round has an order of its own
        dealt = (own if n * ROUNDS <= STEPS else own.where(F.col("turn") == i)).withColumn("h", F.xxhash64("doc_id", F.lit(10 + i))).repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id").select("shard", "text", "toxic")
        model = spark.sparkContext.broadcast(learner)
        mean = averaged(dealt.mapInArrow(lean(_learned(model, weight)), WEIGHTS))
        if mean is not None:
            learner.load(mean)
        model.unpersist()
    net = learner.net
    model = spark.sparkContext.broadcast(net)
    graded = rows.where("check").select("text", "lang", "toxic").mapInArrow(lean(_graded(model)), "lang string, toxic int, grade int").groupBy("lang", "toxic", "grade").count().toPandas()
    scratch.drop(rows)
    # a grade is the number of thresholds that a score reaches
    score = np.concatenate([[0.0], np.linspace(*BOUNDS, 41)])[graded["grade"].to_numpy(np.int64)]
    y, times = graded["toxic"].to_numpy(np.int64), graded["count"].to_numpy(np.float64)
    net.thresholds = {"": best_threshold(score, y, times) if len(score) else CUT}
    for lang, part in graded.groupby("lang"):
        at = part.index.to_numpy()
        if times[at].sum() >= LEAST_ROWS and len(set(y[at])) == 2:
            net.thresholds[lang] = best_threshold(score[at], y[at], times[at])
    return net


def _begun(rows: DataFrame, p: int, n: int) -> Network:
    """The network before its first step: log-odds of each hash from all of ``rows``."""
    found = rows.select("text", "toxic").mapInArrow(lean(_held), "bucket int, toxic int, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((2, BUCKETS + 1))
    held[found["toxic"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()
    return _start(held[1], held[0], p, n)


def _score(model, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value) if model.value else None
        for batch in batches:
            score = scorer.scores(batch.column(len(keep)).to_pylist()) if scorer else [0.0] * len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], [*keep, "score"])

    return run


def score_documents(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` with score, the language's threshold, and flagged."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", score double"
    scored = docs.select(*keep, F.col("text").alias("__text")).mapInArrow(_score(model, keep), schema)
    at = net.thresholds if net else {"": CUT}
    threshold = F.lit(at[""])
    for lang, x in at.items():
        if lang:
            threshold = F.when(F.col("lang") == lang, x).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))


def _accept(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        scorer = Scorer(net) if net else None
        for batch in batches:
            if scorer:
                at = [net.thresholds.get(x, net.thresholds[""]) for x in batch.column("lang").to_pylist()]
                keep = [x < a for x, a in zip(scorer.scores(batch.column("text").to_pylist()), at, strict=True)]
                batch = batch.filter(pa.array(keep, pa.bool_()))
            yield batch

    return run


def accepted(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs``, in its columns, that the threshold of their language does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(lean(_accept(model)), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "flagged")
