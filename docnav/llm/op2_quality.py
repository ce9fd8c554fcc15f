"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text (shares of kinds of characters, lengths of words and lines, repetition of words, word
sequences and lines). Trees of a fixed depth are grown on BINS-bin histograms with logistic loss, and
flattened into arrays (split feature, split value, leaf value); scoring walks all documents of a batch down each tree with numpy
at once.

Rows for learning are a bounded sample of the learning fold: up to PER_CLASS of each label, chosen by a hash of the id,
weighing what they stand for. Only their statistics reach the driver.

Defined results: null and empty texts have statistics of 0 and are scored like any; repeated rows repeat; a null doc_id is
not held out; null labels are left out, and of the rows of a repeated id the one with the smallest text is learned from; without labels of both kinds every score is 0; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.llm.common import load

PER_CLASS, TREES, DEPTH, BINS, RATE, L2, LEAST = 4000, 60, 4, 64, 0.15, 4.0, 8
FOLDS, HELD_OUT, CUT = 4, 2, 0.7

FEATURES = (
    "words", "mean_word", "sd_word", "longest_word", "short_words", "long_words", "distinct_words", "top_word", "top_pair", "repeated_fives",
    "upper", "digit", "space", "sentence", "other_ascii", "pipe", "star", "beyond_ascii", "symbol_words", "upper_words", "lines", "mean_line", "distinct_lines",
    "top_line", "short_lines", "repeated_starts", "compressed", "capitalised", "ended_lines", "same_neighbours",
)
_SENTENCE = [ord(c) for c in ".,;:?'\"()-"]
_PLAIN = set(b".,;:?!'\"()-")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(data)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    length = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    code = np.fromiter(map(zlib.crc32, words), np.int64, n)
    pairs = np.unique(code[:-1] * 31 + code[1:], return_counts=True)[1] if n > 1 else np.ones(1)
    fives = len(np.unique(code[:-4] + code[1:-3] * 3 + code[2:-2] * 5 + code[3:-1] * 7 + code[4:] * 11)) / (n - 4) if n > 4 else 1.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    line = Counter(lines)
    starts = Counter(x[:20] for x in lines)
    last = bytes(w[-1] for w in words)
    first = bytes(w[0] for w in words)
    upper, digit = byte[65:91].sum(), byte[48:58].sum()
    sentence = byte[_SENTENCE].sum()
    ascii_other = byte[33:127].sum() - byte[65:91].sum() - byte[97:123].sum() - digit - sentence
    return [
        np.log1p(n), length.mean(), length.std(), float(length.max()), (length <= 2).mean(), (length >= 12).mean(), len(count) / n, max(count.values()) / n, pairs.max() / n, 1 - fives,
        upper / size, digit / size, (byte[9:14].sum() + byte[32]) / size, sentence / size, ascii_other / size, byte[124] / size, (byte[42] + byte[35] + byte[36] + byte[37] + byte[38]) / size, byte[128:].sum() / size,
        sum(33 <= c < 127 and c not in _PLAIN and not 48 <= c < 58 and not 65 <= c < 91 and not 97 <= c < 123 for c in last) / n, sum(w.isupper() for w in count) / len(count),
        np.log1p(len(lines)), np.log1p(size / len(lines)), len(line) / len(lines), max(line.values()) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), 1 - len(starts) / len(lines),
        len(zlib.compress(data, 1)) / size, sum(65 <= c < 91 for c in first) / n, sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), float((code[1:] == code[:-1]).mean()) if n > 1 else 0.0,
    ]


@dataclass
class Forest:
    """Complete trees as arrays: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, 2 ** DEPTH - 1)
    value: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** DEPTH)
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            z += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Boosted trees; a node that no split improves sends all its rows to the left."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    bias = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    z, inner = np.full(n, bias), 2**DEPTH - 1
    features, values, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            local = node - first
            gains = np.full((m, wide), 0.0)
            cuts = np.zeros((m, wide), np.int64)
            for j in range(m):
                cell = local * BINS + binned[:, j]
                hist = [np.bincount(cell, v, wide * BINS).reshape(wide, BINS).cumsum(1) for v in (g, h, np.ones(n))]
                (gl, hl, cl), (gt, ht, ct) = hist, (a[:, -1:] for a in hist)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                cuts[j], gains[j] = gain.argmax(1), gain.max(1)
            best = gains.argmax(0)
            for k in range(wide):
                j = best[k]
                if gains[j, k] > 1e-9 and cuts[j, k] < len(edges[j]):
                    feature[first + k], value[first + k] = j, edges[j][cuts[j, k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > value[node])
        leaf = node - inner
        out = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        z += out[leaf]
        features.append(feature)
        values.append(value)
        leaves.append(out)
    return Forest(np.array(features), np.array(values), np.array(leaves), bias)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [statistics(t) for t in batch["text"]]})


def crc(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    known = labels.where(F.col("quality").isin(0, 1) & (crc("doc_id", FOLDS) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit(2))
    picked = known.where("label = 1").orderBy(order).limit(PER_CLASS).union(known.where("label = 0").orderBy(order).limit(PER_CLASS))
    # at most 2 * PER_CLASS small rows are broadcast, so the texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # an id that is repeated gives one row, so that the sample stays bounded
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("r")).select("doc_id", "r.*")
    rows = rows.mapInPandas(_measure, "doc_id long, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(np.int64)
    if len(set(y)) < 2:
        return None
    stands = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    return grow(np.array(rows["x"].tolist()), y, stands / stands.mean())


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            score = forest.score(x) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, score) of each row of ``docs(doc_id, text)``."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
