"""Passages that stand in documents about as they are: an approximate substring join without comparing each passage with each document.

A window of a document as long as the passage is close enough if difflib's ratio of both is ENOUGH; windows lie a quarter of the passage's length apart, as
``functions.udfs.quote_similarity`` has them. Three steps find them:

1. seeds: whatever k words in a row a passage and a document share, k being 3, or 2 and 1 for passages of few words (SEEDS). An altered, lost or new word spoils at most k of the
   places in a row, so a passage of n words with fewer than (n - 2) / k altered ones, a quarter or more, always shares a seed with its copy (the first and the last word
   are left out where there are five words or more, because a copy may cut them). Keys of the stated passages are few and go to the documents' windows;
2. diagonals: seeds of one document and passage with the same distance between their places are one diagonal;
3. windows: only those near a diagonal are compared, and of those only what may still reach ENOUGH by the letters and by the longest common subsequence of both.

Texts are normalised and their seeds hashed by two short helpers on bytes, as Spark's ``lower`` and regular expressions took most of the time; seeds meet in Spark.

What is left out has no seed near a window, that is, a quarter of the passage's words or more are touched there, spread so that k in a row are never whole. A ratio
may reach 0.8 then only if these are typing errors or short words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from docnav.functions.text import norm_quote
from docnav.functions.udfs import ENOUGH, SURE, Same

#: Words of a seed, and the words that a passage has at least for it.
SEEDS = {1: 1, 2: 8, 3: 15}
#: What a byte of UTF-8 becomes, but for the two characters outside ASCII that have a small letter of ASCII.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in b"abcdefghijklmnopqrstuvwxyz0123456789%$., " else 0x20 for b in range(256))
_DOTTED_I, _KELVIN = "\u0130".encode(), "\u212a".encode()
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Rows of a batch of seeds, and words whose hashes a worker keeps.
ROWS, MOST_WORDS = 1000, 500_000


def plain(raw: bytes) -> bytes:
    """What ``norm_quote`` makes of a text in UTF-8."""
    return b" ".join(raw.replace(_DOTTED_I, b"i ").replace(_KELVIN, b"k").translate(_PLAIN).split())


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def in_a_row(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, by place."""
    if len(hashes) < n:
        return np.empty(0, np.int64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : len(hashes) - n + 1 + k]
    return out.view(np.int64)


def with_seeds(rows: DataFrame, ns: tuple[int, ...]) -> DataFrame:
    """For each row of ``rows(text, ...)`` and each n of ``ns`` a row with the columns beside text, n and ``keys``, the seeds of n words by place."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                hashes = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in (plain(t).split() for t in batch.column("text").cast(pa.binary()).to_pylist())]
                for n in ns:
                    keys = [in_a_row(h, n) for h in hashes]
                    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([n] * len(keys), pa.int32()), lists], [*(f.name for f in kept), "n", "keys"])

    return rows.mapInArrow(run, StructType([*kept, StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))]))


def near_windows(quote: str, text: str, diagonals: list[int]) -> list[int]:
    """Starts of the grid's windows within half a passage of a diagonal, and at least the two next to it."""
    width = len(quote)
    step, last = max(1, width // 4), max(0, len(text) - width)
    grid = last // step
    found = set()
    for d in diagonals:
        low, high = min(max(0, -(-(d - width // 2) // step)), grid), max(0, min((d + width // 2) // step, grid))
        found.update(range(min(low, high), max(low, high) + 1))
    return [k * step for k in sorted(found)]


class _Passage:
    """A normalised passage, and bounds of what a window has in common with it."""

    def __init__(self, quote: str):
        self.same, self.letters, self.at = Same(quote), np.bincount(np.frombuffer(quote.encode(), np.uint8), minlength=128), [0] * 128
        for i, c in enumerate(quote.encode()):
            self.at[c] |= 1 << i

    def may_reach(self, window: bytes, least: float) -> bool:
        """False only if the ratio of passage and window is below ``least``: twice the characters in common, in any order and then in order (blocks of difflib are a
        common subsequence), by both lengths."""
        width = len(self.same.quote)
        enough = (least - 1e-9) * (width + len(window)) / 2
        if np.minimum(np.bincount(np.frombuffer(window, np.uint8), minlength=128), self.letters).sum() < enough:
            return False
        # bits that are 0 at the end are the longest common subsequence
        free = whole = (1 << width) - 1
        for c in window:
            met = free & self.at[c]
            free = ((free + met) | (free - met)) & whole
        return width - free.bit_count() >= enough


_passage = lru_cache(maxsize=2048)(_Passage)


@lru_cache(maxsize=2)
def _text(raw: str) -> tuple[str, bytes, np.ndarray]:
    """A text normalised, as bytes too, and where its words begin; the pairs of a document come one after the other."""
    text = plain(raw.encode("utf-8", "surrogatepass"))
    return text.decode(), text, np.append(0, np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1)


def window_similarity(quote: str, raw: str, seeds: list[tuple[int, int]]) -> tuple[bool, float]:
    """(found, ratio) of a normalised passage and a text like ``quote_similarity``, from windows near ``seeds`` (number of a word in the text, characters before it in
    the passage). Below ENOUGH the ratio may be of fewer windows than these."""
    text, codes, offset = _text(raw)
    if text.find(quote) >= 0:
        return True, 1.0
    starts = near_windows(quote, text, [int(offset[i]) - j for i, j in seeds])
    width, best, passage = len(quote), 0.0, _passage(quote)
    for start in starts:
        if not passage.may_reach(codes[start : start + width], max(best, ENOUGH)):
            continue
        best = max(best, passage.same.ratio(text[start : start + width]))
        if best > SURE:
            break
    return best >= ENOUGH, round(best, 3)


@F.pandas_udf(StructType([StructField("found", BooleanType()), StructField("ratio", DoubleType())]))
def _compared(quote: pd.Series, text: pd.Series, seeds: pd.Series) -> pd.DataFrame:
    rows = [window_similarity(q, t, [(s["i"], s["before"]) for s in ss]) for q, t, ss in zip(quote, text, seeds, strict=True)]
    return pd.DataFrame(rows, columns=["found", "ratio"])


def passage_matches(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, item_id, ratio): documents of ``docs(doc_id, text)`` that hold a passage of ``passages(item_id, text)`` at a ratio of ENOUGH; of several texts with one id the best.

    Rows without an id or text are left out, and passages that are empty once normalised. Passages of fewer than five words need one of their words whole.
    """
    items = passages.where("item_id is not null").select("item_id", norm_quote(F.col("text")).alias("quote")).where("quote <> ''")
    size = F.size(F.split("quote", " "))
    needed = F.greatest(*[F.when(size >= least, n) for n, least in SEEDS.items()])
    ns = tuple(sorted(r["n"] for r in items.select(needed.alias("n")).distinct().collect())) or (1,)
    named = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("digest"), "text")
    words = F.split("quote", " ")
    before = F.length(F.array_join(F.slice(words, F.lit(1), F.col("j")), " ")) + F.when(F.col("j") > 0, 1).otherwise(0)
    skip = F.when(size >= 5, 1).otherwise(0)
    keys = with_seeds(items.select("item_id", "quote", F.col("quote").alias("text")), ns).where(F.col("n") == needed).select("item_id", "quote", "n", F.posexplode("keys").alias("j", "key"))
    keys = keys.where((F.col("j") >= skip) & (F.col("j") + F.col("n") <= size - skip)).select("item_id", "quote", "n", "j", before.alias("before"), "key")
    places = with_seeds(named, ns).select("doc_id", "digest", "n", F.posexplode("keys").alias("i", "key"))
    met = places.join(keys, ["n", "key"]).groupBy("doc_id", "digest", "item_id", "quote", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.min(F.struct("i", "before")).alias("seed"))
    # a document meets a passage in as many diagonals as it has copies or chance seeds of it
    seeds = met.groupBy("doc_id", "digest", "item_id", "quote").agg(F.collect_list("seed").alias("seeds"))
    compared = named.join(seeds, ["doc_id", "digest"]).select("doc_id", "item_id", _compared("quote", "text", "seeds").alias("r")).where("r.found")
    return compared.groupBy("doc_id", "item_id").agg(F.max("r.ratio").alias("ratio"))
