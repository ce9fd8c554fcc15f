"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values.

A text's 5-word shingles are hashed once. The high bits of a hash name one of BINS bins and each bin keeps its
least hash. An empty bin borrows from the bin that comes first in an order of its own (the same in every text) among the
filled ones. Of each filled bin the low BITS bits are stored, of an empty one BITS bits of a hash of the borrowed 64 bits
and the bin's number, so that bins are equal by chance independently of each other, however few are filled; likeness counts
equal bins and takes off the share that would be equal by chance.

Defined results: null text counts as empty; texts without words have the fingerprint "" (like 1 to each other, 0 to
others); equal texts have equal fingerprints; repeated rows give repeated rows; a null doc_id sorts last; rows
with equal doc_id follow each other by a hash of their text; an empty table gives no rows; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.llm.common import load, shingle_hashes

WORDS, BINS, BITS = 5, 256, 4
_SHIFT = np.uint64(64 - 8)
_ORDER = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None) -> bytes:
    """BINS values of BITS bits, packed two to a byte; empty for a text without words."""
    h = np.sort(shingle_hashes(text, WORDS))
    if not len(h):
        return b""
    first = np.flatnonzero(np.r_[True, (h[1:] >> _SHIFT) != (h[:-1] >> _SHIFT)])
    full = (h[first] >> _SHIFT).astype(np.int64)
    value = np.zeros(BINS, np.uint8)
    # the lowest bits of the hash: the high ones name the bin, and a minimum biases those just below them
    value[full] = (h[first] & np.uint64(15)).astype(np.uint8)
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        donor = h[first][_ORDER[np.ix_(empty, full)].argmin(axis=1)]
        value[empty] = (mixed(donor ^ mixed(empty.astype(np.uint64) + np.uint64(1))) & np.uint64(15)).astype(np.uint8)
    return (value[0::2] << 4 | value[1::2]).tobytes()


_EQUAL = np.array([[((a ^ b) & 15 == 0) + 0 + ((a ^ b) >> 4 == 0) for b in range(256)] for a in range(256)], np.uint8)


def likeness(a: bytes, b: bytes) -> float:
    """Estimate of the Jaccard similarity, 0 to 1, corrected for values equal by chance."""
    if not a or not b:
        return float(a == b)
    equal = int(_EQUAL[np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)].sum()) / BINS
    return min(1.0, max(0.0, (equal - 2.0**-BITS) / (1 - 2.0**-BITS)))


def edit(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, halo, doc_id, h, text) dealt into about ``parts`` ranges of descending doc_id (h, a hash of the text, orders rows of one id), each
    followed by the first row of the range after it (halo), and the last range by the first row of all. An id that fills several
    ranges, and rows without an id, are cut by h. Texts are shuffled once; what reaches the driver is ``parts`` numbers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    at = [i / parts for i in range(1, parts)]
    found, without, total = docs.agg(F.percentile_approx("doc_id", at, 10000), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    times = Counter(found or [])
    cuts = sorted(times, reverse=True)
    bucket = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1) if len(cuts) <= 64 else ():
        bucket = F.when(F.col("doc_id") > cuts[i], i).otherwise(bucket)
    if len(cuts) > 64:  # a search in a constant array keeps the expression small
        bucket = F.expr(f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c >= doc_id))")
    # an id that is several of the cuts is dealt into as many parts, in front of the other ids of its range
    pieces = {c: n for c, n in times.items() if n > 1}
    nulls = max(1, -(-without * parts // max(1, total)))
    wide = max([nulls, *pieces.values()]) + 1
    share = (F.shiftrightunsigned("h", 32) + (1 << 31)) % (1 << 32)  # h from the least, in 32 bits
    part = lambda n: F.floor(share * n / (1 << 32)).cast("int")
    sub = F.lit(wide - 1)
    for c, n in pieces.items():
        sub = F.when(F.col("doc_id") == c, part(n)).otherwise(sub)
    none = (len(cuts) + 1) * wide
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), none + part(nulls)).otherwise(bucket * wide + sub).cast("int"))
    first = {r["bucket"]: r["top"] for r in docs.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("not_h"))).alias("top")).collect()}
    # at most a few times ``parts`` ranges: each with its number in order and its first row
    order = sorted(first)
    ranges = docs.sparkSession.createDataFrame([(b, i, first[b]["doc_id"], ~first[b]["not_h"]) for i, b in enumerate(order)], "bucket int, number int, top long, top_h long")
    rows = docs.join(F.broadcast(ranges), "bucket")
    heads = rows.where(F.col("h") == F.col("top_h")).where(F.col("doc_id").eqNullSafe(F.col("top"))).dropDuplicates(["number"])
    before = F.pmod(F.col("number") - 1, F.lit(max(1, len(order)))).cast("int")
    columns = ("doc_id", "h", "text")
    return rows.select(F.col("number").alias("bucket"), F.lit(0).alias("halo"), *columns).union(heads.select(before, F.lit(1), *columns))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then in order; each waits for the row after it."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for bucket, halo, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "halo", "doc_id", "text")), strict=True):
            bucket, halo, text = bucket.as_py(), halo.as_py(), text.as_py()
            if held and held[1] and held[0] == bucket and halo:
                continue  # ties of the row that follows the bucket
            mark = fingerprint(text)
            if held and held[0] == bucket and not held[1]:
                _, _, own, body, print_ = held
                changed = edit(body, text)
                edited = print_ if changed == body else fingerprint(changed)
                out.append((own, len(body), hashlib.sha256(changed.encode()).hexdigest(), print_.hex(), edited.hex(), likeness(print_, edited), likeness(print_, mark)))
            held = (bucket, halo, doc_id.as_py(), text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), TYPES, strict=True)], schema=TYPES)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text, and their likeness (see the module's docstring)."""
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_next(docs, parts).repartitionById(parts, F.pmod("bucket", F.lit(parts)))
    ordered = dealt.sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "h")
    return ordered.mapInArrow(_walk, SCHEMA)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
