"""Helpers shared by the training-data operators.

Everything that outlives one job is written below the folder named by ``spark.checkpoint.dir``; a folder of
our own is set only where that setting is missing and Spark is one local process (tests, notebooks).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch on its way to Python; Spark's own bound is 64 MB.
ARROW_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES unless the session sets another bound. No result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, str(ARROW_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, through Spark's reader only (the path may be in a store that Python cannot open)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docnav-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir()
    return found


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def lean(run):
    """``run`` over the batches of a task; its worker gives memory back to the system when the task ends, so that workers which wait for the next task hold
    little. No result depends on it."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return whole


class Scratch:
    """Written tables that cut the lineage: a lost executor costs a reread, not the work before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/docnav/{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark._jvm  # noqa: SLF001
        for df in kept:
            if path := getattr(df, "_scratch_path", None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that each bit depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of the k-word windows of a text, in order and with repeats.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. With fewer than k words the whole sequence is one
    shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = word_hashes(words)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MIX1 + h[j : n - k + 1 + j]
    return mix(out)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each end of ``edges(a, b)``; root is the smallest node of the component.

    Alternates the large-star and small-star steps. Each step takes a minimum by key (combined before the shuffle)
    and joins it back, so a hub's edges can be split over tasks. Rounds are written out, and the rounds end when
    the edges no longer change; no edge reaches the driver.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = scratch.keep(small)
        scratch.drop(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def in_blocks(batches, chars: int, column: str = "text"):
    """(number, batch) of consecutive rows with about ``chars`` bytes of ``column`` each; a longer row is a block of its own. Numbers differ over all
    tasks of a job."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 33
    held, size, n = [], 0, 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        cut = 0
        for i, length in enumerate(lengths.tolist()):
            size += length
            if size >= chars:
                held.append(batch.slice(cut, i + 1 - cut))
                yield first + n, pa.Table.from_batches(held).combine_chunks()
                held, size, n, cut = [], 0, n + 1, i + 1
        if cut < len(lengths):
            held.append(batch.slice(cut))
    if held:
        yield first + n, pa.Table.from_batches(held).combine_chunks()


#: Bytes of weights in a row of ``weight_rows``.
PART = 1 << 16
WEIGHTS = "part int, shard int, weights binary"


def weight_rows(shard: int, flat: np.ndarray) -> pa.RecordBatch:
    """The weights of a shard's model (float32), as rows of WEIGHTS."""
    raw = flat.tobytes()
    parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
    return pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()), "weights": pa.array(parts, pa.binary())})


def _mean(table: pa.Table) -> pa.Table:
    each = [np.frombuffer(w, np.float32) for w in table.sort_by("shard").column("weights").to_pylist()]
    return pa.table({"part": table.column("part").slice(0, 1), "weights": pa.array([np.mean(each, axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary())})


def averaged(weights: DataFrame) -> np.ndarray | None:
    """The mean over the shards of WEIGHTS, taken part by part in Spark; None without shards."""
    parts = weights.groupBy("part").applyInArrow(_mean, "part int, weights binary").collect()
    return np.frombuffer(b"".join(r["weights"] for r in sorted(parts, key=lambda r: r["part"])), np.float32) if parts else None


def only_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def split_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts after ``bytes.translate(table)``, cut at ASCII white space: (word numbers in order, text of each word, distinct words)."""
    plain = pa.array([x.as_buffer().to_pybytes().translate(table) if x.is_valid else b"" for x in texts.cast(pa.binary())], pa.binary())
    parts = pc.ascii_split_whitespace(plain.cast(pa.string()))
    words = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))
    full = np.asarray(pc.binary_length(words)) > 0
    coded = words.dictionary_encode()
    number = np.asarray(coded.indices)[full]
    used = np.bincount(number, minlength=len(coded.dictionary)) > 0
    return (np.cumsum(used) - 1)[number], owner[full], coded.dictionary.take(pa.array(np.flatnonzero(used)))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in few bytes; ``unpacked`` reads them."""
    raw = b"".join(np.array([len(a)], "<i8").tobytes() + np.diff(a, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<i8")))
        at += 8 + 8 * n
    return out


def block_values(blocks: DataFrame, keys: str, values: DataFrame, key: str) -> DataFrame:
    """(block, found): for the keys of each block, in an array of (pos, the other columns of ``values``), in any order; null where ``values`` has no such key.

    A key comes once in a block whatever number of times its rows hold it, so no key is frequent here; a block's array is as long as its keys.
    """
    each = blocks.select("block", F.posexplode(keys).alias("pos", key)).join(values, key, "left")
    return each.groupBy("block").agg(F.collect_list(F.struct("pos", *[c for c in values.columns if c != key])).alias("found"))
