"""Exact top-k search over an impact-ordered index, score at a time.

A vector's components are integers, and its postings (dimension, vector) are quantised by impact: level l holds
those with 2^l <= |value| < 2^(l+1). Vectors are packed into blocks; a block's index is its postings cut into segments of one level and
one dimension, the highest level first. A block of queries processes the segments in this order and adds to the scores; what is left of a
vector can add at most |query| times the length of what is left (Cauchy-Schwarz, kept up to date segment by segment). After each level
vectors that no query of the block can want are taken out of the later segments, and queries that want none are done. Processing stops only
when fewer candidates than a few times k can still be among the best of their query (or no segment is left), and all that can be
are rescored exactly on whole integer vectors. Ties go to the smaller id.

A task goes through its blocks one after the other and keeps the best of each query so far: a later block is skipped whole for
queries for which the extremes of its dimensions prove that it holds nothing better, and starts from the others' k-th best score.

Every row is indexed, and every query meets every block. Queries go out in rounds of at most ROUND_BYTES, by a broadcast of that
size; a round reads the index where it lies, without a shuffle, and each task returns k rows a query.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; neither do rows with
a null id; a query's own row is every row with its id; of repeated ids each different vector is a query and a candidate
of its own, equal rows count once; vectors meet only those of their own length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, bounded_batches, load

SCALE, TOP, EVERY = 256, 5, 50
INDEX_BLOCK, QUERY_BLOCK, ROUND_BYTES = 2048, 256, 16 << 20
#: Integer products up to this are exact in doubles.
_EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): whole-number components floor(SCALE * x), without the vectors that take no part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    ok &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))
    return rows.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))


@dataclass
class Block:
    """Vectors of one length with their postings: segment i holds the vectors ``vec[start[i] : start[i + 1]]`` of one level and dimension."""

    ids: np.ndarray
    m: np.ndarray
    vec: np.ndarray
    level: np.ndarray
    dim: np.ndarray
    start: np.ndarray


def indexed(ids: np.ndarray, m: np.ndarray) -> Block:
    row, dim = np.nonzero(m)
    level = np.frexp(np.abs(m[row, dim]))[1].astype(np.int64) - 1
    order = np.lexsort((row, dim, -level))
    row, dim, level = row[order], dim[order], level[order]
    first = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])]) if len(row) else np.zeros(0, np.int64)
    return Block(ids, m, row.astype(np.int32), level[first].astype(np.int32), dim[first].astype(np.int32), np.r_[first, len(row)].astype(np.int32))


INDEX = "dim int, ids binary, m binary, vec binary, level binary, seg binary, start binary"


def _pack(size: int, postings: bool):
    """Blocks of up to ``size`` vectors of one length, in the order in which a task meets them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def packed(dim: int) -> pd.DataFrame:
            ids, rows = held.pop(dim)
            b = indexed(np.array(ids, np.int64), np.array(rows, np.float64))
            parts = [b.ids, b.m, b.vec, b.level, b.dim, b.start] if postings else [b.ids, b.m]
            return pd.DataFrame([[dim, *(x.tobytes() for x in parts), *[None] * (6 - len(parts))]], columns=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for i, v, dim in zip(batch["id"], batch["v"], batch["dim"], strict=True):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == max(1, min(size, (4 << 20) // dim)):
                    yield packed(dim)
                # many lengths at once are rare; the blocks under way stay within a bound all the same
                elif len(held) > 64:
                    yield packed(next(iter(held)))
        for dim in list(held):
            yield packed(dim)

    return run


class Best:
    """The k best of each query so far: scores falling, ties by rising ids; empty places have the score -inf."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score, ids = np.r_[self.score[i], score], np.r_[self.id[i], ids]
        order = np.lexsort((ids, -score))[:k]
        self.score[i], self.id[i] = score[order], ids[order]


def search_block(q: np.ndarray, qid: np.ndarray, block: Block, best: Best, work: list[int] | None = None) -> None:
    """Put what one block has for a block of queries into ``best``; ``work`` counts postings times queries that were processed."""
    k = best.score.shape[1]
    bound = np.maximum(q, 0) @ np.maximum(block.m.max(0), 0) + np.minimum(q, 0) @ np.minimum(block.m.min(0), 0)
    rows = np.flatnonzero(bound * (1 + np.sign(bound) * 1e-12) >= best.score[:, -1])
    if not len(rows):
        return
    q, theta = q[rows], best.score[rows, -1]
    own = block.ids[:, None] == qid[rows][None, :]
    length = np.sqrt((q**2).sum(1))
    n = len(block.ids)
    score, left = np.zeros((n, len(rows))), (block.m**2).sum(1)
    possible, alive = ~own, np.ones(n, bool)
    ends = np.flatnonzero(np.r_[block.level[1:] != block.level[:-1], True]) if len(block.level) else []
    at, columns = 0, np.arange(len(rows))
    for end in ends:
        for s in range(at, end + 1):
            vec = block.vec[block.start[s] : block.start[s + 1]]
            vec = vec[alive[vec]]
            if len(vec):
                d = block.dim[s]
                value = block.m[vec, d]
                score[vec] += value[:, None] * q[columns, d][None, :]
                left[vec] -= value**2
                if work is not None:
                    work[0] += len(vec) * len(columns)
        at = end + 1
        slack = np.sqrt(np.maximum(left, 0) * (1 + 1e-9))[:, None] * (length[columns] * (1 + 1e-9))[None, :]
        mine = own[:, columns]
        kth = theta[columns]
        if n >= k:
            low = np.where(mine | ~alive[:, None], -np.inf, score - slack)
            kth = np.maximum(kth, np.partition(low, n - k, axis=0)[n - k])
        now = (score + slack >= kth[None, :]) & ~mine & alive[:, None]
        possible[:, columns] = now
        if now.sum() <= 4 * k * len(columns):
            break
        alive &= now.any(axis=1)
        keep = now.any(axis=0)
        if keep.sum() < 0.75 * len(columns):
            possible[:, columns[~keep]] = False
            score, columns = np.ascontiguousarray(score[:, keep]), columns[keep]
    for i in np.flatnonzero(possible.any(axis=0)):
        j = np.flatnonzero(possible[:, i])
        best.add(rows[i], block.m[j] @ q[i], block.ids[j])


def search_plain(q: np.ndarray, qid: np.ndarray, block: Block, best: dict[int, list[tuple[int, int]]], k: int) -> None:
    """The same where products leave the whole numbers that doubles hold: in Python's integers."""
    whole = [[int(c) for c in v] for v in block.m]
    for i, v in enumerate(q):
        own = [int(c) for c in v]
        got = [(-sum(a * b for a, b in zip(own, x, strict=True)), int(c)) for x, c in zip(whole, block.ids, strict=True) if c != qid[i]]
        best[i] = sorted(best.get(i, []) + got)[:k]


def _search(asked, k: int):
    """``asked`` holds the round's query blocks: (dim, first number, ids, matrix)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [(dim, first, np.frombuffer(ids, np.int64), np.frombuffer(m, np.float64).reshape(-1, dim)) for dim, first, ids, m in asked.value]
        found = [Best(len(ids), k) for _, _, ids, _ in queries]
        large: list[dict] = [{} for _ in queries]
        for batch in batches:
            for r in batch.itertuples():
                dim = int(r.dim)
                vec, level, seg, start = (np.frombuffer(x, np.int32) for x in (r.vec, r.level, r.seg, r.start))
                block = Block(np.frombuffer(r.ids, np.int64), np.frombuffer(r.m, np.float64).reshape(-1, dim), vec, level, seg, start)
                most = np.abs(block.m).max(initial=0.0)
                for (d, _, qid, q), best, more in zip(queries, found, large, strict=True):
                    if d != dim:
                        continue
                    if most * np.abs(q).max(initial=0.0) * dim >= _EXACT or most**2 * dim >= _EXACT:
                        search_plain(q, qid, block, more, k)
                    else:
                        search_block(q, qid, block, best)
        for (dim, first, qid, _), best, more in zip(queries, found, large, strict=True):
            i, j = np.nonzero(np.isfinite(best.score))
            rows = [(dim, first + int(a), int(qid[a]), int(best.id[a, b]), int(best.score[a, b])) for a, b in zip(i, j, strict=True)]
            rows += [(dim, first + a, int(qid[a]), c, -s) for a, pairs in more.items() for s, c in pairs]
            if rows:
                yield pd.DataFrame(rows, columns=["dim", "query", "query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with ``vectors(id, v, dim)``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    index = scratch.keep(vectors.mapInPandas(_pack(INDEX_BLOCK, True), INDEX))
    packed = queries.mapInPandas(_pack(QUERY_BLOCK, False), INDEX).select("dim", "ids", "m", (F.length("ids") / 8).cast("long").alias("n"))
    packed = scratch.keep(packed.withColumn("number", F.monotonically_increasing_id()))
    # rounds: consecutive query blocks of at most ROUND_BYTES, or one
    sizes = [(r["number"], r["n"], r["bytes"]) for r in packed.select("number", "n", F.length("m").alias("bytes")).orderBy("number").toLocalIterator()]
    rounds: list[list[int]] = []
    first, held, at = {}, ROUND_BYTES + 1, 0
    for number, n, size in sizes:
        if held + size > ROUND_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(number)
        held += size
        first[number], at = at, at + n
    found = []
    for numbers in rounds:
        blocks = packed.where(F.col("number").between(numbers[0], numbers[-1])).collect()
        asked = spark.sparkContext.broadcast([(r["dim"], first[r["number"]], bytes(r["ids"]), bytes(r["m"])) for r in blocks])
        found.append(scratch.keep(index.mapInPandas(_search(asked, k), "dim int, query long, query_id long, vec_id long, score long")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, found).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_topk(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
