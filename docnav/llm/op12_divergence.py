"""Source divergence audit: how far the sources of a language differ in their words, by sorted streams and run-length scans.

Entries (lang, term, source, document, docs, n) are counted within blocks of rows before the shuffle; ``document`` is the number of the block that they
come from, so an entry stands for ``docs`` documents of it with ``n`` occurrences. They are dealt by (lang, term) and sorted by (lang, term, source,
document): one scan over the runs adds them up and keeps the terms that are in LEAST documents of their language. A term is in an entry of a block and source
at most once, so a frequent word is no larger a share of the entries than a rare one that every block holds.

The kept runs are dealt by (lang, cell of the term) and sorted again, each cell behind the language's sources and sums. A second scan emits partial sums for the pairs
of sources of each run and the best terms of each source. Pairs without a term in common are not enumerated: with f(p, q) for a term, p0 and q0 for count 0,

    sum f(p, q) = V f(p0, q0) + sum over p's terms of f(p, q0) - f(p0, q0) + sum over q's terms of f(p0, q) - f(p0, q0)
                  + sum over the terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

and the two sums in the middle need each count of a source once. All numbers are whole: f fits in 63 bits, and shares are divided digit by digit.

Defined results: null text, lang and source are ''; each row is a document of its own, so repeated rows count; texts without terms still make their group
known; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, bounded_batches, in_blocks, load, only_chunk, split_words

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text counted at once, entries held until they are emitted, rows of a cell of terms, and pairs expanded at once.
BLOCK, MOST_ENTRIES, CELL, EXPANDED = 4 << 20, 1 << 20, 200_000, 1 << 19
#: Letters and whatever is beyond ASCII stay, A-Z become small, all else parts words.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

ENTRIES = "lang string, term string, source string, document long, docs long, n long"
KEPT = "lang string, term string, source string, n long, first int"
PARTIAL = "lang string, source string, part string, item string, value long"
_KEYS = ["lang", "term", "source"]


def _entries(block: pa.Table) -> pa.Table:
    """(lang, term, source, docs, n) of a block; each of its sources also has an entry without a term."""
    number, doc, words = split_words(only_chunk(block.column("text")), TABLE)
    where = pa.table({"lang": block.column("lang"), "source": block.column("source")})
    groups = where.group_by(["lang", "source"]).aggregate([])
    keyed = where.append_column("row", pa.array(np.arange(len(where)))).join(groups.append_column("group", pa.array(np.arange(len(groups)))), ["lang", "source"])
    group_of = np.empty(len(where), np.int64)
    group_of[np.asarray(keyed["row"])] = np.asarray(keyed["group"])
    width = max(1, len(words))
    held, times = np.unique(doc * width + number, return_counts=True)
    code, place = np.unique(group_of[held // width] * width + held % width, return_inverse=True)
    n = np.zeros(len(code), np.int64)
    np.add.at(n, place, times)
    docs, group = np.bincount(place, minlength=len(code)), pa.array(code // width)
    terms = pa.table({"lang": groups["lang"].take(group), "term": words.take(pa.array(code % width)), "source": groups["source"].take(group), "docs": pa.array(docs, pa.int64()), "n": pa.array(n)})
    zero = pa.array(np.zeros(len(groups), np.int64))
    return pa.concat_tables([pa.table({"lang": groups["lang"], "term": pa.array([""] * len(groups), pa.string()), "source": groups["source"], "docs": zero, "n": zero}), terms])


def _merged(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    got = pa.concat_tables(parts).group_by(_KEYS).aggregate([("docs", "sum"), ("n", "sum")])
    return got.select([*_KEYS, "docs_sum", "n_sum"]).rename_columns([*_KEYS, "docs", "n"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, rows, at = [], 0, 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        document = pa.array(np.full(len(table), at, np.int64))
        yield from table.add_column(3, "document", document).combine_chunks().to_batches(max_chunksize=1 << 14)

    for at, block in in_blocks(batches, BLOCK):
        parts.append(_entries(block))
        rows += len(parts[-1])
        if rows > MOST_ENTRIES:
            parts = [_merged(parts)]
            rows = len(parts[0])
            if rows > MOST_ENTRIES // 2:
                yield from out(parts[0])
                parts, rows = [], 0
    if parts:
        yield from out(_merged(parts))


def starts(*columns: pa.Array) -> np.ndarray:
    """Where runs of rows equal in all columns begin."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)).cast(pa.uint8())).astype(bool) if n > 1 else False
    return np.flatnonzero(np.append(True, new)) if n else np.zeros(0, np.int64)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches cut anew into tables of about ``rows`` rows that end where a run of ``keys`` does."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(starts(*[only_chunk(table.column(k)) for k in keys])[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def keep_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of entries sorted by (lang, term, source, document): (lang, term, source, n) of the kept terms, ``first`` once a term. A term's sums
    are held by source, never its entries."""
    open_key, open_rows = None, []

    def close(rows: list[tuple[str, int, int]], key: tuple[str, str]) -> pa.RecordBatch | None:
        if key[1] and sum(r[1] for r in rows) < LEAST:
            return None
        n = len(rows)
        return pa.RecordBatch.from_pydict({"lang": [key[0]] * n, "term": [key[1]] * n, "source": [r[0] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64()), "first": pa.array([int(bool(key[1]))] + [0] * (n - 1), pa.int32())})

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, term, source = (batch.column(k) for k in _KEYS)
        runs = starts(lang, term, source)
        docs, n = (np.add.reduceat(np.asarray(batch.column(k)), runs) for k in ("docs", "n"))
        at = pa.array(runs)
        lang, term, source = lang.take(at), term.take(at), source.take(at)
        terms = starts(lang, term)
        ends = np.append(terms[1:], len(runs))
        # the first term may go on from the batch before, the last may go on in the next one
        whole = np.ones(len(terms), bool)
        for k in sorted({0, len(terms) - 1}):
            i, j = int(terms[k]), int(ends[k])
            key, rows = (lang[i].as_py(), term[i].as_py()), list(zip(source.slice(i, j - i).to_pylist(), docs[i:j].tolist(), n[i:j].tolist(), strict=True))
            whole[k] = False
            if key == open_key:
                if open_rows[-1][0] == rows[0][0]:
                    s, d, m = open_rows.pop()
                    rows[0] = (s, d + rows[0][1], m + rows[0][2])
                open_rows += rows
            else:
                if open_key and (done := close(open_rows, open_key)):
                    yield done
                open_key, open_rows = key, rows
        df = np.add.reduceat(docs, terms)
        good = whole & ((df >= LEAST) | (np.asarray(pc.binary_length(term.take(pa.array(terms)))) == 0))
        rows = np.flatnonzero(np.repeat(good, ends - terms))
        if len(rows):
            first = np.zeros(len(runs), np.int32)
            first[terms] = np.asarray(pc.binary_length(term.take(pa.array(terms)))) > 0
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([lang.take(take), term.take(take), source.take(take), pa.array(n[rows]), pa.array(first[rows])], ["lang", "term", "source", "n", "first"])
    if open_key and (done := close(open_rows, open_key)):
        yield done


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) without leaving 63 bits, for count <= total < 9e15."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Cell:
    """Terms of one cell of a language: sums of pairs of sources, and the best terms of each source."""

    def __init__(self, sources: list[str], n: np.ndarray, v: int, first: bool):
        self.sources, self.values, self.total, self.v, self.s = sources, pa.array(sources, pa.string()), int(n.sum()), v, len(sources)
        self.n = n
        self.zero = share(np.ones(self.s, np.int64), n + v) if v else np.ones(self.s, np.int64)
        self.keys, self.sums, self.held = [], [], 0
        self.best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        if first:  # the terms that neither of a pair has, as if that were all of them
            for i in range(self.s):
                other = np.delete(np.arange(self.s), i)
                self._add(i * self.s + other, v * gap(self.zero[i], self.zero[other]))

    def _add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        unique, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, place, sums)
        self.keys.append(unique)
        self.sums.append(total)
        self.held += len(unique)

    def pairs(self, most: int) -> Iterator[pa.RecordBatch]:
        """What is summed up, if it is more than ``most`` rows even when merged."""
        if self.held > most:
            keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
            self.keys, self.sums, self.held = [], [], 0
            self._add(keys, sums)
            if self.held > most // 2:
                yield from self._rows(self.keys[0] // self.s, "pair", self.values.take(pa.array(self.keys[0] % self.s)), self.sums[0])
                self.keys, self.sums, self.held = [], [], 0

    def _rows(self, source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.table({"source": self.values.take(pa.array(source)), "part": pa.array([part] * len(value), pa.string()), "item": item, "value": pa.array(value, pa.int64())})
        yield from table.combine_chunks().to_batches(max_chunksize=1 << 14)

    def add(self, term: pa.Array, source: pa.Array, n: np.ndarray) -> None:
        """Whole runs, in the order of terms."""
        src = np.asarray(pc.index_in(source, self.values), np.int64)
        runs = starts(term)
        length = np.diff(np.append(runs, len(src)))
        p = share(n + 1, self.n[src] + self.v)
        q = share(np.repeat(np.add.reduceat(n, runs), length) + 1, self.total + self.v)
        high = np.flatnonzero(p > q)
        self._keep_best(src[high], gap(p[high], q[high]), term.take(pa.array(high)))
        self._both(src, p, runs, length)
        self._one(src, n)

    def _both(self, src: np.ndarray, p: np.ndarray, runs: np.ndarray, length: np.ndarray) -> None:
        k = np.repeat(length, length)
        base = np.repeat(runs, length)
        cut = np.searchsorted(np.cumsum(k), np.arange(EXPANDED, int(k.sum()) + EXPANDED, EXPANDED))
        for rows in np.split(np.arange(len(src)), np.unique(np.minimum(cut + 1, len(src)))):
            left = np.repeat(rows, k[rows])
            right = np.arange(len(left)) - np.repeat(np.cumsum(k[rows]) - k[rows], k[rows]) + np.repeat(base[rows], k[rows])
            left, right = left[left != right], right[left != right]
            a, b = src[left], src[right]
            self._add(a * self.s + b, gap(p[left], p[right]) - gap(p[left], self.zero[b]) - gap(self.zero[a], p[right]) + gap(self.zero[a], self.zero[b]))

    def _one(self, src: np.ndarray, n: np.ndarray) -> None:
        counts = np.unique(np.stack([src, n], 1), axis=0, return_counts=True) if len(src) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        step = max(1, EXPANDED // self.s)
        for at in range(0, len(counts[1]), step):
            (a, c), many = counts[0][at : at + step].T, counts[1][at : at + step]
            p = np.repeat(share(c + 1, self.n[a] + self.v), self.s)
            a, many, b = np.repeat(a, self.s), np.repeat(many, self.s), np.tile(np.arange(self.s), len(c))
            a, b, p, many = (x[a != b] for x in (a, b, p, many))
            self._add(a * self.s + b, many * (gap(p, self.zero[b]) - gap(self.zero[a], self.zero[b])))
            self._add(b * self.s + a, many * (gap(self.zero[b], p) - gap(self.zero[b], self.zero[a])))

    def _keep_best(self, src: np.ndarray, value: np.ndarray, term: pa.Array, most: int = 1 << 17) -> None:
        self.best.append((src, value, term))
        if sum(len(b[0]) for b in self.best) > max(most, 2 * TOP * self.s):
            self.best = [self._top()]

    def _top(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        src, value, term = np.concatenate([b[0] for b in self.best]), np.concatenate([b[1] for b in self.best]), pa.concat_arrays([b[2] for b in self.best])
        order = np.lexsort((-value, src))  # stable: terms of equal values stay in their order
        rank = np.arange(len(order)) - np.searchsorted(src[order], src[order])
        order = np.sort(order[rank < TOP])
        return src[order], value[order], term.take(pa.array(order))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield from self._rows(np.concatenate(self.keys) // self.s, "pair", self.values.take(pa.array(np.concatenate(self.keys) % self.s)), np.concatenate(self.sums))
        if self.best:
            src, value, term = self._top()
            yield from self._rows(src, "term", term, value)


def scan_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by (lang, cell, kind, term, source): a cell's sources (kind 0, with their sums) come before its terms."""
    cell, now, known = None, None, []

    def said(lang: str, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), *b.columns], ["lang", *b.schema.names])

    def opened() -> Cell:
        return Cell([k[0] for k in known], np.array([k[1] for k in known], np.int64), known[0][2], now[1] == 0)

    for table in sorted_runs(batches, ["lang", "cell", "kind", "term"], CELL // 4):
        names = ("lang", "cell", "kind", "term", "source", "n", "v")
        lang, at, kind, term, source, n, v = (only_chunk(table.column(k)) for k in names)
        cuts = starts(lang, at, kind)
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lang)], strict=True):
            key = (lang[i].as_py(), at[i].as_py())
            if key != now:
                if now:
                    yield from said(now[0], (cell or opened()).finish())
                cell, now, known = None, key, []
            if kind[i].as_py() == 0:
                known += zip(source.slice(i, j - i).to_pylist(), n.slice(i, j - i).to_pylist(), v.slice(i, j - i).to_pylist(), strict=True)
                continue
            cell = cell or opened()
            cell.add(term.slice(i, j - i), source.slice(i, j - i), np.asarray(n.slice(i, j - i)))
            yield from said(now[0], cell.pairs(1 << 20))
    if now:
        yield from said(now[0], (cell or opened()).finish())


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    entries = plain.mapInArrow(count_terms, ENTRIES)
    dealt = entries.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    kept = scratch.keep(dealt.mapInArrow(keep_runs, KEPT))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"), F.count("*").alias("rows"))
    langs = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("rows").alias("rows"))
    groups = scratch.keep(groups.drop("v", "rows").join(langs, "lang"))
    # each language's sources come before every cell of its terms; a cell has about CELL rows
    cells = (1 + F.col("rows") / CELL).cast("long")
    head = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), F.lit(0).alias("kind"), F.lit("").alias("term"), "source", "n", "v")
    per_lang = groups.select("lang", cells.alias("cells")).distinct()
    body = kept.where("term <> ''").join(per_lang, "lang")
    body = body.select("lang", F.pmod(F.xxhash64("term"), "cells").alias("cell"), F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("long").alias("v"))
    rows = head.union(body).repartition("lang", "cell").sortWithinPartitions("lang", "cell", "kind", "term", "source")
    found = scratch.keep(rows.mapInArrow(scan_cells, PARTIAL))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH plain AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM plain),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(s.v, 0)::HUGEINT AS v, coalesce(s.total, 0)::HUGEINT AS lang_total, coalesce(c.n, 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM plain) g LEFT JOIN sizes s ON s.lang = g.lang
    LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS n FROM counts c JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source),
shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v))::BIGINT AS q
    FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b
        ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms)
WHERE part = 'pair' OR rank <= 200
"""
