"""Points in ranges by equal keys: which ranges hold which pages.

A range is cut into pieces of a tree with FAN children a node, as a segment tree does: at most 2 (FAN - 1) pieces of each length 1, FAN, FAN^2, ...; a page lies in
one node of each length. So a range and a page that it holds meet under exactly one key, whatever the range's length: rows are as many as pages times the tree's height
and pieces, never as many as a range is long, and one document's keys are spread over tasks. Ranges are cut to the pages that their document has before that, and
reversed ones hold nothing.

How often pages are covered is a running sum over the ends of ranges, so only stretches with something to tell are written out page by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_BITS, LEVELS = 4, 8
FAN = 1 << FAN_BITS
#: Rows that a task sorts, about, where a query deals its rows by their number.
TASK_ROWS = 250_000


def _free(stem: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def tasks_for(rows: DataFrame) -> int:
    """Tasks of about TASK_ROWS each, and no fewer than there are cores; counts ``rows``, so they should be cheap (a table)."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def pieces(first: Column, after: Column) -> Column:
    """The nodes (level, node) that make up the numbers from ``first`` to before ``after``, both within FAN ** LEVELS."""
    kind = "array<struct<level: int, node: bigint>>"
    none = F.array().cast(kind)

    def nodes(level: Column, a: Column, b: Column) -> Column:
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda n: F.struct(level.alias("level"), n.alias("node")))).otherwise(none)

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        up_a, up_b = F.shiftright(a + (FAN - 1), FAN_BITS), F.shiftright(b, FAN_BITS)
        last = (up_a >= up_b) | (level == LEVELS - 1)
        own = F.when(last, nodes(level, a, b)).otherwise(F.concat(nodes(level, a, F.shiftleft(up_a, FAN_BITS)), nodes(level, F.shiftleft(up_b, FAN_BITS), b)))
        zero = F.lit(0).cast("long")
        return F.struct(F.when(last, zero).otherwise(up_a).alias("a"), F.when(last, zero).otherwise(up_b).alias("b"), F.concat(acc["out"], own).alias("out"))

    start = F.struct(first.cast("long").alias("a"), after.cast("long").alias("b"), none.alias("out"))
    # numbers below FAN have no nodes but themselves
    short = nodes(F.lit(0), first.cast("long"), after.cast("long"))
    return F.when((first >= 0) & (after < FAN), short).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda acc: acc["out"]))


def pages_in(ranges: DataFrame, pages: DataFrame, by: str = "corpus_id", parts: int | None = None) -> DataFrame:
    """Each row of ``ranges(by, start_page, end_page, ...)`` with each row of ``pages(by, page, ...)`` in its range; the tables share no other column. Rows are dealt
    to ``parts`` tasks (``tasks_for``), so that what a task sorts does not grow with the tables, or to as many as the session's shuffles have."""
    lo, hi, level, node = (_free(x, ranges, pages) for x in ("lo", "hi", "level", "node"))

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, *keys) if parts else df

    pages = dealt(pages, by)
    extent = pages.groupBy(by).agg(F.min("page").cast("long").alias(lo), F.max("page").cast("long").alias(hi))
    first, after = F.greatest(F.col("start_page").cast("long"), F.col(lo)) - F.col(lo), F.least(F.col("end_page").cast("long"), F.col(hi)) + 1 - F.col(lo)
    cut = dealt(ranges.where("start_page <= end_page"), by).join(extent, by).where(first < after)
    cut = cut.select(*ranges.columns, F.explode(pieces(first, after)).alias(node)).select(*ranges.columns, F.col(f"{node}.level").alias(level), F.col(f"{node}.node").alias(node))
    height = F.least(F.lit(LEVELS - 1), F.expr(f"(length(bin({hi} - {lo} + 1)) - 1) div {FAN_BITS}").cast("int"))
    points = pages.join(extent, by).select(*pages.columns, lo, F.explode(F.sequence(F.lit(0), height)).alias(level))
    points = points.select(*pages.columns, level, F.expr(f"shiftright(page - {lo}, {level} * {FAN_BITS})").cast("long").alias(node))
    key = [by, level, node]
    return dealt(cut, *key).join(dealt(points, *key), key).drop(level, node)


def coverage(ranges: DataFrame, sizes: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, first, last, times): stretches of pages that are covered equally often by ``ranges(by, start_page, end_page)``, those within ``sizes(by, n_pages)`` also
    if nothing covers them (``inside`` tells them from others)."""
    end = lambda at, times, inside: F.struct(at.cast("long").alias("at"), F.lit(times).alias("times"), F.lit(inside).alias("inside"))
    own = ranges.where("start_page <= end_page").select(by, F.explode(F.array(end(F.col("start_page"), 1, 0), end(F.col("end_page").cast("long") + 1, -1, 0))).alias("e"))
    whole = sizes.where("n_pages > 0").select(by, F.explode(F.array(end(F.lit(1), 0, 1), end(F.col("n_pages").cast("long") + 1, 0, -1))).alias("e"))
    ends = own.union(whole).select(by, "e.*").groupBy(by, "at").agg(F.sum("times").alias("times"), F.sum("inside").alias("inside"))
    order = Window.partitionBy(by).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = ends.select(by, F.col("at").alias("first"), (F.lead("at").over(order) - 1).alias("last"), F.sum("times").over(so_far).alias("times"), (F.sum("inside").over(so_far) > 0).alias("inside"))
    return runs.where("last is not null and (inside or times > 0)")
