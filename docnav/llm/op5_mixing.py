"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are numbered; slot j has the point frac(j / golden ratio), and the cumulative weights map points to sources. Within a
source the slots are ranked, the documents are shuffled (by a hash) and laid end to end, again and again, and cut into blocks of equal numbers of words, as many
as the source has slots: the slot of rank r takes block r (`schedule`). The blocks end where the source's target does, so a source's slots hold its target to
the word, whatever their number; a source without a point has one slot behind all others. A document's words are taken as often as slots hold them: slots and
documents meet by the stretches of the sequence that they lie on, in pieces no longer than a block (`mix_sources`).

Sizes are words ``[^\\x20\\x09-\\x0D]+``. Targets share the total by weight, stop at MOST times a source's size, and the
excess goes to the others by weight. Each source's taken words are its target, rounded to whole words.

Defined results: null text has size 0; the null source is a source of its own, ordered last; documents of size 0 take
0; repeated rows are documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, load

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a slot, about, at most, and slots, about, at least, unless their number is given.
BLOCK, SLOTS = 512, 1 << 17
_BUCKETS, _CHUNK, _CELLS = 256, 1 << 14, 1024
_GOLDEN, _HIGH = 0.6180339887498949, 1 << 20


def words(column: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target, lo, hi) from (source, source_size): one row per source, so one task is enough."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    up_to = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
    t = t.withColumn("share", F.col("left") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0))))
    # in this order a source is capped exactly as long as its cap lies under its share of what is left
    first_free = F.min(F.when(F.col("cap") > F.col("share") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("share").alias("share")))).over(everything)
    t = t.withColumn("rate", first_free["share"])
    t = t.withColumn("target", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("w"))))
    ends = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("hi", F.sum("target").over(ends) / F.sum("target").over(everything))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    return t.select("source", "source_size", "target", "lo", "hi")


def wanted() -> F.Column:
    return F.floor(F.col("target") + 0.5).cast("long")


def block_words(total: int) -> int:
    """Words in a slot, about."""
    return max(1, min(BLOCK, -(-total // SLOTS)))


def schedule(plan: DataFrame, slots: int | None = None) -> DataFrame:
    """(source, slot, first, after): the stretch of a source's sequence of documents that each slot holds. Slots are ranked within
    their sources by chunks of slots so that no source's slots meet in one task."""
    spark = plan.sparkSession
    if slots is None:
        total = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        slots = -(-total // block_words(total))
    # in two parts, so that the product keeps its digits whatever the slot's number
    point = f"((id div {_HIGH}) * {_GOLDEN * _HIGH % 1}D + (id % {_HIGH}) * {_GOLDEN}D) % 1.0D"
    j = spark.range(slots).select(F.col("id").alias("slot"), F.expr(point).alias("point"))
    j = j.withColumn("cell", F.floor(F.col("point") * _CELLS))
    cells = plan.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.floor(F.col("hi") * _CELLS))).alias("cell"))
    # the last end may fall short of 1 by rounding
    cells = cells.withColumn("hi", F.when(F.col("hi") > 1 - 1e-12, 2.0).otherwise(F.col("hi")))
    got = j.join(cells, "cell").where("point >= lo and point < hi").select("source", "slot", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    per = got.groupBy("source", "chunk").count()
    base = per.select("source", "chunk", (F.sum("count").over(Window.partitionBy("source").orderBy("chunk")) - F.col("count")).alias("base"))
    local = got.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    both = (local["source"].eqNullSafe(base["source"])) & (local["chunk"] == base["chunk"])
    ranked = local.join(base, both).select(local["source"], "slot", (F.col("base") + F.col("r")).alias("rank"))
    counts = per.groupBy(F.col("source").alias("cs")).agg(F.sum("count").alias("n"))
    known = plan.select(F.col("source").alias("ps"), wanted().alias("words")).join(counts, F.col("ps").eqNullSafe(F.col("cs")), "left")
    late = known.where("n is null and words > 0").select(F.col("ps").alias("source"), (F.row_number().over(Window.orderBy(F.col("ps").asc_nulls_last())) + (slots - 1)).alias("slot"), F.lit(0).cast("long").alias("first"), F.col("words").alias("after"))
    at = [F.floor(F.col("words") * ((F.col("rank") + i) / F.col("n"))).alias(name) for i, name in enumerate(("first", "after"))]
    return ranked.join(known, F.col("source").eqNullSafe(F.col("ps"))).select("source", "slot", *at).union(late)


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, keys: tuple = ("doc_id",)) -> DataFrame:
    """(*keys, source, size, source_size, target, taken) of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.keep(docs.select(*keys, F.col("source").cast("string").alias("source"), words().alias("size"), F.xxhash64(*[F.col(k) for k in keys], F.lit(7)).alias("u"), F.xxhash64("text").alias("v")))
    plan = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    # each document's place in its source's shuffled sequence: totals of hash buckets first, then places within buckets
    sized = sized.withColumn("bucket", F.pmod("u", F.lit(_BUCKETS)))
    per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = per.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("u", "v", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("size").over(inside)).join(base, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
    placed = placed.select(*keys, "source", "size", (F.col("base") + F.col("end") - F.col("size")).alias("start"), (F.col("base") + F.col("end")).alias("end"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    known = scratch.keep(plan.select(F.col("source").alias("ps"), sid.alias("sid"), "source_size", "target"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    block = block_words(known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # a slot's stretch of the endless sequence lies on one pass over the documents or on the ends of two and passes between; both sides are cut into cells
    slots = schedule(plan).join(known, F.col("source").eqNullSafe(F.col("ps"))).where("after > first")
    slots = slots.select("sid", "source_size", "first", "after", F.explode(F.expr("sequence(first div source_size, (after - 1) div source_size)")).alias("turn"))
    slots = slots.select("sid", F.expr("greatest(first - turn * source_size, 0)").alias("a"), F.expr("least(after - turn * source_size, source_size)").alias("b"))
    slots = slots.select("sid", "a", "b", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("cell"))
    columns = [*keys, "source", "size", "source_size", "target", "start"]
    cells = placed.select("sid", *columns, "end", F.explode(F.expr(f"case when size > 0 then sequence(start div {block}, (end - 1) div {block}) else array(-1L) end")).alias("cell"))
    held = F.expr(f"case when a is not null then greatest(least(b, end, (cell + 1) * {block}) - greatest(a, start, cell * {block}), 0) end")
    return cells.join(slots, ["sid", "cell"], "left").groupBy(*columns).agg(F.coalesce(F.sum(held), F.lit(0)).cast("long").alias("taken")).drop("start")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
