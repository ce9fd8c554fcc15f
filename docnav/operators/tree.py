"""Section trees as adjacency tables: validation, repair, numbering and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from docnav.operators.intervals import coverage, pages_in
from docnav.operators.lineage import cut

# Fixed value: the title of pages that no section holds.
GAP_TITLE = ("Pages ", " (unassigned by LLM)")


def validate(sections: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, kind, detail) of each problem. ``sections(doc_id, ord, parent_ord, start_page, end_page)``, ``sizes(doc_id, n_pages)``.

    A section outside the document or reversed is a bad range, and still counts for the coverage of pages; leaves must cover each page once.
    """
    s = sections.join(sizes, "doc_id")
    bad = s.where("start_page < 1 or end_page > n_pages or start_page > end_page").select("doc_id", F.lit("bad_range").alias("kind"), F.col("ord").alias("detail"))
    parent = sections.select("doc_id", F.col("ord").alias("parent_ord"), F.col("start_page").alias("ps"), F.col("end_page").alias("pe"))
    escapes = s.join(parent, ["doc_id", "parent_ord"]).where("start_page < ps or end_page > pe").select("doc_id", F.lit("escapes_parent").alias("kind"), F.col("ord").alias("detail"))
    leaves = s.join(sections.select("doc_id", F.col("parent_ord").alias("ord")).distinct(), ["doc_id", "ord"], "left_anti")
    stretches = coverage(leaves, sizes.select("doc_id", "n_pages"))
    listed = lambda on, kind: stretches.where(on).select("doc_id", F.lit(kind).alias("kind"), F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("detail"))
    twice, never = listed("times > 1", "duplicate"), listed("times = 0", "uncovered")
    return bad.union(escapes).union(never).union(twice)


def repair(top: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, title, start_page, end_page): top-level sections clamped, sorted, without overlaps, and with gaps filled.

    The page after all earlier sections is a running maximum, so one ordered window per document does it.
    """
    s = top.join(sizes, "doc_id").withColumn("a", F.greatest("start_page", F.lit(1))).withColumn("b", F.least("end_page", F.col("n_pages").cast("int"))).where("a <= b")
    order = Window.partitionBy("doc_id").orderBy("a", "ord")
    s = s.withColumn("cursor", F.coalesce(F.max(F.col("b") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
    gap_title = lambda a, b: F.concat(F.lit(GAP_TITLE[0]), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(GAP_TITLE[1]))
    cursor, start = F.col("cursor"), F.col("a")
    gap = F.when(start > cursor, F.struct(gap_title(cursor, start - 1).alias("title"), cursor.alias("start_page"), (start - 1).alias("end_page")))
    own = F.when(F.col("b") >= cursor, F.struct("title", F.greatest(start, cursor).alias("start_page"), F.col("b").alias("end_page")))
    inside = s.select("doc_id", F.explode(F.array_compact(F.array(gap, own))).alias("s")).select("doc_id", "s.*")
    last = sizes.join(s.groupBy("doc_id").agg(F.max("b").alias("e")), "doc_id", "left").withColumn("c", F.coalesce(F.col("e") + 1, F.lit(1)))
    tail = last.where("c <= n_pages").select("doc_id", gap_title(F.col("c"), F.col("n_pages")).alias("title"), F.col("c").alias("start_page"), F.col("n_pages").cast("int").alias("end_page"))
    return inside.union(tail)


def in_document(*order: str):
    """A window over the sections of one document, which are few."""
    return Window.partitionBy("doc_id").orderBy(*order)


def climb(nodes: DataFrame, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Where the nodes stand: (doc_id, node, depth, path), and (doc_id, node) of those that no root leads to, as they hang on a cycle or on a missing node.

    ``nodes(doc_id, node, parent, ord)``, roots have a null parent; ``path`` holds the place among the siblings at each level (empty without ``paths``, as the paths of a
    chain are together as long as its length squared). Pointers double: each round a node takes over the pointer of the node that it points to, so a tree of depth d is done in
    log2(d) + 1 rounds, each one job. A round that brings nobody to a root leaves only nodes that never get there.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("ord", "node"))
    own = F.array(place) if paths else F.array().cast("array<int>")
    now = nodes.select("doc_id", "node", F.col("parent").alias("up"), own.alias("path"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    before = None
    while True:
        seen = Observation()
        now = cut(now.observe(seen, F.count(F.when(F.col("up").isNotNull(), 1)).alias("open")))
        left = seen.get["open"]
        if left in (0, before):
            break
        before = left
        over = now.select("doc_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("more"))
        moved = now.where("up is not null").join(over, ["doc_id", "up"])
        moved = moved.select("doc_id", "node", F.col("next").alias("up"), F.concat("head", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth"))
        now = now.where("up is null").union(moved)
    found = now.where("up is null").select("doc_id", "node", "depth", "path")
    return found, nodes.select("doc_id", "node").join(found, ["doc_id", "node"], "left_anti")


def number(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, id, path, depth): S1, S1.1, ... by order among siblings. A node that no root leads to is left out."""
    found, _ = climb(nodes)
    return found.select("doc_id", "node", F.concat(F.lit("S"), F.array_join(F.col("path").cast("array<string>"), ".")).alias("id"), "path", "depth")


def outline(numbered: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, outline): one indented line per section, depth first."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("id"), F.lit(" "), F.col("title"))
    rows = numbered.join(titles, ["doc_id", "node"]).select("doc_id", F.struct("path", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])).alias("outline"))


def visual_tags(captions: DataFrame) -> DataFrame:
    """(doc_id, section_id, tag): ``Figures 1 (p2), 3 (p9); Table 1 (p7)``, the first page of each number, numbers in order."""
    first = captions.groupBy("doc_id", "section_id", "kind", "number").agg(F.min("page").alias("page"))
    part = F.concat(F.col("number").cast("string"), F.lit(" (p"), F.col("page").cast("string"), F.lit(")"))
    kinds = first.groupBy("doc_id", "section_id", "kind").agg(F.sort_array(F.collect_list(F.struct("number", part.alias("s")))).alias("xs"))
    label = F.concat("kind", F.when(F.size("xs") > 1, "s").otherwise(""), F.lit(" "), F.concat_ws(", ", F.transform("xs", lambda x: x["s"])))
    return kinds.groupBy("doc_id", "section_id").agg(F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("kind", label.alias("s")))), lambda x: x["s"])).alias("tag"))
