"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: strings that every match must contain give
conjunctions, alternatives give disjunctions, and a rule without a string of three characters gives no query. The index
holds postings (trigram, document) of the lower-cased texts for the trigrams that the queries name. Postings are
intersected by counting, for each document and conjunction, the trigrams met; documents that satisfy a rule's query are
verified by its regular expression, and rules without a query scan all documents.

A match is ``kind:start:end`` in code points, end exclusive; matches of a kind do not overlap, the leftmost comes first, and those
whose secret is too short are dropped. The base kinds are assign, access and hex; the other rules add theirs.

Defined results: null text is empty; rows without matches have counts of 0, the digest of the empty string and empty spans;
repeated rows repeat; a null doc_id takes part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import load, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group and least: the part of a match whose length counts, and how long it must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the contract's. A run of hexadecimal digits, or of letters after AKIA, is matched whole or not at all,
#: so there the least length may stand in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)
#: Strings that an expression may stand for, and characters of a set, beyond which they are no longer listed.
_MOST_STRINGS, _MOST_CHARS = 48, 6


def _strings(nodes) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(all strings that the nodes can match, or None; sets of strings of which every match contains one)."""
    exact: set[str] | None = {""}
    needed: list[frozenset[str]] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            needed.append(frozenset(run))
        run = {""}

    for op, arg in nodes:
        part: set[str] | None = None
        inner: list[frozenset[str]] = []
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN:
            chars = {chr(c).lower() for o, a in arg if o in (sre.LITERAL, sre.RANGE) for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
            if all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg) and len(chars) <= _MOST_CHARS:
                part = chars
        elif op is sre.SUBPATTERN:
            part, inner = _strings(arg[-1])
        elif op is sre.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            if all(p is not None for p, _ in parts):
                part = set().union(*(p for p, _ in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            one, inside = _strings(body)
            inner = inside if least else []
            if one is not None and most == 1:
                part = one | {""} if least == 0 else one
            elif one is not None and least == most and len(one) ** least <= _MOST_STRINGS:
                part = reduce(lambda a, b: {x + y for x in a for y in b}, [one] * least, {""})
        elif op is sre.AT:
            part = {""}
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            exact = {a + b for a in exact for b in part} if exact is not None and len(exact) * len(part) <= _MOST_STRINGS else None
        else:
            close()
            needed += inner
            exact = None
            if part is not None:
                run = set(part)
    close()
    return exact, needed


def trigrams(text: str) -> frozenset[str]:
    """Trigrams that cover a string, without the overlapping ones between them."""
    return frozenset([*(text[i : i + 3] for i in range(0, len(text) - 2, 3)), text[-3:]])


def query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of trigrams, of which every match satisfies one; none if the rule must scan everything."""
    _, needed = _strings(parser.parse(pattern))
    if not needed:
        return []
    best = max(needed, key=lambda alternatives: min(map(len, alternatives)))
    best = {s for s in best if not any(o != s and o in s for o in best)}
    all_of = {trigrams(s) for s in best}
    return sorted((c for c in all_of if not any(d < c for d in all_of)), key=sorted)


def _key() -> F.Column:
    """128 bits of a document's id and text."""
    row = (F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.struct(*(F.xxhash64(F.lit(seed), *row).alias(name) for name, seed in (("a", 3), ("b", 5))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _key().alias("key"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): documents whose postings satisfy the queries of these kinds."""
    asked = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(query(r.pattern)) for t in sorted(c)]
    names = sorted({t for _, _, t, _ in asked})
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in names]))
    postings = keyed.withColumn("low", F.lower("text")).select("key", F.explode(present).alias("trigram"))
    wanted = keyed.sparkSession.createDataFrame(asked, "kind string, part int, trigram string, need int")
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "part", "need").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _measure(rule: Rule):
    """The length of a match, or of its group."""
    return (lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group))) if rule.group else F.length


def _hits(rows: DataFrame, rules: tuple[Rule, ...], asked: bool) -> DataFrame:
    """(key, kind, at, gap, hit, size): the matches of each rule in order, with what stands before each."""
    each = []
    for r in rules:
        text = F.when(F.array_contains("kinds", r.kind), F.col("text")).otherwise(F.lit("")) if asked else F.col("text")
        gaps, hits = F.transform(F.split(text, r.pattern, -1), F.length), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        size = _measure(r)
        each.append(F.struct(F.lit(r.kind).alias("kind"), F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(hits, size).alias("size")).alias("found")))
    flat = rows.select("key", F.explode(F.array(*each)).alias("e")).select("key", "e.kind", F.posexplode("e.found").alias("at", "f"))
    return flat.select("key", "kind", "at", F.col("f.gap"), F.col("f.hit"), F.col("f.size"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kind, start, end) of each different document's matches; key is 128 bits of doc_id and text."""
    keyed = _keyed(docs)
    by_query = tuple(r for r in rules if query(r.pattern))
    scanned = tuple(r for r in rules if not query(r.pattern))
    parts = []
    if scanned:
        parts.append(_hits(keyed, scanned, asked=False))
    if by_query:
        parts.append(_hits(keyed.join(candidates(keyed, by_query), "key").select("key", "text", "kinds"), by_query, asked=True))
    found = reduce(DataFrame.union, parts).dropDuplicates(["key", "kind", "at"])
    so_far = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("key", "kind").orderBy("at"))
    least = reduce(lambda c, r: F.when(F.col("kind") == r.kind, r.least).otherwise(c), rules, F.lit(1))
    return found.withColumn("end", so_far).where(F.col("size") >= least).select("key", "kind", (F.col("end") - F.col("hit")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def summaries(spans: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(key, n_<base kind>..., base, spans): spans by start, then by the rules' order, comma-joined."""
    order = reduce(lambda c, ir: F.when(F.col("kind") == ir[1].kind, ir[0]).otherwise(c), enumerate(rules), F.lit(len(rules)))
    is_base = F.col("kind").isin([r.kind for r in base])
    one = F.struct("start", order.alias("o"), is_base.alias("base"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in base]
    grouped = spans.groupBy("key").agg(*counts, F.sort_array(F.collect_list(one)).alias("all"))
    joined = lambda keep: F.concat_ws(",", F.transform(F.filter("all", keep), lambda s: s["s"]))
    return grouped.select("key", *[f"n_{r.kind}" for r in base], joined(lambda s: s["base"]).alias("base"), joined(lambda s: F.lit(True)).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    got = summaries(find_secrets(docs))
    rows = _keyed(docs).select("doc_id", "key").join(got, "key", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


MASK = "[secret]"


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every match replaced by MASK, overlapping matches by one, and n_chars counted anew."""
    spans = find_secrets(docs, rules)
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("g", F.sum("new").over(order))
    merged = spans.groupBy("key", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    key, at = unused(docs, "key"), unused(docs, "cuts")
    rows = docs.withColumn(key, _key()).join(cuts.select(F.col("key").alias(key), F.col("cuts").alias(at)), key, "left")
    n = F.size(at)
    # between the cuts: from the end of one to the start of the next
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.element_at(at, F.greatest(i, F.lit(1)))["end"] + 1).cast("int"),
        F.greatest(F.lit(0), (F.when(i == n, F.length("text")).otherwise(F.element_at(at, F.least(i + 1, n))["start"]) - F.when(i == 0, 0).otherwise(F.element_at(at, F.greatest(i, F.lit(1)))["end"]))).cast("int")))
    masked = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(kept, MASK))
    out = rows.withColumn("text", masked)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    found = []
    for i, r in enumerate(RULES):
        size = f"length(regexp_extract(h[i], {quote(r.pattern)}, {r.group}))"
        found.append(f"""SELECT r, {i} AS o, '{r.kind}' AS kind, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s, length(h[i]) AS n
  FROM (SELECT r, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {quote(r.pattern)}) AS h, regexp_split_to_array(text, {quote(r.pattern)}) AS g FROM t) WHERE len(h) > 0) WHERE {size} >= {r.least}""")
    return (
        "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS (\n" + "\nUNION ALL\n".join(found) + "\n)"
        ", a AS (SELECT r, " + ", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{r.kind}" for i, r in enumerate(BASE)) + f""",
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) FILTER (WHERE o < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (r)"""
    )


ORACLE = _oracle()
