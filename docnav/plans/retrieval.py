"""Queries over pages and sections: ranking, references, captions, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.functions import text as X
from docnav.functions.text import fixed, headings, norm_quote, page_flag, references, strip, tokens
from docnav.operators import intervals as I
from docnav.operators import retrieval as R
from docnav.operators import tree as T
from docnav.operators.captions import page_visuals, verified_hints
from docnav.operators.lineage import cut, folder
from docnav.operators.postings import PostingIndex
from docnav.sources import adapters as A


def sql_tokens(x: str) -> str:
    """Distinct search tokens of an expression, without order."""
    kind, num = f"regexp_extract_all(lower({x}), '\\b(figure|fig|table|tab)\\s*(\\d+)\\b', 1)", f"regexp_extract_all(lower({x}), '\\b(figure|fig|table|tab)\\s*(\\d+)\\b', 2)"
    form = "flatten([[CASE WHEN z[1] LIKE 'fig%' THEN 'figure' ELSE 'table' END || f, CASE WHEN z[1] LIKE 'fig%' THEN 'fig' ELSE 'tab' END || f] FOR f IN [z[2], CAST(CAST(z[2] AS BIGINT) AS VARCHAR), lpad(CAST(CAST(z[2] AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(z[2] AS BIGINT) AS VARCHAR))) AS INT), '0')]])"
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z0-9]+'), flatten([{form} FOR z IN list_zip({kind}, {num})])))"


def sql_bm25(units: str, queries: str, k: int, name: str = "") -> str:
    """CTEs up to r: (corpus_id, qid, unit_id, ord, score, rank). Their names end in ``name``."""
    x = name
    return f"""u{x} AS (SELECT corpus_id, unit_id, ord, {sql_tokens("text")} AS toks FROM ({units})),
s{x} AS (SELECT corpus_id, count(*) AS n, avg(len(toks)) AS av FROM u{x} GROUP BY corpus_id),
q{x} AS (SELECT DISTINCT corpus_id, qid, unnest({sql_tokens("query")}) AS term FROM ({queries})),
e{x} AS (SELECT corpus_id, unit_id, ord, len(toks) AS l, unnest(toks) AS term FROM u{x}),
h{x} AS (SELECT ee.*, qq.qid, count(*) OVER (PARTITION BY ee.corpus_id, qq.qid, ee.term) AS df FROM e{x} ee JOIN q{x} qq ON ee.corpus_id = qq.corpus_id AND ee.term = qq.term),
c{x} AS (SELECT hh.corpus_id, qid, unit_id, ord, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / av))), 9) AS score FROM h{x} hh JOIN s{x} ss ON hh.corpus_id = ss.corpus_id GROUP BY hh.corpus_id, qid, unit_id, ord),
r{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id, qid ORDER BY score DESC, ord) AS rank FROM c{x} WHERE score > 0) WHERE rank <= {k})"""


_UNITS = "SELECT corpus_id, page AS unit_id, page AS ord, text FROM ({})"


def _units(pages: DataFrame) -> DataFrame:
    return pages.select("corpus_id", F.col("page").alias("unit_id"), F.col("page").alias("ord"), "text")


def bm25_page_search(spark: SparkSession, d: str) -> DataFrame:
    got = R.bm25(_units(A.document_pages(spark, d)), A.document_questions(spark, d))
    return got.select(F.col("corpus_id").alias("doc_id"), "qid", F.col("unit_id").cast("long").alias("page"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BM25_PAGE_SEARCH = f"WITH {sql_bm25(_UNITS.format(A.DOCUMENT_PAGES), A.DOCUMENT_QUESTIONS, 5)} SELECT corpus_id AS doc_id, qid, unit_id AS page, round(score, 6) AS score, rank FROM r"


def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search in a stored index that odd pages came to first and even ones later."""
    units, index = _units(A.document_pages(spark, d)), PostingIndex(spark, folder(spark))
    index.append(units.where("unit_id % 2 = 1"), "odd")
    index.append(units.where("unit_id % 2 = 0"), "even")
    got = index.search(A.document_questions(spark, d))
    return got.select(F.col("corpus_id").alias("doc_id"), "qid", F.col("unit_id").cast("long").alias("page"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


STORED_INDEX_SEARCH = BM25_PAGE_SEARCH


def stored_index_parts(spark: SparkSession, d: str) -> DataFrame:
    """What questions find in the index of conversations after its first batch, and after the second one."""
    units, index = _units(A.conversation_pages(spark, d)), PostingIndex(spark, folder(spark), block=16)
    asked = A.conversation_questions(spark, d)
    index.append(units.where("unit_id <= 3"), "begin")
    first = cut(index.search(asked, 2).withColumn("after", F.lit(1)))
    index.append(units.where("unit_id > 3"), "rest")
    return first.union(index.search(asked, 2).withColumn("after", F.lit(2))).select("after", F.col("corpus_id").alias("conv_id"), "qid", F.col("unit_id").alias("page"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BEGIN = _UNITS.format(f"SELECT * FROM ({A.CONVERSATION_PAGES}) WHERE page <= 3")
STORED_INDEX_PARTS = f"""WITH {sql_bm25(_BEGIN, A.CONVERSATION_QUESTIONS, 2, "b")}, {sql_bm25(_UNITS.format(A.CONVERSATION_PAGES), A.CONVERSATION_QUESTIONS, 2, "w")}
SELECT 1 AS after, corpus_id AS conv_id, qid, unit_id AS page, round(score, 6) AS score, rank FROM rb UNION ALL SELECT 2, corpus_id, qid, unit_id, round(score, 6), rank FROM rw"""


def bm25_conversation_search(spark: SparkSession, d: str) -> DataFrame:
    got = R.bm25(_units(A.conversation_pages(spark, d)), A.conversation_questions(spark, d))
    return got.select(F.col("corpus_id").alias("conv_id"), "qid", F.col("unit_id").alias("page"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BM25_CONVERSATION_SEARCH = f"WITH {sql_bm25(_UNITS.format(A.CONVERSATION_PAGES), A.CONVERSATION_QUESTIONS, 5)} SELECT corpus_id AS conv_id, qid, unit_id AS page, round(score, 6) AS score, rank FROM r"


def section_bm25(spark: SparkSession, d: str) -> DataFrame:
    units = R.section_units(A.conversation_pages(spark, d), A.conversation_sections(spark, d))
    got = R.bm25(units, A.conversation_questions(spark, d), 3)
    return got.select(F.col("corpus_id").alias("conv_id"), "qid", F.col("unit_id").alias("section_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SECTION_UNITS = f"SELECT s.corpus_id, section_id AS unit_id, ord, string_agg(text, ' ' ORDER BY page) AS text FROM ({A.CONVERSATION_SECTIONS}) s JOIN ({A.CONVERSATION_PAGES}) p ON s.corpus_id = p.corpus_id AND page BETWEEN start_page AND end_page GROUP BY s.corpus_id, section_id, ord"
SECTION_BM25 = f"WITH {sql_bm25(_SECTION_UNITS, A.CONVERSATION_QUESTIONS, 3)} SELECT corpus_id AS conv_id, qid, unit_id AS section_id, round(score, 6) AS score, rank FROM r"


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    p = A.document_pages(spark, d).select("corpus_id", F.size(tokens(F.col("text"))).alias("n"))
    return p.groupBy(F.col("corpus_id").alias("doc_id")).agg(F.count("*").alias("pages"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"))


TOKEN_STATS = f"SELECT corpus_id AS doc_id, count(*) AS pages, CAST(sum(len({sql_tokens('text')})) AS BIGINT) AS tokens, round(avg(len({sql_tokens('text')})), 6) AS mean_tokens FROM ({A.DOCUMENT_PAGES}) GROUP BY corpus_id"


def _located(spark: SparkSession, d: str) -> DataFrame:
    # the index is read by every branch, so it is made once
    return R.locate(cut(A.indexed_pages(spark, d)), cut(A.nested_sections(spark, d)), A.locate_questions(spark, d))


def region_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Sections and pages of each conversation for its question: references first, then what two queries find, then sections of the best pages."""
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    scores = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["id"].cast("string"), fixed(x["score"])))).alias(c)
    return _located(spark, d).select(F.col("corpus_id").alias("conv_id"), text("ref_pages"), text("ref_sections"), scores("ranked_pages"), scores("ranked_sections"), text("sections"), text("anchor_pages"))


_PAGE_CORPUS = f"SELECT corpus_id, page AS unit_id, page AS ord, concat_ws(' ', title, figures, tables, summary, role, md) AS text FROM ({A.INDEXED_PAGES})"
_SECTION_CORPUS = f"""SELECT s.corpus_id, s.section_id AS unit_id, s.ord, s.title || ' ' || string_agg(concat_ws(' ', p.title, p.summary, p.role, p.figures, p.tables), ' ' ORDER BY p.page) AS text FROM ({A.NESTED_SECTIONS}) s JOIN ({A.INDEXED_PAGES}) p ON s.corpus_id = p.corpus_id
AND p.page BETWEEN s.start_page AND s.end_page GROUP BY s.corpus_id, s.section_id, s.ord, s.title"""
_LOCATE_QUERIES = f"SELECT corpus_id, qno AS qid, query FROM ({A.LOCATE_QUERIES})"


def _sql_fused(name: str) -> str:
    return f"""f{name} AS (SELECT corpus_id, unit_id, ord, round(sum(share), 9) AS score, min(qid * 100 + rank) AS first FROM (SELECT *, score / greatest(max(score) OVER (PARTITION BY corpus_id, qid), 1e-9) AS share FROM r{name}) GROUP BY corpus_id, unit_id, ord),
o{name} AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, first) AS i FROM f{name})"""


def _region_fusion_sql(queries: str = _LOCATE_QUERIES) -> str:
    # figures stand on pages 1, 4, ... by their own numbers, tables on 2, 5, ...; a mention of figure 7 stands on pages 2, 5, ... and of any on 3, 6, ...
    return f"""WITH {sql_bm25(_PAGE_CORPUS, queries, 5, "p")}, {sql_bm25(_SECTION_CORPUS, queries, 3, "t")}, {_sql_fused("p")}, {_sql_fused("t")},
z AS ({A.NESTED_SECTIONS}), n AS (SELECT corpus_id, max(end_page) AS n FROM z GROUP BY corpus_id), w AS (SELECT corpus_id, page, unnest(generate_series(1, 1)) AS one FROM ({A.CONVERSATION_PAGES})),
x AS (SELECT corpus_id, 0 AS pos, 1 AS page FROM n WHERE corpus_id % 3 = 0 UNION ALL SELECT corpus_id, 1, 2 FROM n WHERE corpus_id % 3 = 0 AND n >= 2
UNION ALL SELECT corpus_id, 0, 7 FROM n WHERE corpus_id % 3 = 1 AND n >= 7 UNION ALL SELECT w.corpus_id, 0, page FROM w JOIN n ON w.corpus_id = n.corpus_id WHERE w.corpus_id % 3 = 1 AND n.n < 7 AND page % 3 = 2),
ix AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY pos, page) AS i, count(*) OVER (PARTITION BY corpus_id) AS refs FROM x),
rs AS (SELECT z.corpus_id, section_id, ord, row_number() OVER (PARTITION BY z.corpus_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY z.corpus_id) AS refs FROM z WHERE EXISTS (SELECT 1 FROM x WHERE x.corpus_id = z.corpus_id AND x.page BETWEEN start_page AND end_page)),
ps AS (SELECT z.corpus_id, section_id, row_number() OVER (PARTITION BY z.corpus_id ORDER BY ord) AS i FROM z WHERE EXISTS (SELECT 1 FROM op WHERE op.corpus_id = z.corpus_id AND op.i <= 3 AND op.unit_id BETWEEN start_page AND end_page)),
allsec AS (SELECT corpus_id, section_id, min(part * 1000 + i) AS k FROM (SELECT corpus_id, section_id, 0 AS part, i FROM rs UNION ALL SELECT corpus_id, unit_id, 1, i FROM ot UNION ALL SELECT corpus_id, section_id, 2, i FROM ps) GROUP BY corpus_id, section_id),
cutsec AS (SELECT a.*, row_number() OVER (PARTITION BY a.corpus_id ORDER BY k) AS i, greatest(3, coalesce(m.refs, 0)) AS most FROM allsec a LEFT JOIN (SELECT DISTINCT corpus_id, refs FROM rs) m ON a.corpus_id = m.corpus_id),
allpage AS (SELECT corpus_id, page, min(part * 1000 + i) AS k FROM (SELECT corpus_id, page, 0 AS part, i FROM ix UNION ALL SELECT corpus_id, unit_id, 1, i FROM op) GROUP BY corpus_id, page),
cutpage AS (SELECT a.*, row_number() OVER (PARTITION BY a.corpus_id ORDER BY k) AS i, greatest(4, coalesce(m.refs, 0)) AS most FROM allpage a LEFT JOIN (SELECT DISTINCT corpus_id, refs FROM ix) m ON a.corpus_id = m.corpus_id),
g1 AS (SELECT corpus_id, string_agg(page, ',' ORDER BY i) AS v FROM ix GROUP BY 1), g2 AS (SELECT corpus_id, string_agg(section_id, ',' ORDER BY i) AS v FROM rs GROUP BY 1), g3 AS (SELECT corpus_id, string_agg(unit_id || ':' || printf('%.3f', score), ',' ORDER BY i) AS v FROM op GROUP BY 1),
g4 AS (SELECT corpus_id, string_agg(unit_id || ':' || printf('%.3f', score), ',' ORDER BY i) AS v FROM ot GROUP BY 1), g5 AS (SELECT corpus_id, string_agg(section_id, ',' ORDER BY i) AS v FROM cutsec WHERE i <= most GROUP BY 1), g6 AS (SELECT corpus_id, string_agg(page, ',' ORDER BY i) AS v FROM cutpage WHERE i <= most GROUP BY 1)
SELECT n.corpus_id AS conv_id, coalesce(g1.v, '') AS ref_pages, coalesce(g2.v, '') AS ref_sections, coalesce(g3.v, '') AS ranked_pages, coalesce(g4.v, '') AS ranked_sections, coalesce(g5.v, '') AS sections, coalesce(g6.v, '') AS anchor_pages
FROM n LEFT JOIN g1 USING (corpus_id) LEFT JOIN g2 USING (corpus_id) LEFT JOIN g3 USING (corpus_id) LEFT JOIN g4 USING (corpus_id) LEFT JOIN g5 USING (corpus_id) LEFT JOIN g6 USING (corpus_id)"""


REGION_FUSION = _region_fusion_sql()
#: The first page to open for each question alone, without its further query.
AGENT_ANCHORS = f"SELECT conv_id AS corpus_id, CAST(string_split(anchor_pages, ',')[1] AS INT) AS page FROM ({_region_fusion_sql(f'SELECT corpus_id, qno AS qid, query FROM ({A.LOCATE_QUERIES}) WHERE qno = 0')})"


def _visuals(spark: SparkSession, d: str) -> DataFrame:
    return page_visuals(A.captioned_pages(spark, d).select(F.col("corpus_id").alias("doc_id"), "page", F.col("text").alias("md")))


def captions_and_mentions(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.concat_ws("|", F.col(c).cast("array<string>")).alias(c)
    return _visuals(spark, d).select("doc_id", "page", text("figures"), text("tables"), text("mentions_figures"), text("mentions_tables"))


_LINES = f"SELECT corpus_id, page, unnest(string_split(text, chr(10))) AS line FROM ({A.CAPTIONED_PAGES})"
_CAPTION, _MENTION = X.CAPTION, X.MENTION  # the fixed patterns of functions.text
_CAPTION_ROWS = f"SELECT corpus_id, page, CASE WHEN lower(regexp_extract(trim(line), '{_CAPTION}', 1)) LIKE 'tab%' THEN 'Table' ELSE 'Figure' END AS kind, CAST(regexp_extract(trim(line), '{_CAPTION}', 2) AS INT) AS number, trim(regexp_replace(trim(regexp_extract(trim(line), '{_CAPTION}', 3)), '\\*+$', '')) AS rest FROM ({_LINES}) WHERE regexp_matches(trim(line), '{_CAPTION}')"
_MENTION_ROWS = f"SELECT DISTINCT corpus_id, page, CASE WHEN lower(unnest(regexp_extract_all(line, '{_MENTION}', 1))) LIKE 'tab%' THEN 'Table' ELSE 'Figure' END AS kind, CAST(unnest(regexp_extract_all(line, '{_MENTION}', 2)) AS INT) AS number FROM ({_LINES}) WHERE NOT regexp_matches(trim(line), '{_CAPTION}')"
CAPTIONS_AND_MENTIONS = f"""WITH p AS ({A.CAPTIONED_PAGES}), c AS ({_CAPTION_ROWS}), m AS ({_MENTION_ROWS}),
ca AS (SELECT corpus_id, page, string_agg(kind || ' ' || number || ': ' || rest, '|') FILTER (WHERE kind = 'Figure') AS f, string_agg(kind || ' ' || number || ': ' || rest, '|') FILTER (WHERE kind = 'Table') AS t FROM c GROUP BY ALL),
ma AS (SELECT corpus_id, page, string_agg(CAST(number AS VARCHAR), '|' ORDER BY number) FILTER (WHERE kind = 'Figure') AS f, string_agg(CAST(number AS VARCHAR), '|' ORDER BY number) FILTER (WHERE kind = 'Table') AS t FROM m GROUP BY ALL)
SELECT p.corpus_id AS doc_id, p.page, coalesce(ca.f, '') AS figures, coalesce(ca.t, '') AS tables, coalesce(ma.f, '') AS mentions_figures, coalesce(ma.t, '') AS mentions_tables
FROM p LEFT JOIN ca ON p.corpus_id = ca.corpus_id AND p.page = ca.page LEFT JOIN ma ON p.corpus_id = ma.corpus_id AND p.page = ma.page"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    v = _visuals(spark, d).withColumnRenamed("doc_id", "corpus_id")
    rows = lambda kind, c: v.select("corpus_id", "page", F.lit(kind).alias("kind"), F.explode(c).alias("x"))
    caps = rows("Figure", "figures").union(rows("Table", "tables")).withColumn("number", F.element_at(references(F.col("x")), 1)["number"]).drop("x")
    ments = rows("Figure", "mentions_figures").union(rows("Table", "mentions_tables")).withColumnRenamed("x", "number")
    asked = v.select("corpus_id").distinct().select("corpus_id", F.lit(0).alias("qid"), F.lit("Compare Figure 1 with tab. 2, fig 7 and Table 99, then figure 1").alias("query"))
    return R.resolve(asked, caps, ments)


def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).select(F.col("corpus_id").alias("doc_id"), "ref", F.concat_ws(",", F.col("pages").cast("array<string>")).alias("pages"), "via")


RESOLVE_REFERENCES = f"""WITH c AS ({_CAPTION_ROWS}), m AS ({_MENTION_ROWS}),
a AS (SELECT DISTINCT corpus_id, unnest(['Figure', 'Table', 'Figure', 'Table']) AS kind, unnest([1, 2, 7, 99]) AS number FROM ({A.CONVERSATION_PAGES})),
cp AS (SELECT corpus_id, kind, number, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM c GROUP BY ALL), mp AS (SELECT corpus_id, kind, number, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM m GROUP BY ALL)
SELECT a.corpus_id AS doc_id, a.kind || ' ' || a.number AS ref, coalesce(cp.pages, mp.pages, '') AS pages, CASE WHEN cp.pages IS NOT NULL THEN 'caption' WHEN mp.pages IS NOT NULL THEN 'mention' ELSE 'none' END AS via
FROM a LEFT JOIN cp USING (corpus_id, kind, number) LEFT JOIN mp USING (corpus_id, kind, number)"""


def hint_verification(spark: SparkSession, d: str) -> DataFrame:
    """Each document's question as a hint on each of its pages."""
    pages = A.document_pages(spark, d).select(F.col("corpus_id").alias("doc_id"), "page", F.col("text").alias("md"))
    hints = pages.join(A.document_questions(spark, d).select(F.col("corpus_id").alias("doc_id"), F.col("query").alias("hint")), "doc_id").select("doc_id", "page", "hint")
    own = pages.select("doc_id", "page", F.substring("md", 1, 40).alias("hint"))
    return verified_hints(pages, hints.union(own)).select("doc_id", F.col("page").cast("long").alias("page"), "hint")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
HINT_VERIFICATION = f"""WITH p AS ({A.DOCUMENT_PAGES}), h AS (SELECT p.corpus_id, page, query AS hint FROM p JOIN ({A.DOCUMENT_QUESTIONS}) q ON p.corpus_id = q.corpus_id UNION ALL SELECT corpus_id, page, substr(text, 1, 40) FROM p),
n AS (SELECT h.*, {_NORM.format("hint")} AS hn, {_NORM.format("text")} AS pn FROM h JOIN p ON h.corpus_id = p.corpus_id AND h.page = p.page)
SELECT corpus_id AS doc_id, page, hint FROM n WHERE length(hn) >= 12 AND contains(pn, substr(hn, 1, greatest(12, least(length(hn), 60))))"""


def page_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document that shares a token with its question."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("corpus_id"), "text").join(A.document_questions(spark, d), "corpus_id")
    return docs.select(F.col("corpus_id").alias("doc_id"), R.snippet(F.col("text"), tokens(F.col("query"))).alias("snippet"))


_SNIPPET_LINES = "SELECT doc_id AS corpus_id, generate_subscripts(l, 1) AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
PAGE_SNIPPETS = f"""WITH l AS ({_SNIPPET_LINES}), q AS (SELECT corpus_id, query FROM ({A.DOCUMENT_QUESTIONS})), t AS (SELECT DISTINCT corpus_id, unnest({sql_tokens("query")}) AS term FROM q),
w AS (SELECT corpus_id, page, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM l UNION ALL SELECT corpus_id, page, unnest({sql_tokens("text")}) FROM l WHERE regexp_matches(lower(text), '(figure|fig|table|tab)\\s*[0-9]')),
h AS (SELECT w.corpus_id, min(page) AS page FROM w JOIN t ON w.corpus_id = t.corpus_id AND w.term = t.term GROUP BY w.corpus_id)
SELECT q.corpus_id AS doc_id, coalesce(substr(trim(l.text), 1, 200), '') AS snippet FROM q LEFT JOIN h ON q.corpus_id = h.corpus_id LEFT JOIN l ON l.corpus_id = h.corpus_id AND l.page = h.page"""


def visual_tags(spark: SparkSession, d: str) -> DataFrame:
    v = _visuals(spark, d)
    rows = lambda kind, c: v.select("doc_id", F.concat(F.lit("S"), F.floor((F.col("page") + 3) / 4).cast("string")).alias("section_id"), "page", F.lit(kind).alias("kind"), F.explode(c).alias("x"))
    caps = rows("Figure", "figures").union(rows("Table", "tables")).withColumn("number", F.element_at(references(F.col("x")), 1)["number"])
    return T.visual_tags(caps)


VISUAL_TAGS = f"""WITH c AS (SELECT corpus_id, 'S' || ((page + 3) // 4) AS section_id, kind, number, min(page) AS page FROM ({_CAPTION_ROWS}) GROUP BY ALL),
k AS (SELECT corpus_id, section_id, kind, kind || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' ' || string_agg(number || ' (p' || page || ')', ', ' ORDER BY number) AS s FROM c GROUP BY corpus_id, section_id, kind)
SELECT corpus_id AS doc_id, section_id, string_agg(s, '; ' ORDER BY kind) AS tag FROM k GROUP BY ALL"""


def baseline_page_selection(spark: SparkSession, d: str) -> DataFrame:
    q = A.conversation_questions(spark, d).where("qid = 1")
    return R.select_pages(A.conversation_pages(spark, d), q, 3).select(F.col("corpus_id").alias("conv_id"), "page")


BASELINE_PAGE_SELECTION = f"""WITH {sql_bm25(_UNITS.format(A.CONVERSATION_PAGES), f"SELECT * FROM ({A.CONVERSATION_QUESTIONS}) WHERE qid = 1", 3)},
x AS (SELECT p.corpus_id, p.page, row_number() OVER (PARTITION BY p.corpus_id ORDER BY rank NULLS LAST, p.page) AS i FROM ({A.CONVERSATION_PAGES}) p LEFT JOIN r ON p.corpus_id = r.corpus_id AND p.page = r.unit_id)
SELECT corpus_id AS conv_id, page FROM x WHERE i <= 3"""


def quote_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages that stand in a document after normalisation. The words of a passage but its first and last stand in
    a document as whole words: three of them in a row, the longest by letters, are the join key, or the longest word if they are fewer. Passages of one
    or two words are compared with every document; the tables of short ones are looked at only if there are any."""
    n = 3

    def windows(words):
        """Hashes of n words in a row: n shifted copies side by side, as a slice of its own for each window would copy the array."""
        shifted = F.arrays_zip(*[F.slice(words, F.lit(k + 1), F.greatest(F.lit(0), F.size(words) - (n - 1))).alias(f"w{k}") for k in range(n)])
        return F.transform(shifted, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(n)]))

    words = lambda c: F.split(norm_quote(c), " ")
    items = A.table(spark, d, "benchmark").select("item_id", norm_quote(F.col("text")).alias("quote"), words(F.col("text")).alias("w")).where("quote <> ''")
    inner = F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 2))
    letters = F.transform(F.sequence(F.lit(0), F.size(inner) - n), lambda i: F.struct(F.length(F.array_join(F.slice(inner, i + 1, n), "")), (-i).alias("i")))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    long = items.where(F.size("w") >= n + 2).select("item_id", "quote", F.get(windows(inner), -F.array_max(letters)["i"]).alias("h"))
    short = items.where(F.size("w").between(3, n + 1)).select("item_id", "quote", longest.alias("h"))
    tiny = items.where(F.size("w") < 3).select("item_id", "quote")
    docs = A.spread(A.table(spark, d, "documents").select("doc_id", "text"))
    # keys are exploded and joined without the texts, which meet only the quotes they may hold and are normalised again only there
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    may = split.select("doc_id", F.explode(windows(F.col("w"))).alias("h")).join(long, "h").select("doc_id", "item_id", "quote")
    if not short.isEmpty():
        may = may.union(split.select("doc_id", F.explode(F.array_distinct("w")).alias("h")).join(short, "h").select("doc_id", "item_id", "quote"))
    held = F.contains("t", F.col("quote"))
    found = docs.join(may.distinct(), "doc_id").select("doc_id", "item_id", "quote", norm_quote(F.col("text")).alias("t")).where(held).select("doc_id", "item_id")
    if not tiny.isEmpty():
        found = found.union(docs.select("doc_id", norm_quote(F.col("text")).alias("t")).join(tiny, held).select("doc_id", "item_id"))
    return found.distinct()


_QUOTE = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9%$., ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
QUOTE_EXACT_MATCH = f"""WITH i AS MATERIALIZED (SELECT item_id, {_QUOTE.format("text")} AS q FROM benchmark), t AS MATERIALIZED (SELECT doc_id, {_QUOTE.format("text")} AS t FROM documents)
SELECT DISTINCT doc_id, item_id FROM t JOIN i ON contains(t, q) WHERE q <> ''"""


def page_stats_flags(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and flag of each page; as native text stands in what the page has without its spaces, times the page's number mod 4."""
    p = A.document_pages(spark, d)
    parsed = F.length(strip(F.col("text")))
    native = (F.length(F.regexp_replace("text", " ", "")) * (F.col("page") % 4)).cast("int")
    return p.select(F.col("corpus_id").alias("doc_id"), F.col("page").cast("long").alias("page"), parsed.cast("long").alias("parsed_chars"), native.alias("native_chars"), headings(F.col("text")).alias("headings"), page_flag(parsed, native).alias("flag"))


PAGE_STATS_FLAGS = f"""WITH p AS (SELECT corpus_id, page, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS a, CAST(length(replace(text, ' ', '')) * (page % 4) AS INT) AS n, text FROM ({A.DOCUMENT_PAGES}))
SELECT corpus_id AS doc_id, page, a AS parsed_chars, n AS native_chars, CASE WHEN text LIKE '#%' THEN 1 ELSE 0 END AS headings,
CASE WHEN a < 40 THEN 'EMPTY_OR_NEAR_EMPTY (page content not captured as text; needs image inspection)' WHEN n = 0 THEN 'OCR_ONLY (no native text layer; text comes from RapidOCR)' WHEN a < 0.4 * n THEN 'TEXT_LOSS (docling captured <40% of native text)' END AS flag FROM p"""


def document_rollup(spark: SparkSession, d: str) -> DataFrame:
    return page_stats_flags(spark, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("flag").alias("pages_flagged"), F.sum("parsed_chars").alias("total_parsed_chars"), F.sum("native_chars").alias("total_native_chars"), F.sum("headings").alias("total_headings"))


DOCUMENT_ROLLUP = f"SELECT doc_id, count(*) AS pages, count(flag) AS pages_flagged, CAST(sum(parsed_chars) AS BIGINT) AS total_parsed_chars, CAST(sum(native_chars) AS BIGINT) AS total_native_chars, CAST(sum(headings) AS BIGINT) AS total_headings FROM ({PAGE_STATS_FLAGS}) GROUP BY doc_id"


def _loose_sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One section per turn whose range depends on the length of its text: with gaps, overlaps, reversals and overruns."""
    p = A.conversation_pages(spark, d).withColumn("n", F.length("text"))
    s = p.select(F.col("corpus_id").alias("doc_id"), F.col("page").alias("ord"), F.when(F.col("n") % 5 == 0, F.col("page") - 1).alias("parent_ord"), F.concat(F.lit("T"), F.col("page").cast("string")).alias("title"), (F.col("page") * 2 - F.col("n") % 4).cast("int").alias("start_page"), (F.col("page") * 2 - 1 + F.col("n") % 3).cast("int").alias("end_page"))
    s = s.withColumn("parent_ord", F.when(F.col("parent_ord") >= 1, F.col("parent_ord")))
    return s, p.groupBy(F.col("corpus_id").alias("doc_id")).agg((F.count("*") * 2).alias("n_pages"))


_LOOSE = f"""p AS (SELECT corpus_id AS doc_id, page, length(text) AS n FROM ({A.CONVERSATION_PAGES})),
s AS (SELECT doc_id, page AS ord, CASE WHEN n % 5 = 0 AND page > 1 THEN page - 1 END AS parent_ord, 'T' || page AS title, CAST(page * 2 - n % 4 AS INT) AS start_page, CAST(page * 2 - 1 + n % 3 AS INT) AS end_page FROM p), z AS (SELECT doc_id, count(*) * 2 AS n_pages FROM p GROUP BY doc_id)"""


def tree_validate(spark: SparkSession, d: str) -> DataFrame:
    return T.validate(*_loose_sections(spark, d))


TREE_VALIDATE = f"""WITH {_LOOSE}, l AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.doc_id = s.doc_id AND c.parent_ord = s.ord) AND start_page <= end_page),
c AS (SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, unnest(generate_series(start_page, end_page)) AS page FROM l) GROUP BY ALL)
SELECT s.doc_id, 'bad_range' AS kind, ord AS detail FROM s JOIN z USING (doc_id) WHERE start_page < 1 OR end_page > n_pages OR start_page > end_page
UNION ALL SELECT s.doc_id, 'escapes_parent', s.ord FROM s JOIN s q ON s.doc_id = q.doc_id AND s.parent_ord = q.ord WHERE s.start_page < q.start_page OR s.end_page > q.end_page
UNION ALL SELECT doc_id, 'uncovered', CAST(page AS INT) FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS page FROM z) a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.page = a.page)
UNION ALL SELECT doc_id, 'duplicate', CAST(page AS INT) FROM c WHERE n > 1"""


def tree_repair(spark: SparkSession, d: str) -> DataFrame:
    return T.repair(*_loose_sections(spark, d))


TREE_REPAIR = f"""WITH {_LOOSE}, x AS (SELECT s.doc_id, ord, title, greatest(start_page, 1) AS a, CAST(least(end_page, n_pages) AS INT) AS b, n_pages FROM s JOIN z USING (doc_id)),
y AS (SELECT *, coalesce(max(b + 1) OVER (PARTITION BY doc_id ORDER BY a, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cur FROM x WHERE a <= b),
t AS (SELECT z.doc_id, z.n_pages, coalesce(max(b) + 1, 1) AS c FROM z LEFT JOIN y USING (doc_id) GROUP BY z.doc_id, z.n_pages)
SELECT doc_id, 'Pages ' || cur || '-' || (a - 1) || ' (unassigned by LLM)' AS title, CAST(cur AS INT) AS start_page, CAST(a - 1 AS INT) AS end_page FROM y WHERE a > cur
UNION ALL SELECT doc_id, title, CAST(greatest(a, cur) AS INT), CAST(b AS INT) FROM y WHERE b >= cur
UNION ALL SELECT doc_id, 'Pages ' || c || '-' || n_pages || ' (unassigned by LLM)', CAST(c AS INT), CAST(n_pages AS INT) FROM t WHERE c <= n_pages"""


def _geography(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree."""
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    r = A.table(spark, d, "region").select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("title"))
    n = A.table(spark, d, "nation").select(node("N", "n_nationkey"), node("R", "n_regionkey"), F.col("n_nationkey").cast("long"), "n_name")
    c = A.table(spark, d, "customer").select(node("C", "c_custkey"), node("N", "c_nationkey"), F.col("c_custkey").cast("long"), "c_name")
    return r.union(n).union(c).select(F.lit(0).alias("doc_id"), "node", "parent", "ord", "title")


_GEOGRAPHY = "SELECT 'R' || r_regionkey AS node, NULL AS parent, r_regionkey AS ord, r_name AS title FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_custkey, c_name FROM customer"
_NUMBERED = f"""g AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, node) AS n FROM ({_GEOGRAPHY})),
w AS (SELECT node, 'S' || n AS id, 0 AS depth, [n] AS path, title FROM g WHERE parent IS NULL UNION ALL SELECT g.node, w.id || '.' || g.n, w.depth + 1, list_append(w.path, g.n), g.title FROM g JOIN w ON g.parent = w.node)"""


def tree_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.number(_geography(spark, d)).select("node", "id", "depth")


TREE_IDS = f"WITH RECURSIVE {_NUMBERED} SELECT node, id, depth FROM w"


def outline_text(spark: SparkSession, d: str) -> DataFrame:
    tree = _geography(spark, d).where("node not like 'C%'")
    return T.outline(T.number(tree), tree.select("doc_id", "node", "title")).select("outline")


OUTLINE_TEXT = f"WITH RECURSIVE {_NUMBERED} SELECT string_agg(repeat('  ', depth) || id || ' ' || title, chr(10) ORDER BY path) AS outline FROM w WHERE node NOT LIKE 'C%'"


def sections_for_pages(spark: SparkSession, d: str) -> DataFrame:
    """The sections that cover each page of a conversation, in document order."""
    pages = A.conversation_pages(spark, d).select("corpus_id", F.col("page").alias("question_id"), "page")
    got = R.covered_by(pages, A.nested_sections(spark, d), "ids")
    return got.select(F.col("corpus_id").alias("doc_id"), F.col("question_id").alias("page"), F.concat_ws(",", "ids").alias("sections"))


SECTIONS_FOR_PAGES = f"SELECT p.corpus_id AS doc_id, page, string_agg(section_id, ',' ORDER BY ord) AS sections FROM ({A.CONVERSATION_PAGES}) p JOIN ({A.NESTED_SECTIONS}) s ON p.corpus_id = s.corpus_id AND page BETWEEN start_page AND end_page GROUP BY ALL"


def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often each stretch of a conversation's pages is covered by sections with gaps, overlaps, reversals and overruns."""
    sections, sizes = _loose_sections(spark, d)
    runs = I.coverage(sections, sizes).where("inside")
    # neighbouring stretches may be covered equally often
    return runs.groupBy("doc_id", "times").agg(F.sum(F.col("last") - F.col("first") + 1).alias("pages"), F.min("first").alias("first"), F.max("last").alias("last")).select("doc_id", F.col("times").cast("int").alias("times"), "pages", "first", "last")


PAGE_COVERAGE = f"""WITH {_LOOSE}, g AS (SELECT doc_id, unnest(generate_series(1, n_pages)) AS page FROM z),
c AS (SELECT g.doc_id, g.page, count(s.ord) AS times FROM g LEFT JOIN s ON s.doc_id = g.doc_id AND g.page BETWEEN s.start_page AND s.end_page GROUP BY ALL)
SELECT doc_id, CAST(times AS INT) AS times, count(*) AS pages, min(page) AS first, max(page) AS last FROM c GROUP BY doc_id, times"""


def wide_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of each order in ranges that its lines span: up to hundreds of millions of numbers, some reversed."""
    lines = A.table(spark, d, "lineitem")
    first = F.col("l_linenumber") - F.pmod("l_partkey", F.lit(4)).cast("int")
    last = F.when(F.col("l_returnflag") == "R", first - 1 - F.col("l_linenumber")).otherwise(first + F.pmod("l_suppkey", F.lit(3)).cast("int") + F.when(F.col("l_linestatus") == "O", (F.col("l_quantity") * 10_000_000).cast("int")).otherwise(0))
    ranges = lines.select(F.col("l_orderkey").alias("corpus_id"), F.col("l_linenumber").alias("line"), first.alias("start_page"), last.alias("end_page"))
    parts = I.tasks_for(lines)
    found = I.pages_in(ranges, lines.select(F.col("l_orderkey").alias("corpus_id"), F.col("l_linenumber").alias("page")), parts=parts).repartition(parts, "corpus_id", "line")
    return found.groupBy(F.col("corpus_id").alias("orderkey"), "line").agg(F.count("*").alias("held"), F.sum("page").alias("numbers"))


WIDE_RANGES = """WITH r AS (SELECT l_orderkey, l_linenumber AS line, l_linenumber - l_partkey % 4 AS a, CASE WHEN l_returnflag = 'R' THEN l_linenumber - l_partkey % 4 - 1 - l_linenumber
ELSE l_linenumber - l_partkey % 4 + l_suppkey % 3 + CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity * 10000000 AS INT) ELSE 0 END END AS b FROM lineitem)
SELECT r.l_orderkey AS orderkey, line, count(*) AS held, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM r JOIN lineitem l ON l.l_orderkey = r.l_orderkey AND l.l_linenumber BETWEEN a AND b GROUP BY ALL"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order of a customer below the one before it."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node"), before.alias("parent"), F.col("o_orderkey").alias("ord"))


def order_chains(spark: SparkSession, d: str) -> DataFrame:
    return T.number(_orders(spark, d)).select(F.col("doc_id").alias("custkey"), F.col("node").alias("orderkey"), "id", "depth")


ORDER_CHAINS = """SELECT o_custkey AS custkey, o_orderkey AS orderkey, 'S1' || repeat('.1', CAST(n AS INT) - 1) AS id, CAST(n - 1 AS INT) AS depth
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"""


def lost_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers below customers by a rule that makes cycles and names parents that do not exist: the depth of those below a root, -1 for the others."""
    key = F.col("c_custkey").cast("long")
    nodes = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), (key % 1000).alias("node")).distinct()
    nodes = nodes.select("doc_id", "node", F.when(F.col("node") % 10 != 0, (F.col("node") * 7) % 1000).alias("parent"), F.col("node").alias("ord"))
    found, lost = T.climb(nodes, paths=False)
    return found.select("doc_id", "node", "depth").union(lost.select("doc_id", "node", F.lit(-1)))


LOST_NODES = """WITH RECURSIVE n AS (SELECT DISTINCT c_nationkey AS doc_id, CAST(c_custkey AS BIGINT) % 1000 AS node FROM customer), p AS (SELECT *, CASE WHEN node % 10 <> 0 THEN (node * 7) % 1000 END AS parent FROM n),
w AS (SELECT doc_id, node, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.node, w.depth + 1 FROM p JOIN w ON p.doc_id = w.doc_id AND p.parent = w.node)
SELECT p.doc_id, p.node, coalesce(w.depth, -1) AS depth FROM p LEFT JOIN w ON w.doc_id = p.doc_id AND w.node = p.node"""


QUERIES = (
    bm25_page_search, bm25_conversation_search, section_bm25, token_stats, region_fusion, captions_and_mentions, resolve_references, hint_verification, page_snippets, visual_tags, baseline_page_selection,
    quote_exact_match, page_stats_flags, document_rollup, tree_validate, tree_repair, tree_ids, outline_text, sections_for_pages, stored_index_search, stored_index_parts, page_coverage, wide_ranges,
    order_chains, lost_nodes,
)
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
