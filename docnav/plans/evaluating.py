"""Queries over evaluation, judging, evidence and the page index."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.functions import chat as C
from docnav.operators import agent as G
from docnav.operators import evaluation as E
from docnav.operators import indexing as I
from docnav.operators.lineage import cut, folder
from docnav.sources import adapters as A

_t = A.table

_GOLD = "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS STRING) ELSE 'Not answerable' END"
_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'Str' WHEN 1 THEN 'Int' ELSE 'None' END"
_SAID = "CASE p_partkey % 5 WHEN 0 THEN 'The answer is: ' || p_brand WHEN 1 THEN CAST(p_size AS STRING) || '.7' WHEN 2 THEN 'Not answerable' WHEN 3 THEN '' ELSE p_brand || '.' END"
_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
# what the rules make of these answers, in SQL: an extracted answer x against a gold answer g of kind k
_EXTRACTED = "CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) || '.7' WHEN 2 THEN 'Not answerable' WHEN 3 THEN '' ELSE p_brand END"
_SIMILAR = "(1 - levenshtein(lower(x), lower(g)) / greatest(length(x), length(g), 1))"
_FIRST = r"TRY_CAST(nullif(regexp_extract({}, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE)"
_RULES = f"""CASE k WHEN 'None' THEN CAST(lower(x) = 'not answerable' AS INT)::DOUBLE WHEN 'Int' THEN coalesce(CAST(trunc({_FIRST.format('x')}) = trunc({_FIRST.format('g')}) AS INT), 0)::DOUBLE
ELSE CASE WHEN lower(x) = 'not answerable' THEN 0.0 WHEN {_SIMILAR} > 0.5 THEN {_SIMILAR} ELSE 0.0 END END"""
_ANSWERS = f"SELECT *, {_SQL(_GOLD)} AS g, {_KIND} AS k, {_SQL(_SAID)} AS said, {_EXTRACTED} AS x FROM part"


def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as runs: answers, gold and pages follow from their keys; every third has a judge, whose call failed for some."""
    p = _t(spark, d, "part")
    gold = F.struct(F.expr(_GOLD).alias("answer"), F.expr(_KIND).alias("answer_format"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN cast(array() as array<int>) ELSE array(cast(p_size % 7 as int)) END").alias("evidence_pages"), F.array(F.lit("Table")).alias("evidence_sources"))
    judge = F.when(F.expr("p_partkey % 3 = 0"), F.struct(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 1.0D END").alias("judge_score"), F.lit(0.25).alias("extract_score"), F.expr("CASE WHEN p_partkey % 6 = 3 THEN 'down' END").alias("error")))
    runs = p.select(
        F.col("p_partkey").alias("run_id"), F.col("p_name").alias("question"), gold.alias("gold"), F.expr(_SAID).alias("final_answer"), F.lit("answered").alias("agent_status"), F.lit("ACCEPT").alias("decision"), F.expr("array(cast(p_partkey % 7 as int))").alias("cited_pages"),
        F.expr("array(cast(p_partkey % 5 as int), 1)").alias("pages_read"), F.expr("array(3)").alias("inspected_pages"), F.lit(1).alias("round"), F.lit(2).alias("calls"), judge.alias("judge"),
    )
    got = E.evaluation_rows(runs)
    return got.select("run_id", "gold_answer_format", "extracted_answer", F.round("score", 6).alias("score"), "score_source", F.round("score_official_rule", 6).alias("score_official_rule"), "correct", "cited_page_hit", "gold_page_visited_by_agent", F.concat_ws(",", F.col("pages_visited").cast("array<string>")).alias("pages_visited"))


EVALUATION_ROWS = f"""WITH a AS ({_ANSWERS}), r AS (SELECT *, {_RULES} AS rules FROM a),
s AS (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN 'rules' WHEN p_partkey % 6 = 3 THEN 'rules_fallback' ELSE 'llm_judge' END AS source FROM r), t AS (SELECT *, CASE source WHEN 'llm_judge' THEN 1.0 ELSE rules END AS score, list_sort(list_distinct([p_partkey % 5, 1, 3])) AS seen FROM s)
SELECT p_partkey AS run_id, k AS gold_answer_format, x AS extracted_answer, round(score, 6) AS score, source AS score_source, round(rules, 6) AS score_official_rule, score >= 0.999 AS correct, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 = p_size % 7 END AS cited_page_hit,
CASE WHEN p_partkey % 4 > 0 THEN list_contains(seen, p_size % 7) END AS gold_page_visited_by_agent, array_to_string(seen, ',') AS pages_visited FROM t"""


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """The same answers, extracted and judged by the scripted judge; nothing is asked about empty ones."""
    a = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.expr(_GOLD).alias("gold_answer"), F.expr(_KIND).alias("gold_format"), F.expr(_SAID).alias("response"))
    return E.judged(a, mode="both").select("p_partkey", "empty", "extracted", "extract_parse_ok", F.round("extract_score", 6).alias("extract_score"), "judge_extracted", "verdict", "judge_score")


JUDGED_ANSWERS = f"""WITH a AS (SELECT p_partkey, g, k, said, said AS x FROM ({_ANSWERS})), b AS (SELECT *, said = '' AS none, CASE WHEN contains(lower(said), lower(g)) THEN 'Correct' ELSE 'Incorrect' END AS v FROM a)
SELECT p_partkey, none AS empty, said AS extracted, CASE WHEN NOT none THEN true END AS extract_parse_ok, CASE WHEN none THEN 0.0 ELSE round({_RULES}, 6) END AS extract_score, CASE WHEN NOT none THEN said END AS judge_extracted, CASE WHEN none THEN 'Incorrect' ELSE v END AS verdict,
CASE WHEN none OR v = 'Incorrect' THEN 0.0 ELSE 1.0 END AS judge_score FROM b"""


def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of three quotations for each conversation: from its first page, from an inspection of its second, and from nowhere."""
    c = _t(spark, d, "conversations")
    one = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    # only a-z are raised: upper() makes SS of a sharp s, which does not stand on the page
    loud = F.translate(F.substring("text", 1, 25), ascii_lowercase, ascii_uppercase)
    entry = lambda page, quote: F.struct(F.lit(page).alias("page"), quote.alias("quote"), F.lit("a").alias("candidate_answer"))
    finals = one.select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("conv_id").alias("corpus_id"), F.array(entry(1, loud), entry(2, F.lit("the chart shows 12%")), entry(3, F.lit("@@@@@"))).alias("ledger"),
        F.array(F.struct(F.lit(2).alias("page"), F.lit("q").alias("question"), F.lit("I see: The chart shows 12%!").alias("result"))).alias("inspections"),
    )
    index = c.select(F.col("conv_id").alias("corpus_id"), (F.col("turn") + 1).cast("int").alias("page"), F.col("text").alias("md"))
    got = G.evidence(finals, index).select(F.col("run_id").cast("long").alias("conv_id"), F.explode("quote_checks").alias("q"), "any_quote_verified")
    return got.select("conv_id", F.col("q.entry").alias("entry"), F.col("q.page").alias("page"), F.col("q.source").alias("source"), "any_quote_verified")


EVIDENCE_CHECKS = "SELECT DISTINCT conv_id, CAST(unnest([1, 2, 3]) AS INT) AS entry, CAST(unnest([1, 2, 3]) AS INT) AS page, unnest(['page_text', 'image_inspection', NULL]) AS source, true AS any_quote_verified FROM conversations"


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of a batch."""
    r = _t(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS status", "o_orderkey % 2 * 1.0D AS score", "CASE WHEN o_orderkey % 5 = 0 THEN 'rules_fallback' ELSE 'llm_judge' END AS score_source", "o_orderkey % 3 * 0.5D AS score_official_rule", "o_totalprice AS cost")
    return E.batch_report(r)


BATCH_REPORT = """SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS failed, round(avg(o_orderkey % 2) FILTER (WHERE o_orderkey % 9 > 0), 6) AS mean_score, round(avg(o_orderkey % 3 * 0.5::DOUBLE) FILTER (WHERE o_orderkey % 9 > 0), 6) AS mean_rule_score,
count(*) FILTER (WHERE o_orderkey % 9 > 0 AND o_orderkey % 5 = 0) AS judge_failed, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 9 > 0), 4) AS total_cost FROM orders"""


def _index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = A.indexed_pages(spark, d).withColumnRenamed("corpus_id", "doc_id")
    return I.build(pages.select("doc_id", "page", "md", F.when(F.col("page") % 4 == 0, 0).otherwise(F.length("md")).alias("chars")), pages.drop("title", "summary", "keywords", "md"))


def page_index(spark: SparkSession, d: str) -> DataFrame:
    """Page records of every conversation with the scripted model; every fourth page is summarised from its image."""
    r = _index(spark, d)["records"]
    return r.select("doc_id", "page", "source", "title", "summary", F.concat_ws("|", "keywords").alias("keywords"), F.concat_ws("|", F.col("figures")).alias("figures"), F.concat_ws("|", F.col("tables")).alias("tables"), "error")


_LINE = "string_split(md, chr(10))[1]"
PAGE_INDEX = f"""WITH p AS (SELECT *, CASE WHEN page % 4 = 0 THEN corpus_id || ' ' || page ELSE CASE WHEN length(md) > 3000 THEN substr(md, 1, 3000) || ' ...[truncated]' ELSE md END || CASE WHEN figures <> '' OR tables <> '' THEN chr(10) || chr(10) || 'Captions on this page, to be kept as they are:' || chr(10) || figures || tables ELSE '' END END AS told FROM ({A.INDEXED_PAGES})),
t AS (SELECT *, string_split(told, chr(10))[1] AS line FROM p)
SELECT corpus_id AS doc_id, page, CASE WHEN page % 4 = 0 THEN 'image' ELSE 'text' END AS source, substr(trim(line), 1, 120) AS title, regexp_replace(substr(told, 1, 200), '^\\s+|\\s+$', '', 'g') AS summary, array_to_string(list_filter(string_split(line, ' '), lambda w: w <> '')[1:3], '|') AS keywords, figures, tables, CAST(NULL AS VARCHAR) AS error FROM t"""


def index_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What building the index of every conversation came to: the scripted model gives no hierarchy, so it is repaired into one section."""
    made = _index(spark, d)
    sections = made["sections"].groupBy("doc_id").agg(F.first("section_id").alias("section_id"), F.first("title").alias("title"))
    return made["diagnostics"].join(sections, "doc_id").select("doc_id", "n_pages", "from_image", "summary_failures", "hierarchy_attempts", "hierarchy_fallback_used", "sections", "section_id", "title")


INDEX_DIAGNOSTICS = f"""SELECT corpus_id AS doc_id, max(page) AS n_pages, count(*) FILTER (WHERE page % 4 = 0) AS from_image, 0 AS summary_failures, 2 AS hierarchy_attempts, true AS hierarchy_fallback_used, 1 AS sections, 'S1' AS section_id, 'Pages 1-' || max(page) || ' (unassigned by LLM)' AS title FROM ({A.CONVERSATION_PAGES}) GROUP BY corpus_id"""


def image_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Replies in JSON, in a fenced block, and in prose, as summaries."""
    reply = "CASE p_partkey % 3 WHEN 0 THEN '{\"title\": \"' || p_name || '\", \"keywords\": [\"' || p_brand || '\"]}' WHEN 1 THEN '```json' || chr(10) || '{\"summary\": \"' || p_type || '\", \"has_visual_elements\": false}' || chr(10) || '```' ELSE '## ' || p_name || chr(10) || p_type END"
    got = C.image_summary(F.expr(reply), F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", got["title"].alias("title"), got["summary"].alias("summary"), F.concat_ws(",", got["keywords"]).alias("keywords"), got["has_visual_elements"].alias("has_visual_elements"))


IMAGE_SUMMARIES = """SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'Page ' || p_partkey ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN '{"title": "' || p_name || '", "keywords": ["' || p_brand || '"]}' WHEN 1 THEN p_type ELSE '## ' || p_name || chr(10) || p_type END AS summary,
CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE '' END AS keywords, p_partkey % 3 <> 1 AS has_visual_elements FROM part"""


def stable_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of calls that differ in volatile fields only are equal."""
    e = _t(spark, d, "events")
    text = lambda c: F.col(c).cast("string")
    fields = F.create_map(F.lit("timestamp"), text("event_id"), F.lit("model"), F.col("event_type"), F.lit("messages"), (F.col("user_id") % 20).cast("string"))
    return e.select(C.stable_key(fields).alias("key")).groupBy("key").agg(F.count("*").alias("calls"))


STABLE_KEYS = """SELECT sha256('{"messages":"' || (user_id % 20) || '","model":"' || event_type || '"}') AS key, count(*) AS calls FROM events GROUP BY 1"""


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose pages were indexed in an earlier state: what a refresh finds added, changed, gone and unchanged, and how many records it then has and had to make."""
    pages = A.indexed_pages(spark, d).withColumnRenamed("corpus_id", "doc_id")
    visuals = pages.drop("title", "summary", "keywords", "md")
    now = pages.select("doc_id", "page", "md", F.length("md").alias("chars"))
    then = now.where("not (doc_id % 5 = 0 and page = 2)").withColumn("md", F.when(F.col("page") % 3 == 0, F.concat(F.lit("was "), F.col("md"))).otherwise(F.col("md"))).withColumn("chars", F.length("md"))
    then = then.union(now.where("doc_id % 4 = 0 and page = 1").select("doc_id", F.lit(900).alias("page"), "md", "chars"))
    store = I.IndexStore(spark, folder(spark))
    store.refresh(then, visuals)
    before = cut(store.changes(now))
    records = store.refresh(now, visuals).groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.count("*").alias("records"))
    made = store.last_made().groupBy("doc").agg(F.count("*").alias("made"))
    return before.join(records, "doc").join(made, "doc", "left").select(F.col("doc").cast("long").alias("conv_id"), "added", "changed", "gone", "same", "records", F.coalesce("made", F.lit(0)).alias("made"))


INDEX_REFRESH = """WITH p AS (SELECT conv_id, turn + 1 AS page FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE conv_id % 5 = 0 AND page = 2) AS added, count(*) FILTER (WHERE page % 3 = 0) AS changed, CAST(conv_id % 4 = 0 AS BIGINT) AS gone,
count(*) FILTER (WHERE page % 3 <> 0 AND NOT (conv_id % 5 = 0 AND page = 2)) AS same, count(*) AS records, count(*) FILTER (WHERE page % 3 = 0 OR (conv_id % 5 = 0 AND page = 2)) AS made FROM p GROUP BY conv_id"""


QUERIES = (index_refresh, evaluation_rows, judged_answers, evidence_checks, batch_report, page_index, index_diagnostics, image_summaries, stable_keys)
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
