"""Queries over runs: grounding decisions, traces, summaries, selection, loader transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.functions import metrics as M
from docnav.operators import agent as G
from docnav.operators import report as P
from docnav.operators.passages import passage_matches as passages
from docnav.plans import retrieval
from docnav.sources import adapters as A

_t = A.table

# ------------------------------------------------------------------ grounding
# every order as a run: its status, verdict, quote and round follow from its columns
_DECIDED = {
    "status": "CASE o_orderkey % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'not_answerable' ELSE 'error' END", "verdict": "CASE o_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_supported' WHEN 2 THEN 'insufficient' END",
    "quote_ok": "o_orderstatus = 'F'", "round": "CAST(floor(o_totalprice) AS BIGINT) % 3 + 1",
}


def decision_table(spark: SparkSession, d: str) -> DataFrame:
    """What is decided for the orders as runs, with three rounds at most: each combination of status, verdict, quote and round that comes, and in how many runs."""
    runs = _t(spark, d, "orders").select(*[F.expr(e).alias(c) for c, e in _DECIDED.items()])
    decided = runs.withColumn("decision", G.decision(F.col("status"), F.col("verdict"), F.col("quote_ok"), F.col("round"), F.lit(3)))
    return decided.groupBy(*_DECIDED, "decision").agg(F.count("*").alias("runs"))


DECISION_TABLE = f"""SELECT status, verdict, quote_ok, round, CASE WHEN status = 'error' THEN 'ABSTAIN'
WHEN status = 'answered' AND verdict IS NULL THEN CASE WHEN quote_ok THEN 'ACCEPT_WEAK_GROUNDING' WHEN round < 3 THEN 'REPLAN' ELSE 'ABSTAIN' END
WHEN status = 'not_answerable' THEN CASE WHEN verdict = 'supported' OR round >= 3 THEN 'ACCEPT_ABSTAIN' ELSE 'REPLAN' END
WHEN verdict = 'supported' THEN CASE WHEN quote_ok THEN 'ACCEPT' ELSE 'ACCEPT_WEAK_GROUNDING' END WHEN round < 3 THEN 'REPLAN' ELSE 'ABSTAIN' END AS decision, count(*) AS runs
FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _DECIDED.items())} FROM orders) GROUP BY ALL"""

# every document as a run whose final answer, ledger and plan follow from its id
_RUN = {
    "status": "CASE WHEN doc_id % 3 = 0 THEN 'not_answerable' ELSE 'answered' END", "calls": "CAST(doc_id % 4 AS INT)", "vis": "doc_id % 2 = 0", "quote": "CASE WHEN doc_id % 7 < 4 THEN 'q' ELSE '' END", "ok": "doc_id % 7 < 2",
    "qpage": "CASE WHEN doc_id % 11 > 0 THEN CAST(doc_id % 9 + 1 AS INT) END", "led": "CAST(doc_id % 5 = 0 AS INT)", "ref": "CAST(doc_id % 6 + 1 AS INT)", "anchor": "CAST(doc_id % 3 + 1 AS INT)", "seen": "CAST(doc_id % 4 + 1 AS INT)",
}
_GAP = """CASE WHEN calls = 0 THEN 'no page was inspected; look at page(s) ' || anchor || ' first' WHEN vis AND len(missing) > 0 THEN 'figures or tables on page(s) ' || array_to_string(missing, ', ') || ' were not inspected' END"""
_RUN_SQL = f"SELECT *, list_sort(list_filter(list_distinct([ref, anchor]), lambda p: p <> seen)) AS missing FROM (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in _RUN.items())} FROM documents)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", *[F.expr(e).alias(c) for c, e in _RUN.items()])


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which final answers are sent back, and why."""
    r = _runs(spark, d)
    ledger = F.when(F.col("led") == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    reason = G.gate(F.struct("status", "quote"), F.col("calls"), F.col("vis"), F.array("ref"), F.array("anchor"), F.array("seen"), ledger, F.col("ok"), F.col("qpage"))
    return r.select("doc_id", reason.isNull().alias("accepted"), reason.alias("reason"))


EVIDENCE_GATE = f"""WITH r AS ({_RUN_SQL}), g AS (SELECT *, CASE WHEN status = 'not_answerable' THEN {_GAP} WHEN led = 1 THEN NULL WHEN quote <> '' AND qpage IS NOT NULL THEN CASE WHEN NOT ok THEN 'the quote is not found verbatim on page ' || qpage END
ELSE 'no evidence is recorded; record a page with an exact quotation, or give quote and quote_page with the answer' END AS reason FROM r) SELECT doc_id, reason IS NULL AS accepted, reason FROM g"""


def abstention_backstop(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on abstentions that a model would support: those that looked at too little are planned anew while rounds are left."""
    r = _runs(spark, d).where("status = 'not_answerable'").withColumn("gap", G.abstention_gap(F.col("calls"), F.col("vis"), F.array("ref"), F.array("anchor"), F.array("seen")))
    verdict = F.when(F.col("gap").isNotNull(), "insufficient").otherwise("supported")
    return r.select("doc_id", "gap", G.decision(F.col("status"), verdict, F.lit(False), F.expr("cast(doc_id % 5 as int)"), F.lit(3)).alias("decision"))


ABSTENTION_BACKSTOP = f"SELECT doc_id, gap, CASE WHEN gap IS NULL OR doc_id % 5 >= 3 THEN 'ACCEPT_ABSTAIN' ELSE 'REPLAN' END AS decision FROM (SELECT doc_id, {_GAP} AS gap FROM ({_RUN_SQL}) WHERE status = 'not_answerable')"


def quote_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's words without every seventh, looked for in the turn before it and in its own (difflib's ratio is beyond SQL; tests hold it against plain Python)."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    words = F.split("text", " ")
    damaged = F.array_join(F.filter(words, lambda w, i: (i + 1) % 7 != 0), " ")
    both = c.select("conv_id", "turn", F.lit(0).alias("back"), damaged.alias("quote")).union(c.select("conv_id", F.col("turn") + 1, F.lit(1), damaged))
    return G.quotes_found(both.join(c, ["conv_id", "turn"])).select("conv_id", "turn", "back", "found", "ratio")


def passage_matches(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages, each as it is and without every seventh word, in all documents (difflib's ratio is beyond SQL; tests hold the join against all pairs)."""
    b = _t(spark, d, "benchmark")
    words = F.split("text", " ")
    damaged = F.array_join(F.filter(words, lambda w, i: (i + 1) % 7 != 0), " ")
    items = b.select(F.explode(F.array(*[F.struct((F.col("item_id") * 2 + k).alias("item_id"), text.alias("text")) for k, text in enumerate((F.col("text"), damaged))])).alias("x")).select("x.*")
    got = passages(items, A.spread(_t(spark, d, "documents").select("doc_id", "text")))
    return got.select("doc_id", F.expr("item_id div 2").alias("item_id"), (F.col("item_id") % 2 == 1).alias("damaged"), "ratio")


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    return A.nested_sections(spark, d).groupBy("corpus_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"])).alias("outline"))


def agent_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Plan, navigate and verify for every conversation with the scripted model, which quotes the first line of the first anchor page."""
    q = A.locate_questions(spark, d).select(F.col("corpus_id").cast("string").alias("run_id"), "corpus_id", "question")
    got = G.answer_runs(q, A.indexed_pages(spark, d), A.nested_sections(spark, d), _outlines(spark, d))
    return got.select(F.col("corpus_id").alias("conv_id"), "round", "calls", "decision", F.col("final_answer").alias("answer"), F.concat_ws(",", F.col("cited_pages").cast("array<string>")).alias("cited"))


AGENT_ROUNDS = f"""WITH a AS ({retrieval.AGENT_ANCHORS})
SELECT a.corpus_id AS conv_id, 1 AS round, 2 AS calls, 'ACCEPT' AS decision, substr(string_split(p.md, chr(10))[1], 1, 120) AS answer, CAST(p.page AS VARCHAR) AS cited FROM a JOIN ({A.INDEXED_PAGES}) p ON p.corpus_id = a.corpus_id AND p.page = a.page"""


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: those of even users are in the cache already."""
    e = _t(spark, d, "events").select(F.lit("answer").alias("kind"), F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("prompt"), "user_id")
    old = e.where("user_id % 2 = 0").select("kind", "prompt").distinct()
    cache = old.select(G.cache_key("kind", "prompt").alias("key"), F.concat(F.lit("cached "), F.col("prompt")).alias("reply"))
    return G.cached_calls(e.select("kind", "prompt"), cache)


CACHE_LOOKUP = """WITH e AS (SELECT DISTINCT event_type || '/' || CAST(user_id % 50 AS VARCHAR) AS prompt, user_id % 2 = 0 AS even FROM events), p AS (SELECT prompt, bool_or(even) AS hit FROM e GROUP BY prompt)
SELECT sha256('{"kind":"answer","prompt":"' || prompt || '"}') AS key, prompt, CASE WHEN hit THEN 'cached ' || prompt ELSE 'answer to ''' || prompt || '''' END AS reply, hit AS from_cache FROM p"""


# ------------------------------------------------------------------ traces
def repeat_calls(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("turn"), F.col("event_type").alias("tool"), F.floor(F.col("value") / 20).alias("args"))
    return G.anomalies(e)


REPEAT_CALLS = 'SELECT * FROM (SELECT user_id AS run, event_id AS turn, event_type AS tool, CAST(floor(value / 20) AS BIGINT) AS args, count(*) OVER (PARTITION BY user_id, event_type, floor(value / 20) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS "repeat" FROM events) WHERE "repeat" > 1'


def round_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event of a user tells the round; the others take the last one told."""
    e = _t(spark, d, "events").select("user_id", "event_id", F.expr("CASE WHEN event_id % 10 = 0 THEN event_id div 10 END").alias("told"))
    return e.select("user_id", "event_id", F.last("told", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("round"))


ROUND_FORWARD_FILL = "SELECT user_id, event_id, last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS round FROM (SELECT user_id, event_id, CASE WHEN event_id % 10 = 0 THEN event_id // 10 END AS told FROM events)"


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return P.latest(e, "user_id", "event_id")


LATEST_WINS = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 4), event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id"


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    done = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'failed' END").alias("error"))
    return P.pending(o.select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


RESUME_PENDING = "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0)"


# ------------------------------------------------------------------ summaries
def split_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The mock model on each document of a language: the answer repeats the question, gold is its first three words."""
    x = _t(spark, d, "documents").select("lang", "source", A.first_words(F.regexp_replace("text", "[^a-zA-Z ]", ""), 4).alias("q")).withColumn("answer", F.concat(F.lit("answer to '"), "q", F.lit("'")))
    gold = F.array(F.concat(F.lit("answer to "), A.first_words(F.col("q"), 3)))
    x = x.select("lang", "source", M.anls_best(F.col("answer"), gold).alias("a"), M.exact_match(F.col("answer"), gold).alias("e"))
    return x.groupBy("lang").agg(F.countDistinct("source").alias("decks"), F.count("*").alias("questions"), P.mean(F.col("a")).alias("anls"), P.mean(F.col("e")).alias("em"))


SPLIT_EVALUATION = rf"""WITH x AS (SELECT lang, source, array_to_string(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ')[1:4], ' ') AS q FROM documents),
y AS (SELECT lang, source, lower(trim('answer to ''' || q || '''')) AS p, lower(trim('answer to ' || array_to_string(string_split(q, ' ')[1:3], ' '))) AS t FROM x),
z AS (SELECT *, levenshtein(p, t) / greatest(length(p), length(t)) AS dist, trim(regexp_replace(regexp_replace(regexp_replace(p, '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS np, trim(regexp_replace(regexp_replace(regexp_replace(t, '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS nt FROM y)
SELECT lang, count(DISTINCT source) AS decks, count(*) AS questions, round(avg(CASE WHEN dist < 0.5 THEN 1 - dist ELSE 0 END), 6) AS anls, round(avg(CAST(np = nt AS INT)), 6) AS em FROM z GROUP BY lang"""

_RESULTS = "['Str', 'Int', 'Float', 'List'][doc_id % 4 + 1]"


def baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "labels").selectExpr(
        "element_at(array('Str', 'Int', 'Float', 'List'), cast(doc_id % 4 + 1 as int)) AS format", "CASE WHEN toxic = 1 THEN 'Not answerable' ELSE 'x' END AS gold", "CASE WHEN doc_id % 5 = 0 THEN 'Not answerable' WHEN doc_id % 5 = 1 THEN '' ELSE 'x' END AS extracted",
        "cast(quality as double) AS score", "doc_id % 3 AS gold_pages", "CASE WHEN doc_id % 3 > 0 THEN doc_id % 2 = 0 END AS gold_page_in_context", "doc_id % 13 = 0 AS truncated", "doc_id % 6 AS pages_sent", "doc_id % 7 AS pages_total", "doc_id % 100 AS prompt_tokens", "CASE WHEN doc_id % 8 > 0 THEN 5 END AS completion_tokens",
    )
    return P.baseline_summary(r, 10**6)


BASELINE_SUMMARY = f"""WITH r AS (SELECT {_RESULTS} AS format, toxic = 1 AS un, doc_id % 5 > 1 AS answered, quality::DOUBLE AS s, doc_id % 3 AS g, doc_id FROM labels),
a AS (SELECT format, count(*) AS questions, coalesce(round(avg(s), 6), 0) AS accuracy, coalesce(round(avg(s) FILTER (WHERE NOT un), 6), 0) AS accuracy_answerable, coalesce(round(avg(s) FILTER (WHERE un), 6), 0) AS accuracy_unanswerable,
coalesce(round(avg(s) FILTER (WHERE answered), 6), 0) AS "precision", coalesce(round(avg(s) FILTER (WHERE g = 1), 6), 0) AS single_page, coalesce(round(avg(s) FILTER (WHERE g > 1), 6), 0) AS multi_page,
round(avg(CAST(doc_id % 2 = 0 AS INT)) FILTER (WHERE g > 0), 6) AS gold_page_in_context, count(*) FILTER (WHERE doc_id % 13 = 0) AS truncated, count(*) FILTER (WHERE doc_id % 6 < doc_id % 7) AS documents_cut, CAST(sum(doc_id % 100) AS BIGINT) AS prompt_tokens,
CAST(5 * count(*) FILTER (WHERE doc_id % 8 > 0) AS BIGINT) AS completion_tokens, CASE WHEN format IS NULL THEN round(sum(s) / 1000000, 6) END AS accuracy_failed_counted_zero FROM r GROUP BY ROLLUP (format))
SELECT *, round(CASE WHEN "precision" + accuracy_answerable > 0 THEN 2 * "precision" * accuracy_answerable / ("precision" + accuracy_answerable) ELSE 0.0 END, 6) AS f1 FROM a"""


def _two_scorers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").selectExpr("doc_id AS run_id", "cast(quality as double) AS rules", "CASE WHEN doc_id % 9 > 0 THEN cast(toxic as double) END AS judge")


_SCORERS = "(SELECT doc_id AS run_id, quality::DOUBLE AS rules, CASE WHEN doc_id % 9 > 0 THEN toxic::DOUBLE END AS judge FROM labels)"


def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "labels").selectExpr(
        "element_at(array('Str', 'Int', 'Float', 'List'), cast(doc_id % 4 + 1 as int)) AS format", "cast(quality as double) AS rules", "CASE WHEN doc_id % 10 > 0 THEN 0.5 END AS extraction", "CASE WHEN doc_id % 9 > 0 THEN cast(toxic as double) END AS judge",
        "CASE WHEN doc_id % 10 > 0 THEN doc_id % 11 > 0 END AS extract_parse_ok", "CASE WHEN doc_id % 9 > 0 THEN 'Correct' END AS verdict", "doc_id % 18 = 0 AS empty", "doc_id % 7 > 0 AS asked",
    )
    return P.judge_summary(x)


JUDGE_SUMMARY = f"""SELECT {_RESULTS} AS format, count(*) AS judged, round(avg(quality), 6) AS rules_mean, round(avg(CASE WHEN doc_id % 10 > 0 THEN 0.5 END), 6) AS extraction_mean, round(avg(CASE WHEN doc_id % 9 > 0 THEN toxic END), 6) AS judge_mean,
count(*) FILTER (WHERE doc_id % 10 > 0 AND doc_id % 11 = 0) AS extraction_unparsed, count(*) FILTER (WHERE doc_id % 7 > 0 AND doc_id % 9 = 0 AND doc_id % 18 > 0) AS judge_unparsed, count(*) FILTER (WHERE doc_id % 18 = 0) AS empty_answers FROM labels GROUP BY ROLLUP ({_RESULTS})"""


def agreement_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.agreement(_two_scorers(spark, d))


AGREEMENT_MATRIX = f'SELECT count(*) FILTER (WHERE rules >= 0.999 AND judge >= 0.999) AS "both", count(*) FILTER (WHERE rules >= 0.999 AND judge < 0.999) AS rules_only, count(*) FILTER (WHERE rules < 0.999 AND judge >= 0.999) AS judge_only, count(*) FILTER (WHERE rules < 0.999 AND judge < 0.999) AS neither FROM {_SCORERS} WHERE judge IS NOT NULL'


def flip_report(spark: SparkSession, d: str) -> DataFrame:
    return P.flips(_two_scorers(spark, d))


FLIP_REPORT = f"SELECT direction, run_id FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY run_id) AS n FROM (SELECT run_id, CASE WHEN rules >= 0.999 AND judge < 0.999 THEN 'rules_only' WHEN rules < 0.999 AND judge >= 0.999 THEN 'judge_only' END AS direction FROM {_SCORERS} WHERE judge IS NOT NULL) WHERE direction IS NOT NULL) WHERE n <= 40"


def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Means of two systems over the runs that both have scored."""
    l_ = _t(spark, d, "labels")
    a, b = l_.where("doc_id % 2 = 0").selectExpr("doc_id", "cast(quality as double) AS a"), l_.where("doc_id % 3 = 0").selectExpr("doc_id", "cast(toxic as double) AS b")
    return a.join(b, "doc_id").agg(F.count("*").alias("shared"), F.round(F.avg("a"), 6).alias("system_mean"), F.round(F.avg("b"), 6).alias("baseline_mean"))


PAIRED_COMPARISON = "SELECT count(*) AS shared, round(avg(quality), 6) AS system_mean, round(avg(toxic), 6) AS baseline_mean FROM labels WHERE doc_id % 6 = 0"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_returnflag").alias("step"), (F.col("l_linestatus") == "O").alias("cached"), F.col("l_quantity").alias("prompt_tokens"), (F.col("l_quantity") * 2).alias("completion_tokens"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cost"), F.col("l_tax").alias("latency"))


_COSTS = "count(*) AS calls, count(*) FILTER (WHERE l_linestatus = 'O') AS cached, CAST(sum(l_quantity) AS BIGINT) AS prompt_tokens, CAST(sum(2 * l_quantity) AS BIGINT) AS completion_tokens, round(sum(l_extendedprice * l_discount), 6) AS cost, round(sum(l_tax), 2) AS latency"


def cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Costs of each order's calls by the order's status."""
    c = _calls(spark, d).join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return P.cost_rollup(c.withColumn("step", F.col("o_orderstatus"))).where("step is not null")


COST_LEDGER = f"SELECT o_orderstatus AS step, {_COSTS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"


def cost_by_step_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.cost_rollup(_calls(spark, d))


COST_BY_STEP_ROLLUP = f"SELECT l_returnflag AS step, {_COSTS} FROM lineitem GROUP BY ROLLUP (l_returnflag)"


# ------------------------------------------------------------------ selection and loading
def _qa(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("qa_id"), F.substring("text", 1, 30).alias("question"))


def first_n_docs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the first 20 conversations in order of id (a limit that is the feature)."""
    return P.first_documents(_qa(spark, d).withColumn("ord", F.col("doc_id")), 20).select("doc_id", "qa_id")


FIRST_N_DOCS = "SELECT conv_id AS doc_id, turn AS qa_id FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 20)"


def questions_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return P.per_document(_qa(spark, d), 2, "qa_id").select("doc_id", "qa_id", "question")


QUESTIONS_PER_DOC = "SELECT doc_id, qa_id, question FROM (SELECT conv_id AS doc_id, turn AS qa_id, substr(text, 1, 30) AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2"


def sample_set_match(spark: SparkSession, d: str) -> DataFrame:
    """A set that wants every fifth conversation whole and the second turn of all; each question takes its first match."""
    q = _qa(spark, d)
    whole = q.where("doc_id % 5 = 0").select((F.col("doc_id") * 2).alias("ord"), "doc_id", F.lit(None).cast("string").alias("question")).distinct()
    second = q.where("qa_id = 1").select((F.col("doc_id") * 2 - 1).alias("ord"), "doc_id", "question")
    return P.match_sample_set(q, whole.union(second))


SAMPLE_SET_MATCH = """WITH q AS (SELECT conv_id AS doc_id, turn AS qa_id, substr(text, 1, 30) AS question FROM conversations),
w AS (SELECT DISTINCT doc_id * 2 AS ord, doc_id, CAST(NULL AS VARCHAR) AS asked FROM q WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id * 2 - 1, doc_id, question FROM q WHERE qa_id = 1)
SELECT q.doc_id, qa_id, question, min(ord) AS ord FROM q JOIN w ON q.doc_id = w.doc_id AND (asked IS NULL OR asked = question) GROUP BY ALL"""


def sample_set_missing(spark: SparkSession, d: str) -> DataFrame:
    """Wanted questions that are not asked in these words."""
    q = _qa(spark, d)
    return P.unmatched(q, q.select("doc_id", F.concat(F.lit("x"), F.col("question")).alias("question"))).distinct()


SAMPLE_SET_MISSING = "WITH q AS (SELECT conv_id AS doc_id, substr(text, 1, 30) AS question FROM conversations) SELECT DISTINCT doc_id, 'x' || question AS question FROM q w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = w.doc_id AND q.question = 'x' || w.question)"


def answer_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an order's lines, each once in order: the first is the answer, the rest are alternatives."""
    x = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("f")))), lambda x: x["f"])).alias("a"))
    return x.select("l_orderkey", F.element_at("a", 1).alias("answer"), F.concat_ws(",", F.slice("a", F.lit(2), F.size("a"))).alias("alternatives"))


ANSWER_DEDUP = """WITH x AS (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, f) AS i FROM x)
SELECT l_orderkey, max(f) FILTER (WHERE i = 1) AS answer, coalesce(string_agg(f, ',' ORDER BY i) FILTER (WHERE i > 1), '') AS alternatives FROM r GROUP BY l_orderkey"""


def wide_to_long_pages(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a nation as its pages, up to the first that is missing."""
    n = _t(spark, d, "nation").selectExpr("n_nationkey", "n_name AS page_1", "CASE WHEN n_nationkey % 3 > 0 THEN 'b' || n_name END AS page_2", "'c' || n_name AS page_3")
    return prefix_pages(n, ["page_1", "page_2", "page_3"]).select("n_nationkey", "page", "value")


def prefix_pages(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long form of page columns: what stands before the first null, numbered from 0."""
    pages = F.array(*columns)
    gap = F.array_position(F.transform(pages, lambda x: x.isNull()), True)
    return rows.select("*", F.posexplode(F.when(gap > 0, F.slice(pages, F.lit(1), (gap - 1).cast("int"))).otherwise(pages)).alias("page", "value")).drop(*columns)


WIDE_TO_LONG_PAGES = "SELECT n_nationkey, unnest(generate_series(0, CASE WHEN n_nationkey % 3 > 0 THEN 2 ELSE 0 END))::INT AS page, unnest(CASE WHEN n_nationkey % 3 > 0 THEN [n_name, 'b' || n_name, 'c' || n_name] ELSE [n_name] END) AS value FROM nation"


def settings_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two settings of the suppliers' keys: balances rounded to tens and to hundreds."""
    s = _t(spark, d, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"), "s_suppkey")
    old, new = s.selectExpr("key", "cast(s_suppkey div 10 as string) AS value"), s.where("s_suppkey % 4 > 0").selectExpr("key", "cast(s_suppkey div 7 as string) AS value")
    return P.settings_diff(old, new)


SETTINGS_DIFF = "SELECT 'k' || s_suppkey AS key, CAST(s_suppkey // 10 AS VARCHAR) AS old, CAST(s_suppkey // 7 AS VARCHAR) AS new FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey // 10 <> s_suppkey // 7"


QUERIES = (
    decision_table, evidence_gate, abstention_backstop, quote_fuzzy_match, passage_matches, agent_rounds, cache_lookup, repeat_calls, round_forward_fill, latest_wins, resume_pending, split_evaluation, baseline_summary, judge_summary,
    agreement_matrix, flip_report, paired_comparison, cost_ledger, cost_by_step_rollup, first_n_docs, questions_per_doc, sample_set_match, sample_set_missing, answer_dedup, wide_to_long_pages, settings_diff,
)
ORACLES = {f.__name__: globals().get(f.__name__.upper()) for f in QUERIES}
