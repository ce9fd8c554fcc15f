"""Queries over answers: metrics, rule-based scores, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.functions import metrics as M
from docnav.functions import text as X
from docnav.functions.udfs import parse_list
from docnav.sources import adapters as A

# Part names with a prediction that is altered by the key: equal, shouted, cut, reversed, emptied, or with words added.
_ALTERED = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '.' WHEN 2 THEN substr(p_name, 1, 5) WHEN 3 THEN reverse(p_name) WHEN 4 THEN '' ELSE 'the ' || p_name || ' a ' || p_brand END"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", F.expr(_ALTERED).alias("prediction"), F.array("p_name", "p_type", F.lit(None).cast("string")).alias("targets"))


_ANSWERS = f"SELECT p_partkey, {_ALTERED} AS prediction, unnest([p_name, p_type]) AS target FROM part"


def anls_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", F.round(M.anls_best(F.col("prediction"), F.col("targets")), 6).alias("anls"))


ANLS_SCORES = f"""WITH a AS (SELECT p_partkey, lower(trim(prediction)) AS p, lower(trim(target)) AS t FROM ({_ANSWERS}))
SELECT p_partkey, round(max(CASE WHEN p = '' AND t = '' THEN 1.0 WHEN p = '' OR t = '' THEN 0.0 WHEN levenshtein(p, t) / greatest(length(p), length(t)) < 0.5 THEN 1.0 - levenshtein(p, t) / greatest(length(p), length(t)) ELSE 0.0 END), 6) AS anls FROM a GROUP BY p_partkey"""

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def token_f1_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", F.round(M.f1_best(F.col("prediction"), F.col("targets")), 6).alias("f1"))


TOKEN_F1_SCORES = f"""WITH a AS (SELECT row_number() OVER () AS i, p_partkey, list_filter(string_split({_NORM.format("prediction")}, ' '), lambda x: x <> '') AS p, list_filter(string_split({_NORM.format("target")}, ' '), lambda x: x <> '') AS t FROM ({_ANSWERS})),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))), 0) AS common FROM a)
SELECT p_partkey, round(max(CASE WHEN len(p) = 0 OR len(t) = 0 THEN CAST(len(p) = len(t) AS INT) WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(p) + len(t)) END), 6) AS f1 FROM c GROUP BY p_partkey"""


def exact_match_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", M.exact_match(F.col("prediction"), F.col("targets")).alias("em"))


EXACT_MATCH_SCORES = f"SELECT p_partkey, CAST(max(CAST({_NORM.format('prediction')} = {_NORM.format('target')} AS INT)) AS DOUBLE) AS em FROM ({_ANSWERS}) GROUP BY p_partkey"

_SCALED = "l_extendedprice * CASE l_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 0.01 WHEN 3 THEN 1.005 WHEN 4 THEN 1.02 WHEN 5 THEN 0.995 ELSE 2 END"


def float_equality(spark: SparkSession, d: str) -> DataFrame:
    li = A.table(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 7).alias("scale")).agg(F.count("*").alias("n"), F.count_if(M.float_equal(F.col("l_extendedprice"), F.expr(_SCALED))).alias("equal"))


FLOAT_EQUALITY = f"""SELECT scale, count(*) AS n, count(*) FILTER (WHERE list_bool_or([abs(c - p) <= 0.01 * greatest(abs(c), abs(p)) OR round(c, 2) = round(p, 2) FOR c IN [r / 100, r, r * 100]])) AS equal
FROM (SELECT l_orderkey % 7 AS scale, l_extendedprice AS r, CAST({_SCALED} AS DOUBLE) AS p FROM lineitem) GROUP BY scale"""

_INT_GOLD = "CAST(o_orderkey AS VARCHAR)"
_INT_PRED = "CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(o_orderkey AS VARCHAR) || '.9' WHEN 1 THEN '(' || CAST(o_orderkey AS VARCHAR) || ')' WHEN 2 THEN 'none' WHEN 3 THEN CAST(o_orderkey AS VARCHAR) || ' million' ELSE CAST(o_orderkey + 1 AS VARCHAR) END"
_TO_FLOAT = r"TRY_CAST(nullif(regexp_extract(trim(regexp_replace(regexp_replace(trim({}), '[$%,()]', '', 'g'), 'million|billion', '', 'g')), '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE)"
_SPARK = lambda e: F.expr(e.replace("AS VARCHAR", "AS STRING"))


def rule_score_int(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").select("o_orderkey", M.score_int(_SPARK(_INT_GOLD), _SPARK(_INT_PRED)).alias("score"))


RULE_SCORE_INT = f"SELECT o_orderkey, coalesce(CAST(trunc({_TO_FLOAT.format('g')}) = trunc({_TO_FLOAT.format('p')}) AS INT), 0)::DOUBLE AS score FROM (SELECT o_orderkey, {_INT_GOLD} AS g, {_INT_PRED} AS p FROM orders)"

_FLOAT_PRED = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '%' WHEN 1 THEN '0.' || CAST(p_size AS VARCHAR) WHEN 2 THEN 'unknown' ELSE CAST(p_size * 100 AS VARCHAR) END"


def rule_score_float(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", M.score_float(_SPARK("CAST(p_size AS VARCHAR)"), _SPARK(_FLOAT_PRED)).alias("score"))


RULE_SCORE_FLOAT = f"""SELECT p_partkey, coalesce(CAST(list_bool_or([abs(c - p) <= 0.01 * greatest(abs(c), abs(p)) OR round(c, 2) = round(p, 2) FOR c IN [g / 100, g, g * 100]]) AS INT), 0)::DOUBLE AS score
FROM (SELECT p_partkey, {_TO_FLOAT.format("CAST(p_size AS VARCHAR)")} AS g, {_TO_FLOAT.format("x")} AS p FROM (SELECT p_partkey, p_size, {_FLOAT_PRED} AS x FROM part))"""

_STR_GOLD = "CASE p_partkey % 8 WHEN 0 THEN 'Not answerable' WHEN 1 THEN 'www.' || p_brand WHEN 2 THEN 'page ' || CAST(p_size AS VARCHAR) ELSE p_name || ' (' || p_brand || ')' END"
_STR_PRED = "CASE p_partkey % 5 WHEN 0 THEN 'not answerable' WHEN 1 THEN '\"' || p_name || '\"' WHEN 2 THEN 'page ' || CAST(p_size AS VARCHAR) WHEN 3 THEN substr(p_name, 2) || '$' ELSE 'www.' || p_brand || ' (x)' END"
_CLEAN = r"""trim(regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(trim({0}), '^".*"$') AND length(trim({0})) >= 2 THEN substr(trim({0}), 2, length(trim({0})) - 2) ELSE trim({0}) END), '\s*\(.*?\)\s*$', ''), '[$%]', '', 'g'))"""
_ANLS = "CASE WHEN greatest(length(p), length(g)) = 0 THEN 1.0 WHEN 1 - levenshtein(p, g) / greatest(length(p), length(g)) > 0.5 THEN 1 - levenshtein(p, g) / greatest(length(p), length(g)) ELSE 0.0 END"


def rule_score_str(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", F.round(M.score_str(_SPARK(_STR_GOLD), _SPARK(_STR_PRED)), 6).alias("score"))


RULE_SCORE_STR = rf"""SELECT p_partkey, round(CASE WHEN lower(trim(rg)) = 'not answerable' THEN CAST(p = 'not answerable' AS INT) WHEN p = 'not answerable' THEN 0.0
WHEN regexp_matches(g, '^(https?://|www\.)|\.(pdf|png|jpg|csv|ipynb|py)$|^page \d+|^\d{{4}}-\d{{2}}-\d{{2}}$|@') THEN CAST(g = p AS INT) ELSE {_ANLS} END, 6) AS score
FROM (SELECT p_partkey, rg, {_CLEAN.format("rg")} AS g, {_CLEAN.format("rp")} AS p FROM (SELECT p_partkey, {_STR_GOLD} AS rg, {_STR_PRED} AS rp FROM part))"""

_LIST_PRED = "CASE p_partkey % 4 WHEN 0 THEN '[''' || p_brand || ''', ''' || p_type || ''']' WHEN 1 THEN p_type || ' and ' || p_brand WHEN 2 THEN '[1, 2.0]' ELSE p_brand END"


def rule_score_list(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select("p_partkey", F.expr("p_brand || ', ' || p_type").alias("gold"), F.expr(_LIST_PRED).alias("pred"))
    rows = rows.withColumn("g", parse_list("gold")).withColumn("p", parse_list("pred"))
    return rows.select("p_partkey", F.round(M.score_list(F.col("gold"), F.col("pred"), F.col("g"), F.col("p")), 6).alias("score"))


# the lists of this query in SQL: quoted items, or what stands between separators; tests hold the parser against more
_ITEM = "(1 - levenshtein(pl[i], gl[i]) / greatest(length(pl[i]), length(gl[i]), 1))"
RULE_SCORE_LIST = f"""WITH x AS (SELECT p_partkey, lower(p_brand || ', ' || p_type) AS g, lower({_LIST_PRED}) AS p FROM part),
l AS (SELECT p_partkey, list_sort(list_transform(string_split_regex(g, ',|;| and '), lambda z: trim(z))) AS gl, list_sort(list_transform(CASE WHEN contains(p, chr(39)) THEN regexp_extract_all(p, chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1) ELSE string_split_regex(trim(p, '[]'), ',|;| and ') END, lambda z: trim(z))) AS pl FROM x)
SELECT p_partkey, CASE WHEN len(gl) <> len(pl) THEN 0.0 ELSE round(list_min(list_transform(range(1, len(gl) + 1), lambda i: CASE WHEN {_ITEM} > 0.5 THEN {_ITEM} ELSE 0.0 END)), 6) END AS score FROM l"""

_REPLY = "CASE p_partkey % 5 WHEN 0 THEN 'The answer is: ' || p_name || '.' WHEN 1 THEN 'Final answer: ' || p_brand || ' M.A.' WHEN 2 THEN 'It does not contain ' || p_name WHEN 3 THEN '  ' || p_name || '...' ELSE 'answer is ' || p_type END"


def extract_answer(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", X.extract_answer(F.expr(_REPLY)).alias("answer"))


EXTRACT_ANSWER = rf"""WITH x AS (SELECT p_partkey, trim({_REPLY}) AS s FROM part), y AS (SELECT p_partkey, s, trim(regexp_replace(s, '(?i)^(the )?(answer|final answer)( is)?[:\s]+', '')) AS b FROM x)
SELECT p_partkey, CASE WHEN regexp_matches(s, '(?i)not answerable|cannot be answered|does not contain|no information') THEN 'Not answerable' WHEN regexp_matches(b, '(?:^|[\s.])[A-Za-z]\.$') THEN b ELSE regexp_replace(b, '\.+$', '') END AS answer FROM y"""

_CONTENT = "CASE p_partkey % 4 WHEN 0 THEN 'hm</think> ' || p_name || '<|im_end|>' WHEN 1 THEN 'hm' || chr(10) || chr(10) || chr(10) || p_name WHEN 2 THEN 'still thinking about ' || p_name ELSE '<|endoftext|>' || p_name END"


def clean_reply(spark: SparkSession, d: str) -> DataFrame:
    got = X.clean_reply(F.expr(_CONTENT), F.expr("p_partkey % 3 > 0"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'length' ELSE 'stop' END"))
    return A.table(spark, d, "part").select("p_partkey", got["answer"].alias("answer"), got["truncated"].alias("truncated"))


CLEAN_REPLY = f"""WITH x AS (SELECT p_partkey, replace(replace({_CONTENT}, '<|im_end|>', ''), '<|endoftext|>', '') AS s FROM part)
SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN s WHEN p_partkey % 7 = 0 THEN '' WHEN contains(s, '</think>') THEN string_split(s, '</think>')[-1] WHEN contains(s, chr(10) || chr(10) || chr(10)) THEN string_split(s, chr(10) || chr(10) || chr(10))[-1] ELSE '' END) AS answer,
p_partkey % 3 > 0 AND (p_partkey % 7 = 0 OR NOT (contains(s, '</think>') OR contains(s, chr(10) || chr(10) || chr(10)))) AS truncated FROM x"""

_VERDICT = "CASE p_partkey % 3 WHEN 0 THEN 'Extracted answer: ' || p_name || chr(10) || 'Verdict: [correct]' || chr(10) || 'Reason: same words' WHEN 1 THEN 'verdict:  INCORRECT' || chr(10) || 'Extracted answer:  ' || p_brand || ' ' ELSE 'no idea about ' || p_name END"


def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    got = X.parse_verdict(F.expr(_VERDICT))
    return A.table(spark, d, "part").select("p_partkey", *[got[c].alias(c) for c in ("answer", "verdict", "reason")])


PARSE_VERDICT = rf"""WITH x AS (SELECT p_partkey, {_VERDICT} AS s FROM part), y AS (SELECT *, lower(regexp_extract(s, '(?i)Verdict:\s*\[?\s*(Correct|Incorrect)', 1)) AS v FROM x)
SELECT p_partkey, CASE WHEN regexp_matches(s, 'Extracted answer:\s*(.+)') THEN trim(regexp_extract(s, 'Extracted answer:\s*(.+)', 1)) END AS answer, CASE WHEN v <> '' THEN upper(v[1]) || v[2:] END AS verdict, trim(regexp_extract(s, 'Reason:\s*(.+)', 1)) AS reason FROM y"""


def pick_score(spark: SparkSession, d: str) -> DataFrame:
    """Labels as scores: quality by the rules, toxic by the model, the extraction in between; every third answer was not judged, every seventh call failed."""
    got = M.pick_score(F.expr("element_at(array('judge', 'extract', 'both'), cast(doc_id % 3 + 1 as int))"), F.col("quality").cast("double"), F.expr("doc_id % 4 > 0"), F.expr("doc_id % 7 = 0"), F.expr("CASE WHEN doc_id % 5 > 0 THEN cast(toxic as double) END"), F.lit(0.5))
    return A.table(spark, d, "labels").select("doc_id", got["score"].alias("score"), got["source"].alias("source"))


PICK_SCORE = """WITH x AS (SELECT doc_id, quality::DOUBLE AS r, ['judge', 'extract', 'both'][doc_id % 3 + 1] AS m, doc_id % 4 > 0 AS judged, doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 5 > 0 THEN toxic::DOUBLE END AS j FROM labels),
y AS (SELECT *, CASE WHEN judged AND NOT failed AND m IN ('judge', 'both') AND j IS NOT NULL THEN 'llm_judge' WHEN judged AND NOT failed AND m IN ('extract', 'both') THEN 'llm_extraction+rules' WHEN NOT judged THEN 'rules' ELSE 'rules_fallback' END AS source FROM x)
SELECT doc_id, CASE source WHEN 'llm_judge' THEN j WHEN 'llm_extraction+rules' THEN 0.5 ELSE r END AS score, source FROM y"""


QUERIES = (anls_scores, token_f1_scores, exact_match_scores, float_equality, rule_score_int, rule_score_float, rule_score_str, rule_score_list, extract_answer, clean_reply, parse_verdict, pick_score)
ORACLES = {f.__name__: globals().get(f.__name__.upper()) for f in QUERIES}
