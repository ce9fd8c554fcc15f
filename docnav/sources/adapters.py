"""The driver's tables as documents, pages, questions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores if the scan has fewer splits than there are cores (one small file); a large scan is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, page, text): line i of a document is its page i, from 1."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("corpus_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return docs.select("corpus_id", (F.col("i") + 1).alias("page"), "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, page, text): turn i of a conversation is its page i + 1."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("corpus_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def first_words(c, n: int):
    return F.concat_ws(" ", F.slice(F.split(c, " "), 1, n))


def document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, qid, query): each document is asked the first words of one benchmark item, chosen by its id."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), first_words(F.col("text"), 12).alias("query"))
    n = items.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id")).join(F.broadcast(n)).withColumn("qid", F.col("corpus_id") % F.col("n"))
    return docs.join(items, "qid").select("corpus_id", "qid", "query")


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, qid, query): each conversation is asked the first words of its first turn (qid 0) and of its last (qid 1)."""
    c = table(spark, sf_dir, "conversations")
    ends = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return ends.select(F.col("conv_id").alias("corpus_id"), F.posexplode(F.array(first_words(F.col("a"), 6), first_words(F.col("b"), 6))).alias("qid", "query"))


def conversation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, section_id, ord, start_page, end_page): two pages each."""
    p = conversation_pages(spark, sf_dir).withColumn("ord", F.floor((F.col("page") - 1) / 2).cast("int"))
    return p.groupBy("corpus_id", "ord").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page")).select("corpus_id", F.concat(F.lit("S"), (F.col("ord") + 1).cast("string")).alias("section_id"), "ord", "start_page", "end_page")


def captioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, page, text): conversation turns turned into captions, mentions and prose by their number, as no table has any."""
    w = lambda n: F.element_at(F.split("text", " "), n)
    n = F.col("page").cast("string")
    text = (
        F.when(F.col("page") % 3 == 1, F.concat(F.lit("Figure "), n, F.lit(": "), F.lit("view of "), F.lower(w(1)), F.lit("\nas Table "), n, F.lit(" shows")))
        .when(F.col("page") % 3 == 2, F.concat(F.lit("**Table "), n, F.lit(". counts of things**\nsee Fig. "), F.lit("1 and figure 7"))).otherwise(F.concat(F.lit("## plain prose\nbut figure "), n, F.lit(" is named here")))
    )
    return conversation_pages(spark, sf_dir).select("corpus_id", "page", text.alias("text"))


def indexed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as indexed pages: captions and mentions of ``captioned_pages``, the first words as summary, the role as keyword, all of it as text."""
    from docnav.operators.captions import page_visuals

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("corpus_id"), (F.col("turn") + 1).cast("int").alias("page"), "role", F.col("text").alias("body"))
    v = page_visuals(captioned_pages(spark, sf_dir).withColumnRenamed("corpus_id", "doc_id").withColumnRenamed("text", "md")).withColumnRenamed("doc_id", "corpus_id")
    both = v.join(c, ["corpus_id", "page"])
    return both.select(
        "corpus_id", "page", F.concat(F.lit("Turn "), F.col("page").cast("string")).alias("title"), first_words(F.col("body"), 8).alias("summary"), F.array("role").alias("keywords"), "figures", "tables", "mentions_figures", "mentions_tables",
        F.concat("md", F.lit("\n"), "body").alias("md"), "has_visual_elements",
    )


def nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, section_id, ord, depth, title, start_page, end_page): the whole conversation, and in it sections of two pages each."""
    s = conversation_sections(spark, sf_dir).select("corpus_id", F.concat(F.lit("S1."), F.substring("section_id", 2, 9)).alias("section_id"), (F.col("ord") + 1).alias("ord"), F.lit(1).alias("depth"), F.concat(F.lit("Part "), (F.col("ord") + 1).cast("string")).alias("title"), "start_page", "end_page")
    whole = s.groupBy("corpus_id").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    return s.union(whole.select("corpus_id", F.lit("S1").alias("section_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.lit("Conversation").alias("title"), "start_page", "end_page"))


def locate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, question_id, question, queries): a question with references and the first words of a conversation, and its last words as a further query."""
    q = conversation_questions(spark, sf_dir)
    two = q.groupBy("corpus_id").agg(F.max(F.when(F.col("qid") == 0, F.col("query"))).alias("a"), F.max(F.when(F.col("qid") == 1, F.col("query"))).alias("b"))
    asked = F.when(F.col("corpus_id") % 3 == 0, F.concat("a", F.lit(" in Figure 1 and table 2"))).when(F.col("corpus_id") % 3 == 1, F.concat("a", F.lit(", see fig. 7"))).otherwise(F.col("a"))
    return two.select("corpus_id", F.lit(0).alias("question_id"), asked.alias("question"), F.array("b").alias("queries"))


# The same adapters for the SQL side.
DOCUMENT_PAGES = "SELECT doc_id AS corpus_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
CONVERSATION_PAGES = "SELECT conv_id AS corpus_id, CAST(turn + 1 AS INT) AS page, text FROM conversations"
DOCUMENT_QUESTIONS = "SELECT d.doc_id AS corpus_id, b.item_id AS qid, array_to_string(string_split(b.text, ' ')[1:12], ' ') AS query FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"
CONVERSATION_QUESTIONS = "SELECT conv_id AS corpus_id, unnest([0, 1]) AS qid, unnest([array_to_string(string_split(a, ' ')[1:6], ' '), array_to_string(string_split(b, ' ')[1:6], ' ')]) AS query FROM (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY conv_id)"
CONVERSATION_SECTIONS = "SELECT corpus_id, 'S' || CAST(ord + 1 AS VARCHAR) AS section_id, ord, min(page) AS start_page, max(page) AS end_page FROM (SELECT *, (page - 1) // 2 AS ord FROM (" + CONVERSATION_PAGES + ")) GROUP BY corpus_id, ord"
CAPTIONED_PAGES = (
    "SELECT corpus_id, page, CASE page % 3 WHEN 1 THEN 'Figure ' || page || ': view of ' || lower(string_split(text, ' ')[1]) || chr(10) || 'as Table ' || page || ' shows'"
    " WHEN 2 THEN '**Table ' || page || '. counts of things**' || chr(10) || 'see Fig. 1 and figure 7' ELSE '## plain prose' || chr(10) || 'but figure ' || page || ' is named here' END AS text FROM (" + CONVERSATION_PAGES + ")"
)
INDEXED_PAGES = f"""SELECT p.corpus_id, p.page, 'Turn ' || p.page AS title, array_to_string(string_split(c.text, ' ')[1:8], ' ') AS summary, c.role, p.text || chr(10) || c.text AS md,
CASE WHEN p.page % 3 = 1 THEN string_split(p.text, chr(10))[1] ELSE '' END AS figures, CASE WHEN p.page % 3 = 2 THEN 'Table ' || p.page || ': counts of things' ELSE '' END AS tables FROM ({CAPTIONED_PAGES}) p JOIN conversations c ON c.conv_id = p.corpus_id AND c.turn + 1 = p.page"""
NESTED_SECTIONS = f"""SELECT corpus_id, 'S1.' || section_id[2:] AS section_id, ord + 1 AS ord, 1 AS depth, 'Part ' || (ord + 1) AS title, start_page, end_page FROM ({CONVERSATION_SECTIONS})
UNION ALL SELECT corpus_id, 'S1', 0, 0, 'Conversation', min(start_page), max(end_page) FROM ({CONVERSATION_SECTIONS}) GROUP BY corpus_id"""
LOCATE_QUERIES = f"""SELECT corpus_id, 0 AS qno, CASE corpus_id % 3 WHEN 0 THEN query || ' in Figure 1 and table 2' WHEN 1 THEN query || ', see fig. 7' ELSE query END AS query FROM ({CONVERSATION_QUESTIONS}) WHERE qid = 0
UNION ALL SELECT a.corpus_id, 1, trim(a.query) FROM ({CONVERSATION_QUESTIONS}) a JOIN ({CONVERSATION_QUESTIONS}) b ON a.corpus_id = b.corpus_id AND b.qid = 0 WHERE a.qid = 1 AND (a.corpus_id % 3 < 2 OR trim(a.query) <> trim(b.query))"""
