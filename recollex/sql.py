"""SQL over a database: views of its tables and reports, and table functions that search it.

    names = register(spark, memories, queries)
    spark.sql("select * from keyword_search('who bought the boat?', 20)")
    spark.sql("select * from bm25_search('who bought the boat?', 20)")
    spark.sql("select metric, key, value from evaluation_report where dimension = 'retrieval'")
    spark.sql("select check, status from quality_report where status <> 'PASS'")

Functions and views are temporary.  The stored contents and the index are written once, when they are registered; reports are computed
when ``reports`` is true, as they ask the whole database.  ``keyword_search`` scans the store for one question; ``bm25_search`` joins the
postings of its words only.  For a table of questions use ``operators.search`` and ``operators.ranked``, which answer all of them in one job.

Cases: a null or empty question has no results; ties go to the entry stored first; k below 1 gives no rows; views that are there
already are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.text import CJK, QUERY_PUNCTUATION
from recollex.operators import evaluate, quality, ranked
from recollex.session import written
from recollex.sources.database import entries, store

_BLANKS = " " * len(QUERY_PUNCTUATION)

KEYWORDS = rf"""CREATE OR REPLACE TEMPORARY FUNCTION keywords(question STRING) RETURNS ARRAY<STRING>
RETURN array_distinct(flatten(transform(split(translate(coalesce(question, ''), '{QUERY_PUNCTUATION}', '{_BLANKS}'), r'(?U)\s+'),
  t -> CASE WHEN t RLIKE r'[{CJK}]' THEN regexp_extract_all(t, r'([{CJK}])', 1) WHEN length(t) >= 2 THEN array(t) ELSE CAST(array() AS ARRAY<STRING>) END)))"""

KEYWORD_SEARCH = """CREATE OR REPLACE TEMPORARY FUNCTION keyword_search(question STRING, k INT) RETURNS TABLE (rank INT, memory_id STRING, score DOUBLE, content STRING)
RETURN SELECT rank, memory_id, score, content FROM (
  SELECT memory_id, content, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM (
    SELECT memory_id, content, ord, try_divide(size(filter(keywords(question), w -> contains(content, w))), size(keywords(question))) AS score FROM recollex_store)
  WHERE score > 0) WHERE rank <= k"""

TERMS = rf"""CREATE OR REPLACE TEMPORARY FUNCTION search_terms(question STRING) RETURNS ARRAY<STRING>
RETURN array_distinct(regexp_extract_all(lower(coalesce(question, '')), r'([{CJK}]|[^\s{CJK}\p{{Punct}}]+)', 1))"""

BM25_SEARCH = """CREATE OR REPLACE TEMPORARY FUNCTION bm25_search(question STRING, k INT) RETURNS TABLE (rank INT, memory_id STRING, score DOUBLE)
RETURN SELECT rank, memory_id, score FROM (
  SELECT memory_id, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM (
    SELECT memory_id, ord, round(sum(impact), 9) AS score FROM recollex_postings WHERE array_contains(search_terms(question), term) GROUP BY memory_id, ord))
  WHERE rank <= k"""


def register_store(spark: SparkSession, stored: DataFrame, index: bool = True, copy: bool = True) -> list[str]:
    """Searches over stored(memory_id, content, ord); the names of the functions.

    ``bm25_search`` needs the ``index``; without a ``copy`` each search reads what ``stored`` is made of, which suits a table as it is.
    """
    stored = stored.select("memory_id", "content", "ord")
    (written(stored, "sql-store") if copy else stored).createOrReplaceTempView("recollex_store")
    if index:
        found = ranked.build(spark.table("recollex_store"))
        whole = found.postings.join(found.words.select("term", "idf"), "term").withColumn("impact", F.col("impact") * F.col("idf"))
        whole.createOrReplaceTempView("recollex_postings")
    for statement in (KEYWORDS, KEYWORD_SEARCH, *((TERMS, BM25_SEARCH) if index else ())):
        spark.sql(statement)
    return ["keyword_search", "keywords", *(("bm25_search", "search_terms") if index else ())]


def register(spark: SparkSession, mems: DataFrame, queries: DataFrame, reports: bool = True) -> list[str]:
    """Views memories and queries, the searches, and with ``reports`` the views evaluation_report and quality_report; their names."""
    mems.createOrReplaceTempView("memories")
    queries.createOrReplaceTempView("queries")
    names = ["memories", "queries", *register_store(spark, store(entries(mems)))]
    if reports:
        written(evaluate.evaluate(mems, queries), "sql-evaluation", few=True).createOrReplaceTempView("evaluation_report")
        written(quality.check(mems, queries), "sql-quality", few=True).createOrReplaceTempView("quality_report")
        names += ["evaluation_report", "quality_report"]
    return names
