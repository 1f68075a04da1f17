"""Queries that are SQL statements over registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollex import sql
from recollex.plans.catalogue import query
from recollex.plans.retrieval import _SEARCH, _STATS, _documents
from recollex.session import table


def _one(spark: SparkSession, sf_dir: str, index: bool) -> str:
    """The first item's text: the one question that the statements ask of all documents, which are read where they are."""
    sql.register_store(spark, _documents(spark, sf_dir), index, copy=False)
    row = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()
    return row["text"] if row else ""


@query(f"with {_SEARCH} select rank, doc_id, score from ranked where item_id = (select min(item_id) from benchmark)")
def sql_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select cast(rank as bigint) as rank, cast(memory_id as bigint) as doc_id, score from keyword_search(:question, 20)", {"question": _one(spark, sf_dir, index=False)})


@query(f"""with {_STATS}, len as (select doc_id, sum(tf) as len from d group by doc_id), mean as (select sum(len) / any_value(n) as mean from len, n),
idf as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from d, n group by term), a as (select distinct term from q where item_id = (select min(item_id) from benchmark)),
s as (select doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 9) as score from d join a using (term) join idf using (term) join len using (doc_id), mean group by doc_id)
select row_number() over (order by score desc, doc_id) as rank, doc_id, round(score, 6) as score from s qualify rank <= 20""")
def sql_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select cast(rank as bigint) as rank, cast(memory_id as bigint) as doc_id, round(score, 6) as score from bm25_search(:question, 20)", {"question": _one(spark, sf_dir, index=True)})
