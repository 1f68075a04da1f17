import duckdb
import pytest
from pyspark.sql import functions as F

from recollex import sql
from recollex.functions.text import keywords, terms
from recollex.operators import evaluate, quality
from recollex.operators.search import bm25_search, keyword_search
from recollex.plans.roles import asked, records
from recollex.sources.database import entries, store

SF = "/root/testdata/sf0.001"
QUESTIONS = ["the of and", "张伟 at cafe，a", "", "zzzz nothing", "of。the"]


@pytest.fixture(scope="module")
def base(spark):
    mems, queries = records(spark, SF), asked(spark, SF)
    sql.register(spark, mems, queries)
    return mems, queries


def test_functions_cut_as_the_column_functions_do(spark, base):
    df = spark.createDataFrame([(q,) for q in [*QUESTIONS, None, "abc张 x 好"]], "q string")
    got = df.select(F.expr("keywords(q)").alias("a"), keywords(F.col("q")).alias("b"), F.expr("search_terms(q)").alias("c"), F.array_distinct(terms(F.col("q"))).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


@pytest.mark.parametrize("question", QUESTIONS)
def test_searches_equal_the_operators(spark, base, question):
    stored, probe = store(entries(base[0])), spark.createDataFrame([(1, question)], "probe int, text string")
    ask = lambda name: [tuple(r) for r in spark.sql(f"select rank, memory_id, round(score, 6) from {name}(:q, 7) order by rank", {"q": question}).collect()]
    want = lambda f: [tuple(r) for r in f(stored, probe, 7).orderBy("rank").select("rank", "memory_id", F.round("score", 6)).collect()]
    assert ask("keyword_search") == want(keyword_search)
    assert ask("bm25_search") == want(bm25_search)


def test_reports_are_views(spark, base):
    told = lambda df: sorted(map(str, df.collect()))
    assert told(spark.table("evaluation_report")) == told(evaluate.evaluate(*base))
    assert told(spark.table("quality_report")) == told(quality.check(*base))
    assert spark.sql("select * from keyword_search(null, 3)").collect() == [] and spark.sql("select * from bm25_search('the', 0)").collect() == []


def test_a_keyword_search_builds_no_index_and_copies_no_table(spark, monkeypatch):
    """(F10)"""
    from recollex import sql as module
    from recollex.plans import catalogue

    def never(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(module.ranked, "build", never)
    monkeypatch.setattr(module, "written", never)
    sf = "/root/testdata/sf0.001"
    got = catalogue.load()[0]["sql_keyword_search"](spark, sf).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert got and sorted(map(tuple, got)) == sorted(con.sql(catalogue.load()[1]["sql_keyword_search"]).fetchall())
