import pytest
from pyspark.sql import functions as F

from recollex.functions import json as js
from recollex.functions import text as tx
from recollex.functions import times as ti


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "query,want",
    [("张伟 at cafe，a", ["张", "伟", "at", "cafe"]), ("abc张", ["张"]), ("a b", []), ("", []), (None, []), ("the the cat？", ["the", "cat"]), ("x　yy", ["yy"])],
)
def test_keywords(spark, query, want):
    assert one(spark, query, tx.keywords) == want


def test_entities(spark):
    assert one(spark, "一二三四五六七八九十甲乙丙 New York met Ann", tx.entities) == ["一二三四五六", "七八九十甲乙", "New York", "Ann"]


def test_content_words_and_jaccard(spark):
    assert one(spark, "This Other castle 没有 城堡", tx.content_words) == ["castle", "城堡"]
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_fold_strips_all_white_space(spark):
    assert one(spark, "　\t Ab c\n", tx.fold) == "ab c"


DAYS = {0: ("刚刚", "今天", "刚刚", "今天"), 1: ("昨天", "昨天", "刚刚", "今天"), 6: ("6天前", "前几天", "6天前", "本周"), 7: ("1周前", "上周", "7天前", "本周"), 29: ("4周前", "上周", "4周前", "本月"), 30: ("1个月前", "上个月", "4周前", "本月"), 364: ("12个月前", "半年前", "12个月前", "去年"), 365: ("1年前", "去年", "12个月前", "去年"), 800: ("2年前", "去年", "2年前", "多年前")}


@pytest.mark.parametrize("days", DAYS)
def test_time_vocabularies(spark, days):
    assert tuple(one(spark, days, f, "int") for f in (ti.time_desc, ti.fuzzy_time, ti.relative_designed, ti.fuzzy_designed)) == DAYS[days]


@pytest.mark.parametrize("time,want", [("2024", 20240000), ("202405", 20240500), ("20240501", 20240501), ("2024-05-01", 20240000), ("383年", 383), ("", 0), (None, 0), ("1" * 20, 0), ("202405011230", 20240501), ("２０２４", 20240000), ("none", 0)])
def test_sortable(spark, time, want):
    assert one(spark, time, ti.sortable) == want


@pytest.mark.parametrize("text,want", [("许久之后又之后", 9999), ("十一个月后", 30), ("后来", 1), ("today", None), (None, None)])
def test_relative_offset(spark, text, want):
    assert one(spark, text, ti.relative_offset) == want


@pytest.mark.parametrize(
    "text,want",
    [('```json\n{"a":1}\n```', '{"a":1}'), ('so {"a":{"b":2}} ends', '{"a":{"b":2}}'), ("[1,2]", "[1,2]"), ("see [1,2] there", "[1,2]"), ('x [{"a":1}] y', '{"a":1}'), ("junk", "{}"), ("", "{}"), (None, "{}")],
)
def test_extract_json(spark, text, want):
    assert one(spark, text, lambda c: js.extract_json(c).cast("string")) == want


def test_json_lines(spark):
    assert one(spark, 'head\n {"a":1},\n{bad\n{"b":2}', js.json_lines) == ['{"a":1}', '{"b":2}']
    got = one(spark, '0: {"a":1}\n5: {"b":2}\n1: {bad}\nx', lambda c: js.indexed_lines(c, 5))
    assert [(r["index"], r["object"]) for r in got] == [(0, '{"a":1}')]


def test_suffix(spark):
    df = spark.createDataFrame([("t", "p", None)], "c string, p string, q string").select(tx.with_place(F.col("c"), F.col("p"), F.col("q")).alias("x"))
    assert df.first()[0] == "t [人物:p 地点:]" and df.select(tx.without_place(F.col("x"))).first()[0] == "t"
