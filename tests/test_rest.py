"""Small operators that no query runs."""

import json

from pyspark.sql import functions as F

from recollex.functions.json import bounded
from recollex.operators.extract import objects
from recollex.operators.prompts import shuffled
from recollex.plans.structure import _flawed
from recollex.plans.roles import rich
from recollex.operators import quality
from recollex.sources.database import load, split_sample

SF = "/root/testdata/sf0.001"


def test_split_sample_writes_both_parts(spark, tmp_path):
    doc = {"memories": [{"memory_id": "m1", "content": "a"}, {"memory_id": "m2", "content": None}], "queries": [{"query_id": "q1", "query_text": "x", "expected_answer": {"k": 1}}]}
    (tmp_path / "db.json").write_text(json.dumps(doc))
    split_sample(load(spark, str(tmp_path / "db.json")), str(tmp_path / "out"))
    mems = spark.read.json(str(tmp_path / "out" / "db"))
    assert sorted((r.memory_id, r.content) for r in mems.collect()) == [("m1", "a"), ("m2", None)]
    one = spark.read.json(str(tmp_path / "out" / "queries")).first()
    assert one.query_id == "q1" and json.loads(one.expected_answer) == {"k": 1}


def test_shuffled_is_an_order_of_its_own(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,), (3,)], "k int")
    once, again, other = ([r.k for r in shuffled(df.repartition(n), "k", seed).collect()] for n, seed in ((3, 1), (5, 1), (3, 2)))
    assert once == again != other and sorted(map(str, once)) == sorted(map(str, other)) and once != sorted(once, key=str)
    assert once.index(3) + 1 == len(once) - 1 - once[::-1].index(3)  # equal keys stand together


def test_bounded_texts_and_answers(spark):
    df = spark.createDataFrame([("abc",), ("abcd",), (None,)], "t string")
    assert [r[0] for r in df.select(bounded(F.col("t"), 3)).collect()] == ["abc", None, None]
    long = spark.createDataFrame([('{"a": 1}\n' + " " * (2 << 20),), ('{"a": 1}',)], "t string")
    assert [len(r[0]) for r in long.select(objects(F.col("t"))).collect()] == [0, 1]


def test_given_tables_fire_the_rules_on_chains(spark):
    rules = {r.rule for r in quality.detailed(rich(spark, SF), _flawed(spark, SF)).select("rule").distinct().collect()}
    assert {"chain_first_verb", "chain_gap", "answer_member"} <= rules


def test_negatives_of_many_names_are_drawn(spark):
    from recollex.operators import questions as qu

    names = lambda k, n: spark.createDataFrame([(f"{k}{i:04d}",) for i in range(n)], f"{'l' if k == 'p' else 'r'} string")
    words = ["游泳", "滑雪", "唱歌"]
    few = qu._combined(names("p", 3), names("c", 4), words, 10, 1).collect()
    assert sorted((x.l, x.r, x.w) for x in few) == sorted((f"p{i:04d}", f"c{j:04d}", w) for i in range(3) for j in range(4) for w in words)
    many = [(x.l, x.r, x.w) for x in qu._combined(names("p", 700), names("c", 900), words, 50, 1).collect()]
    assert 50 <= len(set(many)) == len(many) <= 200 and len({p for p, _, _ in many}) > 100 and {w for _, _, w in many} == set(words)
    assert qu._combined(names("p", 0), names("c", 9), words, 50, 1).collect() == []
