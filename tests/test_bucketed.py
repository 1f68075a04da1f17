import os
import random

from pyspark.sql import functions as F

from recollex.operators.evaluate import retrieval
from recollex.sources.bucketed import BucketedStore


def make(spark, tmp_path, deep=3):
    return BucketedStore(spark, ("string", "string", "bigint"), str(tmp_path / "store"), buckets=4, deep=deep)


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, content string, sequence long")


def test_equal_to_one_fold_over_all_batches(spark, tmp_path):
    r, store, every = random.Random(1), make(spark, tmp_path), []
    compacted = []
    for number in range(6):
        rows = [(r.choice(["a", "b", "c", "d", "e", "f", None, f"k{r.randint(0, 30)}"]), r.choice(["x", "y", None]), r.randint(0, 200)) for _ in range(r.choice([0, 5, 40]) if number else 30)]
        every += rows
        compacted += store.upsert(frame(spark, rows), number)
    want = {}
    for k, c, s in every:
        if k is not None:
            last, first = want.get(k, ((s, c is not None, c or ""), s))
            want[k] = (max(last, (s, c is not None, c or "")), min(first, s))
    got = {x.key: (x.last, x.first) for x in store.read().collect()}
    assert got == {k: (last[0], first) for k, (last, first) in want.items()}
    assert {x.key: x.content for x in store.read().collect() if x.content is not None} == {k: last[2] for k, (last, _) in want.items() if last[1]}
    assert compacted
    asked = spark.createDataFrame([("a",), ("k3",), ("no",), (None,)], "key string")
    assert sorted(x.key for x in store.read(asked).collect()) == sorted({"a", "k3"} & set(want))
    assert store.changes(3).select("batch").distinct().count() <= 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = make(spark, tmp_path)
    store.upsert(frame(spark, [(f"k{i}", "0", i) for i in range(40)]), 0)
    for number in (1, 2):
        due = store.upsert(frame(spark, [("k1", str(number), 100 + number)]), number)
    assert len(due) == 1 and store.bases() == {due[0]: 2}
    assert [x for x in os.listdir(tmp_path / "store" / "base" / "upto=2") if x.startswith("_b=")] == [f"_b={due[0]}"]
    assert {x.key: x.content for x in store.read().collect()} == {f"k{i}": "2" if i == 1 else "0" for i in range(40)}
    assert [tuple(x) for x in store.changes(0).select("batch", "key", "content").orderBy("batch").collect()] == [(1, "k1", "1"), (2, "k1", "2")]


def test_repeated_batches_and_an_unfinished_compaction(spark, tmp_path):
    store = make(spark, tmp_path, deep=2)
    for number in (0, 1, 1):
        store.upsert(frame(spark, [("a", f"v{number}", number), ("b", "w", 0)]), number)
    assert {x.key: x.content for x in store.read().collect()} == {"a": "v1", "b": "w"}
    os.remove(tmp_path / "store" / "state" / "00000001" / "_SUCCESS")  # as if it had failed before its end
    assert store.bases() == {} and {x.key: x.content for x in store.read().collect()} == {"a": "v1", "b": "w"}
    assert sorted(store.upsert(frame(spark, []), 2)) == sorted({x.bucket for x in store.read().select(store._bucket(F.col("key")).alias("bucket")).collect()})
    assert {x.key: x.content for x in store.read().collect()} == {"a": "v1", "b": "w"}


def test_empty_store_and_report_without_queries(spark, tmp_path):
    assert make(spark, tmp_path).read().collect() == []
    q = spark.createDataFrame([], "ord long, query_type string")
    rows = {r.metric: r.value for r in retrieval(q, spark.createDataFrame([], "ord long, memory_id string"), spark.createDataFrame([], "ord long, rank int, memory_id string")).collect()}
    assert rows == {"overall_precision": 0.0, "overall_recall": 0.0}
