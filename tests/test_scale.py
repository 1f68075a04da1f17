"""Hot keys, very long tokens, streams that run again, links that leave a corpus, and the guard of the entry."""

import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from recollex.operators import chains, clean, mining, search
from recollex.plans import catalogue
from recollex.session import settings
from recollex.sources import corpus
from recollex.streaming import flows


def pairs(spark, contents, words):
    s = spark.createDataFrame([(str(i), c, i) for i, c in enumerate(contents)], "memory_id string, content string, ord long")
    got = search.matched_pairs(s, spark.createDataFrame([(w,) for w in words], "word string"))
    return sorted((int(r["memory_id"]), r["word"]) for r in got.collect())


def contained(contents, words):
    return sorted((i, w) for i, c in enumerate(contents) for w in set(words) if c and w and w in c)


def test_words_in_any_token(spark):
    r = random.Random(3)
    contents = [" ".join("".join(r.choice("abc张伟😀") for _ in range(r.choice([1, 2, 3, 5, 130, 300]))) for _ in range(6)) for _ in range(40)] + [None, "", " \t "]
    whole = [t for c in contents[:40] for t in c.split()]
    words = ["a", "ab", "伟😀", "abca", "zz", *["".join(r.choice("abc张") for _ in range(r.choice([3, 4]))) for _ in range(30)], *[w[k : k + n] for w in whole[:60] for k, n in ((0, 63), (1, 64), (40, 65), (5, 100))]]
    assert pairs(spark, contents, words) == contained(contents, words)


def test_one_token_of_a_megabyte_and_unspaced_text(spark):
    r = random.Random(4)
    blob, page = "".join(r.choice("abcdefgh") for _ in range(1 << 20)), "".join(r.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(20_000))
    words = [blob[777_777:777_790], blob[-200:], page[15_000:15_002], page[:70], "nowhere"]
    assert pairs(spark, [blob, page], words) == contained([blob, page], words)


def test_holding(spark):
    s = spark.createDataFrame([("a", "x the quick brown fox y", 0), ("b", "quick fox brown the", 1)], "memory_id string, content string, ord long")
    asked = spark.createDataFrame([("p", "the quick brown"), ("q", ""), ("r", None)], "probe string, text string")
    assert [tuple(x) for x in search.holding(s, asked).collect()] == [("p", "a")]


def test_cosine_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, i, [r.random() - 0.5 for _ in range(8)]) for i in range(60)] + [(60, 60, [0.0] * 8)]
    v = spark.createDataFrame(rows, "memory_id long, ord long, vector array<float>")
    asked = v.select(F.col("memory_id").alias("probe"), "vector").filter("probe < 20")
    one = sorted(map(tuple, search.cosine_search(v, asked, 5).collect()))
    monkeypatch.setattr(search, "BLOCK", 6)
    assert sorted(map(tuple, search.cosine_search(v, asked, 5).collect())) == one and len(one) == 100


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "Same  text" if i % 3 == 0 else f"text {i}", None) for i in range(600)] + [(600, None, "x"), (601, "", "y")]
    got = mining.exact_dedup(spark.createDataFrame(rows, "ord long, content string, other string"))
    assert sorted(r["ord"] for r in got.collect()) == sorted({0, 600} | {i for i in range(600) if i % 3})


def test_neighbours_of_a_hot_key(spark):
    rows = [(i, f"m{i}", "hot" if i % 3 else f"k{i % 7}") for i in range(700)] + [(700, "m700", None)]
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = chains.neighbour_links(spark.createDataFrame(rows, "ord long, memory_id string, key string"), ["key"]).collect()
    want = set()
    for k in {x[2] for x in rows if x[2]}:
        own = [x[1] for x in rows if x[2] == k]
        want |= {(own[i], own[i + d]) for i in range(len(own)) for d in range(1, 5) if i + d < len(own)}
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)


def test_upsert_runs_again(spark, tmp_path):
    schema, folder, n = "k string, v string, seq int", str(tmp_path / "store"), 0
    stream = lambda: flows.upsert(flows.files(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema), "k", "v", ["seq"], folder)

    def add(rows):
        nonlocal n
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        n += 1

    add([("a", "1", 1), ("b", "1", 2)])
    held = lambda: {r["k"]: r["content"] for r in stream().collect()}
    assert held() == {"a": "1", "b": "1"}
    assert held() == {"a": "1", "b": "1"} and held() == {"a": "1", "b": "1"}
    add([("a", "2", 3), ("c", "1", 4)])
    assert held() == {"a": "2", "b": "1", "c": "1"} and held() == {"a": "2", "b": "1", "c": "1"}
    add([("c", "9", 5)])
    assert held() == {"a": "2", "b": "1", "c": "9"}
    log = os.path.join(folder, "store", "log")
    assert sorted(os.listdir(log)) == ["batch=0", "batch=1", "batch=2"]
    assert len([x for x in os.listdir(os.path.join(log, "batch=2")) if x.startswith("bucket=")]) == 1  # one key, one bucket


def test_links_that_leave_a_corpus(spark, tmp_path):
    inside, outside = tmp_path / "corpus", tmp_path / "outside"
    for d in (inside / "a b+c", outside / "deep"):
        d.mkdir(parents=True)
    (inside / "a b+c" / "own.md").write_text("own")
    (outside / "secret.md").write_text("secret")
    (outside / "deep" / "more.md").write_text("more")
    assert sorted(r["text"] for r in corpus.scan(spark, str(inside)).collect()) == ["own"]
    (inside / "a b+c" / "link 1+.md").symlink_to(outside / "secret.md")
    (inside / "folder").symlink_to(outside / "deep")
    assert sorted(r["text"] for r in corpus.scan(spark, str(inside)).collect()) == ["own"]


def test_cleaning_compares_content_first(spark):
    m = spark.createDataFrame([("own", [("v1", "s", "told")]), (None, [("v1", "s", "told")]), (None, None)], "content string, versions array<struct<version_id:string,style:string,content:string>>")
    assert [r[0] for r in m.select(clean.own_text(m)).collect()] == ["own", "told", ""]


@pytest.mark.parametrize("missing", ["tiktoken", "zstandard", "recollex.llm"])
def test_entry_without_the_subpackage_or_its_libraries(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    n, own, known = out.stdout.split()
    assert int(n) > 50 and own == "False" and known == "True"


def test_spans_round_to_the_nearest_second(spark, tmp_path):
    """DuckDB's cast rounds seconds, halves to even: the last half second of a span is the next one's (F9)."""
    times = ["2024-01-01 00:00:00", "2024-01-10 23:59:59.4", "2024-01-10 23:59:59.5", "2024-01-10 23:59:59.7", "2024-01-20 23:59:59.9", "2024-01-25 12:00:00.5"]
    rows = spark.createDataFrame([(i, t, i, "view", float(i)) for i, t in enumerate(times)], "event_id long, t string, user_id long, event_type string, value double")
    rows.withColumn("ts", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    sql = catalogue.load()[1]["statistics_by_range"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.load()[0]["statistics_by_range"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(sql).fetchall())
