import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollex import session
from recollex.operators import ranked, vectors
from recollex.operators.search import cosine_search
from recollex.plans.retrieval import _documents, _items, _vectors

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def slow(store, probes, model, k):
    n, tf = len(store), {m: Counter(words(c)) for m, c, _ in store}
    df, ords = Counter(t for c in tf.values() for t in c), {m: o for m, _, o in store}
    size = {m: sum(c.values()) for m, c in tf.items()}
    mean = sum(size.values()) / n
    bm = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    ti = {t: math.log((1.0 + n) / (1.0 + d)) + 1 for t, d in df.items()}
    out = {}
    for p, text in probes:
        q = {t: c for t, c in Counter(words(text)).items() if t in df}
        scores = defaultdict(float)
        for m, c in tf.items():
            for t in set(q) & set(c):
                if model == "bm25":
                    scores[m] += bm[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[m] / mean))
                else:
                    scores[m] += c[t] * ti[t] / math.sqrt(sum((x * ti[y]) ** 2 for y, x in c.items())) * q[t] * ti[t] / math.sqrt(sum((x * ti[y]) ** 2 for y, x in q.items()))
        best = sorted(scores, key=lambda m: (-round(scores[m], 9), ords[m]))[:k]
        out[p] = [(m, round(scores[m], 6)) for m in best]
    return {p: x for p, x in out.items() if x}


@pytest.mark.parametrize("model", ["bm25", "tfidf"])
@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_equals_all_scores(spark, model, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.12)), 59)] for _ in range(n))
    store = [(f"m{i}", text(r.randint(0, 40)), i) for i in range(300)] + [("none", None, 900), ("empty", "", 901)]
    store += [(f"copy{i}", "w1 w2 w59 rare", 1000 - i) for i in range(12)]
    probes = [(p, text(r.randint(1, 25))) for p in range(8)] + [(100, "unknown"), (101, None), (102, "rare w59"), (103, "w0 w0 w0 rare")]
    frame = spark.createDataFrame(store, "memory_id string, content string, ord long").withColumns({"term": F.lit("clash"), "level": F.lit(1)})
    index = ranked.build(frame, model)
    got = defaultdict(list)
    for x in ranked.search(index, spark.createDataFrame(probes, "probe long, text string"), 5).orderBy("probe", "rank").collect():
        got[x.probe].append((x.memory_id, round(x.score, 6)))
    assert dict(got) == slow(store, probes, model, 5)


def test_ranked_empty(spark):
    store = spark.createDataFrame([], "memory_id string, content string, ord long")
    assert ranked.search(ranked.build(store), spark.createDataFrame([(1, "a b")], "probe long, text string")).collect() == []


@pytest.mark.parametrize(("model", "share"), [("bm25", 0.3), ("tfidf", 0.6)])
def test_share_of_postings_read(spark, model, share):
    index = ranked.build(_documents(spark, SF), model)
    asked = ranked._asked(index, _items(spark, SF)).cache()
    blocks = ranked.kept_blocks(index, asked, ranked.thresholds(index, asked, 10)).cache()
    every, kept = blocks.agg(F.sum("n"), F.sum(F.when(F.col("kept"), F.col("n")))).first()
    assert kept < share * every
    # a common term in many entries is asked for only where candidates are left
    assert index.blocks.groupBy("term").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] <= ranked.LEVELS


@pytest.mark.parametrize("model", ["bm25", "tfidf"])
def test_postings_are_small(spark, model, tmp_path):
    ranked.build(_documents(spark, SF), model, folder=str(tmp_path))
    files = [*(tmp_path / "postings").glob("*.parquet")]
    assert sum(x.stat().st_size for x in files) < 5 * spark.read.parquet(str(tmp_path / "postings")).count()


@pytest.mark.parametrize("model", ["bm25", "tfidf"])
def test_ranked_scores_entries_where_their_postings_are(spark, tmp_path, monkeypatch, model):
    """Entries whose postings lie on two sides of a cut through a file, ties over many files; nothing but the best is shuffled (F2, F3)."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(ranked, "BROADCAST_ROWS", 20)  # rare terms meet their weights by a shuffle
    r = random.Random(5)
    text = lambda n: " ".join(f"w{min(int(r.expovariate(0.08)), 90)}" for _ in range(n))
    store = [(f"m{i}", text(r.randint(1, 60)), 1000 - i) for i in range(300)] + [(f"copy{i}", "w1 w2 w85 rare", 2000 - 7 * i % 41) for i in range(40)]
    probes = [(p, text(r.randint(1, 25))) for p in range(8)] + [(102, "rare w85"), (103, "w0 w0 w0 rare")]
    frame, asked = spark.createDataFrame(store, "memory_id string, content string, ord long").repartition(3), spark.createDataFrame(probes, "probe long, text string")
    with session.settings(spark, parquet__block__size="2000", spark__sql__files__maxPartitionBytes="3000", spark__sql__files__openCostInBytes="1"):
        index = ranked.build(frame, model, folder=f"file://{tmp_path}/index")
        got = defaultdict(list)
        for x in ranked.search(index, asked, 5).orderBy("probe", "rank").collect():
            got[x.probe].append((x.memory_id, round(x.score, 6)))
    assert any(pq.ParquetFile(x).num_row_groups > 2 for x in (tmp_path / "index/postings").glob("*.parquet"))
    assert dict(got) == slow(store, probes, model, 5)
    assert not [*(tmp_path / "recollex").glob("candidates-*")]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "memory_id long, ord long, vector array<float>")


def test_vector_index_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(8, 12))
    rows = [(i, i, [float(x) for x in base[i % 8] + 0.4 * r.normal(size=12)]) for i in range(400)]
    rows += [(1000 + i, 1000 + i, rows[0][2]) for i in range(200)]  # a third of all rows are copies
    rows += [(2000, 2000, None), (2001, 2001, [0.0] * 12), (2002, 2002, [1.0, 2.0])]
    all_ = vector_frame(spark, rows).withColumns({"cell": F.lit("clash"), "part": F.lit(0)})
    asked = all_.filter("memory_id % 50 = 0 or memory_id > 1990").select(F.col("memory_id").alias("probe"), "vector")
    index = vectors.build(all_, sample=150)
    assert index.rows.count() == 600
    told = lambda df: sorted(map(tuple, df.collect()))
    want = told(cosine_search(all_.filter("memory_id <> 2002"), asked.filter("probe <> 2002"), 7))
    assert told(vectors.exact_search(index, asked, 7, cells=1)) == want
    assert told(vectors.exact_search(index, asked, 700, cells=2)) == told(cosine_search(all_.filter("memory_id <> 2002"), asked.filter("probe <> 2002"), 700))


def test_recall_of_probed_cells(spark):
    all_, asked = _vectors(spark, SF)
    index = vectors.build(all_)
    truth = cosine_search(all_, asked, 10)
    found = vectors.recall(vectors.search(index, asked, 10), truth).first()
    assert index.rows.count() == all_.count() and found.recall >= 0.9, found
    assert index.cells.count() > 16  # a third of them is not read


def test_vector_index_of_nothing(spark):
    index = vectors.build(vector_frame(spark, [(1, 1, None)]))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "probe long, vector array<float>")
    assert vectors.exact_search(index, asked).collect() == [] and vectors.search(index, asked).collect() == []
