import hashlib
import random
import re

from recollex.llm import decontaminate as dc
from tests.llm.helpers import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()


def test_equals_brute_force(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 4, 9, 10, 11, 14])))) for i in range(12)] + [(None, "q r s"), (3, "zz yy"), (99, None)]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice("abcABCq") for _ in range(r.randint(0, 60)))) for i in range(60)]
    got = dc.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for row in got:
        ids = ",".join(row["items"])
        assert (row["n_words"], row["n_hit"], len(row["items"]), hashlib.sha256(ids.encode()).hexdigest()) == brute(row["text"], items)
        assert row["contaminated"] == (row["n_hit"] > 0)


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    bench, docs = spark.createDataFrame([(1, "the cat sat")], "item_id long, text string"), table(spark)
    one = sorted(dc.mark(docs, bench).select("doc_id", "n_hit").collect(), key=str)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert sorted(dc.mark(docs, bench).select("doc_id", "n_hit").collect(), key=str) == one


def test_awkward_rows_and_removal(spark):
    docs = table(spark, extra="hits items lang")
    bench = spark.createDataFrame([(7, "cat SAT on"), (8, None), (9, "")], "item_id long, text string")
    marked = dc.mark(docs, bench).collect()
    assert len(marked) == 10 and {r["doc_id"] for r in marked if r["contaminated"]} == {1, 5} and {r["n_words"] for r in marked if r["doc_id"] in (2, 3, 4)} == {0}
    kept = dc.decontaminate(table(spark, extra="lang"), bench, "documents")
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 6, 7, 8]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(table(spark), bench).collect()}
    assert cut[1] == "The the mat." and cut[2] is None and cut[8] == dict(table(spark).collect())[8]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.mark(table(spark).limit(0), bench).collect() == []
    assert {r["n_hit"] for r in dc.mark(table(spark), bench).collect()} == {0}
