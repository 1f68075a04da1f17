import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from recollex.llm import jaccard_join as jj
from tests.llm.helpers import table

SCHEMA = "doc_id long, text string"


def brute(rows, k, num, den):
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(members[find(i)]) if sets[i] else rows[i][0]) for i in range(len(rows)))


def near_copies(seed, groups):
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice("UVWXYZ") + str(r.randint(0, 2))
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    return [*rows, (n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, " ".join(rows[0][1].split()).upper())]


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
@pytest.mark.parametrize("pairs,rounds,known", [(4, 8, 64), (0, 3, 2), (1 << 40, 1, 64)])
def test_equals_brute_force(spark, monkeypatch, k, num, den, pairs, rounds, known):
    monkeypatch.setattr(jj, "KNOWN", known)
    monkeypatch.setattr(jj, "OPEN_PAIRS", pairs)
    monkeypatch.setattr(jj, "MOST_ROUNDS", rounds)
    rows = near_copies(k, 25)
    got = jj.components(spark.createDataFrame(rows, SCHEMA), k, num, den).select("doc_id", "n", "component").collect()
    assert sorted(map(tuple, got)) == brute(rows, k, num, den)


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + ["changed" + str(i)] + base[i + 1 :])) for i in range(100)]
    got = jj.components(spark.createDataFrame(rows, SCHEMA), 1, 9, 10).select("component").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_awkward_rows(spark):
    got = jj.components(table(spark), 3, 9, 10).collect()
    assert {(r["doc_id"], r["component"]) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6), (7, 7), (8, 8), (None, None)}
    assert len(got) == 10 and {r["n"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}


def test_repeated_id_with_two_texts(spark):
    rows = [(1, "a b c d"), (1, "x y z w"), (2, "a b c d"), (3, "x y z w"), (4, "q r s t")]
    got = jj.components(spark.createDataFrame(rows, SCHEMA), 3, 9, 10).select("doc_id", "component").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_keep_one(spark):
    docs = table(spark, extra="n component lang")
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    twice = jj.keep_one(docs.union(docs)).filter("doc_id is not null").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert twice == 1


def test_empty_table(spark):
    assert jj.components(table(spark).limit(0)).collect() == [] and jj.keep_one(table(spark).limit(0)).collect() == []
