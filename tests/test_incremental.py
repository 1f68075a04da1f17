import random

import pytest
from pyspark.sql import functions as F

from recollex.operators.components import connected_components
from recollex.operators.incremental import NearDuplicates
from recollex.operators.mining import keep_longest, similar_links, similar_pairs


def rows(seed):
    r = random.Random(seed)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    made, out = [], []
    for i in range(180):
        words = r.sample(vocabulary, r.randint(3, 14)) if not made or r.random() < 0.4 else list(r.choice(made))
        if r.random() < 0.6:
            words = [*words[1:], r.choice(vocabulary)]
        made.append(words)
        out.append((i, " ".join(words), r.choice(["a", "a", "b"]), r.choice(["p", "q", "s", None])))
    return [*out, (500, None, "a", "p"), (501, "", "a", "q"), (502, "of it", None, "p")]


def frame(spark, data):
    return spark.createDataFrame(data, "ord long, content string, block string, person string").withColumns({"word": F.lit("clash"), "n": F.lit(0)})


@pytest.mark.parametrize("seed", [1])
def test_equal_to_a_run_over_all_after_each_batch(spark, seed):
    data, store, r = rows(seed), NearDuplicates(spark), random.Random(seed)
    r.shuffle(data)  # ords of a later batch may be lower
    links = 0
    for number, upto in enumerate((60, 120, len(data))):
        part = frame(spark, data[0 if number == 0 else (60, 120)[number - 1] : upto])
        links += store.add(part, number).count()
        so_far = frame(spark, data[:upto])
        pairs = similar_pairs(so_far)
        assert links == pairs.count()
        told = lambda df: sorted(map(tuple, df.collect()))
        assert told(store.components()) == told(connected_components(pairs, "a", "b"))
        assert told(store.kept()) == told(keep_longest(so_far, pairs).select("ord"))


def test_a_repeated_batch_changes_nothing(spark):
    data, store = rows(3), NearDuplicates(spark)
    store.add(frame(spark, data[:90]), 0)
    store.add(frame(spark, data[90:]), 1)
    before = sorted(map(tuple, store.components().collect()))
    store.add(frame(spark, data[90:]), 1)
    assert sorted(map(tuple, store.components().collect())) == before and store.batches() == [0, 1]


def test_empty_batches(spark):
    store = NearDuplicates(spark)
    assert store.kept().collect() == []
    for number in (0, 1):
        store.add(frame(spark, rows(4)).limit(0), number)
    assert store.kept().collect() == [] and store.components().collect() == []


def test_links_have_the_components_of_all_pairs(spark):
    """Copies are tied to one of them, not paired (F1): 300 copies give 299 links; words are shared in numbers only by sets of 32 words and more."""
    r = random.Random(7)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    data, made = [], []
    for i in range(120):
        words = r.sample(vocabulary, r.randint(20, 120)) if not made or r.random() < 0.4 else [w for w in r.choice(made) if r.random() < 0.9] + r.sample(vocabulary, 8)
        made.append(words)
        data.append((i, " ".join(words), "a", r.choice(["p", "q", None])))
    data += [(1000 + i, " ".join(made[i % 3]), "a", "pq"[i % 2]) for i in range(12)]
    sets = {o: (set(c.split()), p) for o, c, _, p in data}
    wanted = sorted((a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and len(sets[a][0] & sets[b][0]) > 0.6 * len(sets[a][0] | sets[b][0]))
    pairs = similar_pairs(frame(spark, data))
    assert len(wanted) > 50 and sorted((x["a"], x["b"]) for x in pairs.collect()) == wanted
    told = lambda p: sorted(map(tuple, connected_components(p, "a", "b").collect()))
    assert told(similar_links(frame(spark, data))) == told(pairs)
    copies = [(i, "sphinx black quartz judge", "a", str(i)) for i in range(300)]
    assert similar_links(frame(spark, copies)).count() == 299


def test_a_store_keeps_numbers_and_pairs_meet_in_several(spark, tmp_path, monkeypatch):
    """One word in common is not enough for large sets to be compared, and no words are stored (F2)."""
    from pathlib import Path

    from recollex.operators import incremental

    r, compared, alike = random.Random(8), [], incremental.alike
    monkeypatch.setattr(incremental, "alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(12))
    usual = [word() for _ in range(1500)]
    data = [(i, " ".join(r.sample(usual, 100)), "a", str(i)) for i in range(120)]
    data += [(1000 + i, data[i][1] + " " + word(), "a", "x") for i in range(5)]
    store = NearDuplicates(spark, f"file://{tmp_path}")
    links = [tuple(x) for n, part in enumerate((data[:60], data[60:])) for x in store.add(frame(spark, part), n).select("a", "b").collect()]
    assert sorted(links) == [(i, 1000 + i) for i in range(5)]
    assert sum(compared) < 120 * 119 / 4  # every two of them share some first word
    assert store._read("sets", [0]).dtypes[2] == ("h", "array<bigint>")
