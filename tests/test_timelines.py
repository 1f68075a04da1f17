import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollex.operators.timelines import as_of, overlapping

ZERO = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else ZERO + timedelta(minutes=minutes)


def test_as_of_equals_brute_force(spark):
    r = random.Random(1)
    key = lambda: r.choice([1, 1, 1, 2, 3, None])
    versions = [(i, key(), r.choice([None, *range(0, 4000, 7)]), f"v{i}") for i in range(150)] + [(900 + i, 1, 700, f"tie{i}") for i in range(3)]
    facts = [(i, key(), r.choice([None, *range(-50, 6000, 11)])) for i in range(300)] + [(1000, 9, 5), (1001, 1, 700)]
    f = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in facts], "id long, k int, t timestamp, name string").withColumn("_v", F.lit(0))
    v = spark.createDataFrame([(i, k, at(t), n) for i, k, t, n in versions], "id long, k int, t timestamp, name string")
    for seconds, within in ((3600, None), (60 * 500, None), (10**9, None), (3600, 1200)):
        got = sorted((x.id, x.as_of_id, x.as_of_name) for x in as_of(f, v, "k", "t", "id", seconds, within).collect())
        want = []
        for i, k, t in facts:
            held = [(vt, vi, vn) for vi, vk, vt, vn in versions if None not in (k, t, vt) and vk == k and vt <= t]
            best = max(held, default=None)
            if best and within is not None and (t - best[0]) * 60 > within:
                best = None
            want.append((i, best[1] if best else None, best[2] if best else None))
        assert got == sorted(want), seconds


def test_as_of_with_an_empty_side(spark):
    f = spark.createDataFrame([(1, 1, at(3))], "id long, k int, t timestamp")
    assert [(x.id, x.as_of_id) for x in as_of(f, f.limit(0), "k", "t", "id").collect()] == [(1, None)]
    assert as_of(f.limit(0), f, "k", "t", "id").collect() == []


def test_as_of_spreads_a_hot_key(spark):
    """One key of all rows is as many groups as it has buckets."""
    f = spark.range(4000).select("id", F.lit(1).alias("k"), (F.lit(ZERO) + F.make_dt_interval(mins=F.col("id"))).alias("t"))
    found = as_of(f.filter("id % 2 = 1"), f.filter("id % 10 = 0"), "k", "t", "id", 3600)
    assert found.filter("as_of_id <> floor(id / 10) * 10").count() == 0 and found.count() == 2000
    assert f.select(F.floor(F.unix_micros("t") / 3_600_000_000).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] == 60


def test_overlap_equals_brute_force(spark):
    r = random.Random(2)
    make = lambda n, first: [(first + i, r.choice([1, 1, 2, None]), s, None if r.random() < 0.03 else s + r.choice([0, 0, 1, 5, 60, 300, -4])) for i, s in enumerate(r.choice([*range(0, 600, 5)]) for _ in range(n))]
    left, right = make(120, 0), make(120, 1000)
    frame = lambda rows: spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], "id long, k int, s timestamp, e timestamp").withColumn("_b", F.lit("clash"))

    def meet(a, b):
        (_, k, s, e), (_, j, t, u) = a, b
        if k is None or j != k or e is None or u is None or e < s or u < t:
            return False
        return max(s, t) < min(e, u) or (s == e and t <= s < u) or (t == u and s <= t < e)

    want = sorted((a[0], b[0]) for a in left for b in right if meet(a, b))
    for seconds in (300, 3600, 10**6):
        assert sorted((x.id, x.other_id) for x in overlapping(frame(left), frame(right), "k", "s", "e", seconds).collect()) == want, seconds
    assert overlapping(frame(left), frame(right).limit(0), "k", "s", "e").collect() == []
