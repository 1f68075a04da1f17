import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollex.operators import extract as ex
from recollex.operators import statistics as st
from recollex.sources.answers import AnswerStore
from recollex.streaming import flows


class Counting:
    """Writes down what it is asked; fails for prompts with "bad" unless told otherwise."""

    def __init__(self, log, fails=True):
        self.log, self.fails = str(log), fails

    def batch(self, prompts):
        if self.fails and any("bad" in p for p in prompts):
            raise RuntimeError("no")
        with open(self.log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]


def test_no_prompt_is_asked_twice(spark, tmp_path):
    store, log = AnswerStore(spark, "m", str(tmp_path / "answers"), size=3), tmp_path / "log"
    frame = lambda rows: spark.createDataFrame(rows, "id int, prompt string, asked string")
    first = [(i, f"p{i % 7}", "mine") for i in range(20)] + [(50, None, "mine"), (51, "bad", "mine")]
    got = {r.id: (r.answer, r.asked) for r in store.ask(frame(first), Counting(log)).collect()}
    assert got == {**{i: (f"P{i % 7}", "mine") for i in range(20)}, 50: ("", "mine"), 51: (None, "mine")}
    assert sorted(log.read_text().split("\n")) == sorted([*[f"p{i}" for i in range(7)], "", ""])
    again = store.ask(frame([*first, (60, "new", "x")]), Counting(log, fails=False))
    assert {r.id: r.answer for r in again.collect()} == {**{k: v for k, (v, _) in got.items()}, 51: "BAD", 60: "NEW"}
    assert sorted(log.read_text().split()) == sorted([*[f"p{i}" for i in range(7)], "bad", "new"])
    assert AnswerStore(spark, "other", store.folder).missing(frame(first)).count() == 9
    assert store.ask(frame([]), Counting(log)).collect() == []


def test_a_lost_run_keeps_its_finished_parts(spark, tmp_path):
    store = AnswerStore(spark, "m", str(tmp_path / "answers"), size=2)
    frame = spark.createDataFrame([(f"q{i}",) for i in range(10)], "prompt string")
    calls = []

    class Dying:
        def batch(self, prompts):
            return [p for p in prompts]

    import recollex.sources.answers as module

    made = module.generate

    def dies(df, *a):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return made(df, *a)

    module.generate = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            store.ask(frame, Dying())
    finally:
        module.generate = made
    left = store.missing(frame).count()
    assert 0 < left < 10
    assert store.ask(frame, Dying()).filter("answer is null").count() == 0


def test_answers_serve_queries_and_corpora(spark, tmp_path):
    store, log = AnswerStore(spark, "m", str(tmp_path / "answers")), tmp_path / "log"

    class Parse(Counting):
        def batch(self, prompts):
            super().batch(["x"] * len(prompts))
            return ['0: {"person_name": "Ann"}'] * len(prompts)

    queries = spark.createDataFrame([(0, "who?"), (1, "where?")], "ord long, query_text string")
    for _ in range(2):
        assert [tuple(r) for r in ex.parse_queries(queries, Parse(log), answers=store).collect()] == [("who?", '{"person_name": "Ann"}')]
    assert log.read_text().split() == ["x"]


def test_merged_sketches_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.xxhash64("id") % 9000).alias("who"), F.when(F.col("id") % 11 > 0, F.sqrt(F.col("id").cast("double"))).alias("v"))
    kept = st.parts(rows, "day", ["who"], ["v"]).cache()
    for first, last in ((0, 29), (3, 3), (10, 20)):
        inside = rows.filter(F.col("day").between(first, last))
        exact = inside.agg(F.count("*").alias("n"), F.countDistinct("who").alias("d")).first()
        got = st.merged(kept.filter(F.col("part").between(first, last)), (0.1, 0.5, 0.99)).first()
        assert got.n == exact.n and abs(got.distinct_who - exact.d) <= 3 * 1.04 / 64 * exact.d
        for share, value in zip((0.1, 0.5, 0.99), got.quantiles_v, strict=True):
            rank = inside.agg((F.count_if(F.col("v") <= value) / F.count("v")).alias("r")).first().r
            assert abs(rank - share) <= 0.02
    nothing = st.merged(kept.filter("part > 99"), (0.5,)).first()
    assert (nothing.n, nothing.distinct_who, nothing.quantiles_v) == (0, 0, None)
    nulls = st.merged(st.parts(rows.select("day", F.lit(None).cast("double").alias("v")), "day", ["v"], ["v"])).first()
    assert (nulls.n, nulls.distinct_v, nulls.quantiles_v) == (60_000, 0, None)
    assert abs(st.ranks(kept, "v", [100.0]).first().ranks[0] - rows.agg((F.count_if(F.col("v") <= 100) / F.count("v")).alias("r")).first().r) <= 0.02


ZERO = datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp"


def put(spark, folder, number, rows):
    spark.createDataFrame([(i, k, ZERO + timedelta(minutes=m)) for i, k, m in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")


def test_sliding_windows_count_late_rows(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    put(spark, source, 0, [(1, "a", 5), (2, "a", 65)])
    run = lambda: flows.windows(flows.files(spark, f"{source}/*", spark.createDataFrame([], SCHEMA).schema, 1), "t", "k", "id", "1 hour", "10 minutes", sink, "30 minutes")
    run()
    assert flows.late_rows(spark, sink) == 0
    put(spark, source, 1, [(3, "a", 300)])
    run()
    put(spark, source, 2, [(4, "a", 6), (5, "b", 7), (6, "a", 299)])  # two come long after their windows were closed
    put(spark, source, 3, [(7, "a", 900)])
    got = {(r.start, r.k): r.n for r in run().collect()}
    minutes = {((s - ZERO).total_seconds() / 60, k): n for (s, k), n in got.items()}
    assert minutes == {(-30, "a"): 1, (0, "a"): 1, (30, "a"): 1, (60, "a"): 1, (270, "a"): 2, (240, "a"): 1, (300, "a"): 1}
    assert flows.late_rows(spark, sink) == 4  # each of the two stood in two windows


def test_repeats_within_a_watermark(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    run = lambda: flows.without_repeats(flows.files(spark, f"{source}/*", spark.createDataFrame([], SCHEMA).schema, 1), "t", ["k"], "1 hour", sink)
    put(spark, source, 0, [(1, "a", 0), (2, "a", 1), (3, "b", 2)])
    assert sorted(r.k for r in run().collect()) == ["a", "b"]
    put(spark, source, 1, [(4, "a", 30), (5, "c", 31)])
    assert sorted(r.k for r in run().collect()) == ["a", "b", "c"]
    put(spark, source, 2, [(6, "d", 500)])
    run()
    put(spark, source, 3, [(7, "a", 501), (8, "a", 3)])  # forgotten by now, and too late
    assert sorted(r.k for r in run().collect()) == ["a", "a", "b", "c", "d"] and flows.late_rows(spark, sink) >= 1


def test_stream_join_equals_batch_join(spark, tmp_path):
    r = random.Random(5)
    left, right = ([(i, r.choice("abc"), 10 * n + r.randint(0, 9)) for i, n in enumerate(range(60))] for _ in "lr")
    for number in range(3):
        put(spark, str(tmp_path / "l"), number, left[20 * number : 20 * number + 20])
        put(spark, str(tmp_path / "r"), number, right[20 * number : 20 * number + 20])
    of = lambda side: flows.files(spark, f"{tmp_path}/{side}/*", spark.createDataFrame([], SCHEMA).schema)
    got = sorted((x.id, x.other_id) for x in flows.joined(of("l"), of("r"), "k", "t", "1 hour", folder=str(tmp_path / "sink")).collect())
    assert got == sorted((i, j) for i, k, t in left for j, q, u in right if k == q and t - 60 <= u <= t)
