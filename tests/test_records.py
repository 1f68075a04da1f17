import json

import pytest
from pyspark.sql import functions as F

from recollex.operators import chains, clean, evaluate, extract, facts, generate, mining, quality, questions, search
from recollex.operators.components import connected_components
from recollex.session import written
from recollex.sources import corpus, database, models

EMPTY_VERSIONS = "array<struct<version_id:string,style:string,content:string>>"


@pytest.fixture(scope="module")
def made(spark):
    m = written(generate.memories(spark, generate.Config(size=100)), "m")
    return m, written(questions.questions(m, 50), "q")


def test_generated_records(made):
    m, q = made
    rows = m.collect()
    assert len({r["memory_id"] for r in rows}) == len(rows) > 100
    assert all(len(r["versions"]) == 3 and r["person"]["name"] != r["person"]["partner_name"] and r["time"]["absolute"] and r["weight"] in (0.5, 1.0, 1.5) for r in rows)
    assert {r["category"] for r in rows} == set(generate.CATEGORIES.values())
    assert min(r["count"] for r in m.filter("cluster_id is not null").groupBy("cluster_id").count().collect()) >= 3
    chained = m.filter("reasoning_chain is not null").withColumnsRenamed({"reasoning_chain": "chain", "chain_position": "pos"})
    assert chains.broken_links(chained, "chain", "pos").count() == 0 and chains.contiguity(chained, "chain", "pos").filter("not contiguous").count() == 0


def test_generation_is_the_same_again(spark, made):
    again = generate.memories(spark, generate.Config(size=100)).select(F.xxhash64("memory_id", "versions", "reasoning_chain").alias("h")).agg(F.bit_xor("h")).first()
    assert made[0].select(F.xxhash64("memory_id", "versions", "reasoning_chain").alias("h")).agg(F.bit_xor("h")).first() == again


@pytest.mark.parametrize("times", ["uniform", "historical"])
def test_time_distributions_and_domains(spark, times):
    m = generate.memories(spark, generate.Config(size=50, times=times, domain="history"))
    assert m.filter("time.absolute is null or time.relative is null").count() == 0 and m.count() > 50


def test_generated_questions(made):
    m, q = made
    rows = q.collect()
    assert len({r["query_id"] for r in rows}) == len(rows) == len({r["query_text"] for r in rows})
    ids = {r["memory_id"] for r in m.collect()}
    assert all(set(r["expected_memory_ids"]) <= ids and bool(r["expected_memory_ids"]) != r["is_negative"] for r in rows)
    assert len({r["test_dimension"] for r in rows}) >= 5 and sum(r["is_negative"] for r in rows) / len(rows) >= 0.1
    assert quality.passed(quality.check(m, q))


def test_checks_find_planted_errors(made):
    m, q = made
    twice = m.unionByName(m.limit(1))
    assert {r["check"] for r in quality.check(twice, q).filter("status = 'ERROR'").collect()} == {"memory_ids"}
    wrong = q.withColumn("expected_memory_ids", F.when(F.col("is_negative"), F.array(F.lit("MEM000001"))).otherwise(F.col("expected_memory_ids")))
    assert "negatives_empty" in {r["check"] for r in quality.check(m, wrong).filter("status = 'ERROR'").collect()}
    lost = q.withColumn("expected_memory_ids", F.when(F.col("is_negative"), F.col("expected_memory_ids")).otherwise(F.array(F.lit("gone"))))
    assert "references" in {r["check"] for r in quality.check(m, lost).filter("status = 'ERROR'").collect()}
    assert "0 errors" in quality.rendered(quality.check(m, q))


@pytest.mark.parametrize("negative,total,status", [(149, 1000, "WARN"), (150, 1000, "PASS"), (250, 1000, "PASS"), (251, 1000, "WARN")])
def test_negative_share(spark, negative, total, status):
    q = spark.range(total).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("query_id"), F.col("id").cast("string").alias("query_text"), (F.col("id") < negative).alias("is_negative"), F.when(F.col("id") < negative, F.array().cast("array<string>")).otherwise(F.array(F.lit("m"))).alias("expected_memory_ids"))
    m = spark.createDataFrame([("m", "c", None, None, None, ("x",), ("p",), ("z",), None)], f"memory_id string, category string, reasoning_chain string, chain_position int, cluster_id string, location struct<city:string>, person struct<name:string>, event struct<product:string>, versions {EMPTY_VERSIONS}")
    assert quality.check(m, q).filter("check = 'negative_share'").first()["status"] == status


def test_evaluation(made):
    m, q = made
    report = evaluate.nested(evaluate.evaluate(m, q))
    assert report["storage"] == {"stored_count": 3.0 * m.count(), "total": float(m.count()), "integrity": 3.0}
    assert report["retrieval"]["overall_recall"] > 0.7 and report["reasoning"]["chain_accuracy"] == 0 and report["deep_retrieval"]["near"] != "N/A"
    assert evaluate.nested(evaluate.evaluate(m, q, extended=True))["reasoning"]["chain_accuracy"] > 0.5
    assert "overall_recall" in evaluate.summary(evaluate.evaluate(m, q))


def test_evaluation_of_nothing(spark, made):
    m, q = made
    assert evaluate.evaluate(m.limit(0), q).first()["metric"] == "empty database"
    bare = m.filter("cluster_id is null").withColumn("category", F.lit("x")).withColumn("decay", F.lit(None).cast("struct<level:string,access_count:int>"))
    report = evaluate.nested(evaluate.evaluate(bare, q))
    assert report["organization"]["cluster_accuracy"] == "N/A" and report["deep_retrieval"]["near"] == "N/A" and report["forgetting"]["high_freq_retention"] == 0


def store(spark, rows):
    return spark.createDataFrame([(m, c, i) for i, (m, c) in enumerate(rows)], "memory_id string, content string, ord long")


def test_last_version_at_first_place(spark):
    rows = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2), ("", "x", 3)], "memory_id string, content string, seq int")
    assert sorted(map(tuple, database.store(rows).collect())) == [("a", "3", 0), ("b", "2", 1)]


def test_search_scores_and_ties(spark):
    s = store(spark, [("z", "alpha beta"), ("a", "alphabet"), ("m", "gamma"), ("c", "张三 在 北京")])
    got = search.keyword_search(s, spark.createDataFrame([("p", "alpha beta"), ("q", "张伟 x"), ("n", "a")], "probe string, text string")).orderBy("probe", "rank").collect()
    assert [(r["probe"], r["rank"], r["memory_id"], r["score"]) for r in got] == [("p", 1, "z", 1.0), ("p", 2, "a", 0.5), ("q", 1, "c", 0.5)]


@pytest.mark.parametrize("retriever", [search.tfidf_search, search.bm25_search])
def test_weighted_retrievers(spark, retriever):
    s = store(spark, [("a", "rare common common"), ("b", "common words here"), ("c", "other")])
    got = retriever(s, spark.createDataFrame([("p", "rare")], "probe string, text string"), 5).collect()
    assert [r["memory_id"] for r in got] == ["a"] and evaluate.evaluate is not None


def test_overall_precision_counts_negatives(spark):
    q = spark.createDataFrame([(0, "t"), (1, "t")], "ord long, query_type string")
    expected, ranked = spark.createDataFrame([(0, "a")], "ord long, memory_id string"), spark.createDataFrame([(0, 1, "a")], "ord long, rank int, memory_id string")
    rows = {(r["metric"], r["key"]): r["value"] for r in evaluate.retrieval(q, expected, ranked).collect()}
    assert rows["overall_precision", ""] == 1 / 40 and rows["precision", "t"] == 1 / 20 and rows["overall_recall", ""] == 1


FACTS = "ord long, content string, person string, location string, time string, dynasty string, event_type string, chain_id string, chain_position int, chain_relation string, _source string"


def test_facts_to_records(spark):
    rows = [(i, f"事{i}", "张三,李四", "北京,上海", f"2024-01-{i + 1:02d}", "唐" if i == 0 else None, "战争", "CHAIN_A" if i < 5 else "", 0, "因果", "f") for i in range(10)]
    m = facts.to_memories(spark.createDataFrame(rows, FACTS))
    got = {r["ord"]: r for r in m.collect()}
    assert len(got) == 10 and got[0]["memory_id"] == "MEM010000" and got[0]["person"]["name"] == "张三" and got[0]["location"]["city"] == "北京"
    assert got[0]["versions"][1]["content"] == "2024-01-01(唐) 张三,李四在北京,上海战争：事0" and {r["reasoning_chain"] for r in got.values()} == {"CHAIN_00001", "CHAIN_00002"}
    q = questions.corpus_questions(m)
    assert q.filter("is_negative").count() >= 1 and q.filter("query_type = '组合推理'").count() == 1  # one of each type fits into the person's eight


def chain_rows(spark, rows):
    return spark.createDataFrame([(i, f"m{i}", *r) for i, r in enumerate(rows)], "ord long, memory_id string, chain_id string, person string, time string, text string")


def test_chain_depth_and_lone_ids(spark):
    rows = [("A", "p", "", "x")] * 8 + [("B", "q", "", "x")] + [("", "q", "", "x")] * 2 + [("", "未知", "", "x")] * 3
    got = {r["ord"]: r for r in chains.build_chains(chain_rows(spark, rows)).collect()}
    assert [got[i]["pos"] for i in range(8)] == [1, 2, 3, 4, 5, 6, None, None] and got[0]["total"] == 6 and got[5]["chain_next"] == "" and got[0]["chain_prev"] == ""
    assert all(got[i]["chain"] is None for i in range(8, 14)) and got[0]["relation"] == "因果"


def test_mixed_time_order(spark):
    rows = [("A", "p", "2030", "x"), ("A", "p", "", "次日"), ("A", "p", "2020", "x"), ("B", "p", "", "半年后"), ("B", "p", "", "次日"), ("B", "p", "", "none")]
    got = {r["ord"]: r["pos"] for r in chains.build_chains(chain_rows(spark, rows)).collect()}
    assert [got[i] for i in range(6)] == [3, 1, 2, 3, 2, 1]


def test_positions_with_a_gap(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)], "c string, p int")
    assert {r["c"]: r["contiguous"] for r in chains.contiguity(df, "c", "p").collect()} == {"a": False, "b": True}
    assert [tuple(r) for r in chains.gaps(df, "c", "p").collect()] == [("a", 1)]


def test_similarity_is_strict_and_components_keep_the_longest(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotels"]
    rows = [(0, "p", " ".join(words[:8])), (1, "q", " ".join(words[:8]) + " !"), (2, "p", " ".join(words[:7])), (3, "r", " ".join(words[:3] + ["one1", "zulu", "yank"])), (4, "r", "alpha bravo charlie xray yankee")]
    df = spark.createDataFrame([(i, p, t, "b") for i, p, t in rows], "ord long, person string, content string, block string")
    pairs = {(r["a"], r["b"]) for r in mining.similar_pairs(df).collect()}
    assert pairs == {(0, 1), (1, 2)}  # 0 and 2 are one person's
    assert sorted(r["ord"] for r in mining.keep_longest(df, mining.similar_pairs(df)).collect()) == [1, 3, 4]
    edge = spark.createDataFrame([(0, "p", "aaaa bbbb cccc dddd", "b"), (1, "q", "aaaa bbbb cccc eeee", "b")], "ord long, person string, content string, block string")
    assert mining.similar_pairs(edge).count() == 0  # exactly 0.6


def test_key_threshold(spark):
    df = spark.createDataFrame([(p,) for p, n in zip("abcde", (1, 1, 1, 1, 9), strict=True) for _ in range(n)], "person string")
    assert mining.key_threshold(df).first()[0] == 9


def test_diverse_pick(spark):
    df = spark.createDataFrame([(i, "p", "s" + str(i % 3)) for i in range(30)], "ord long, person string, s string")
    got = mining.diverse(df, "person", F.lit(5), ["s"]).collect()
    assert len(got) == 5 and {r["s"] for r in got} == {"s0", "s1", "s2"} and {0, 1, 2} <= {r["ord"] for r in got}


def test_deduplicate_and_clean(made):
    m, q = made
    doubled = m.unionByName(m.limit(5).withColumns({"ord": F.col("ord") + 10_000, "memory_id": F.concat("memory_id", F.lit("x"))}))
    mems, asked, stats = clean.clean(doubled, q)
    s = stats.first()
    assert s["original"] - s["exact_dup"] - s["cross_person_dup"] - s["person_capped"] == s["final"] == mems.count() and s["exact_dup"] == 5
    assert asked.filter("is_negative").count() == 0 and clean.clean(doubled, q, keep_negatives=True)[1].filter("is_negative").count() > 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (3, 1)] + [(100 + i, 100 + i + 1) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


LEGACY = {"metadata": {"name": "old"}, "memories": [{"memory_id": "a", "content": "text", "person": "张三", "location": "大理", "event_type": "战", "time_period": "宋", "novel": "n"}], "queries": [{"query": "张三?", "query_type": "person", "target_entity": "张三", "relevant_memory_ids": ["a"]}]}


def test_legacy_database(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps(LEGACY, ensure_ascii=False, indent=2), encoding="utf-8")
    db = database.load(spark, str(tmp_path / "db.json"))
    m, q = db["memories"].first(), db["queries"].first()
    assert (m["person"]["name"], m["person"]["identity"], m["location"]["city"], m["event"]["type"]) == ("张三", "", "大理", "战")
    assert m["attrs"] == {"event_type": "战", "time_period": "宋", "novel": "n"} and db["info"].first()["name"] == "old"
    assert (q["query_id"], q["query_text"], q["expected_memory_ids"], q["is_negative"]) == ("Q0001", "张三?", ["a"], False)


def test_round_trip(spark, made, tmp_path):
    m, q = made
    database.save_document(m, q, str(tmp_path / "out"), database.info(m, "db"))
    back = database.load(spark, str(tmp_path / "out"))
    assert back["memories"].count() == m.count() and back["queries"].count() == q.count() and back["info"].first()["name"] == "db"
    a = m.select("memory_id", "versions", F.col("person.name")).orderBy("memory_id").collect()
    assert back["memories"].select("memory_id", "versions", F.col("person.name")).orderBy("memory_id").collect() == a
    got = database.numbered(m.select("memory_id"), "N%03d", ["memory_id"], "no").orderBy("memory_id").collect()
    assert [r["no"] for r in got] == [f"N{i:03d}" for i in range(1, len(got) + 1)]


def test_corpus(spark, tmp_path):
    for name, text in (("a/x.md", "---\nt: 1\n---\n" + "w" * 600), ("b/y.md", "short"), ("b/z.txt", "w" * 900)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = corpus.scan(spark, str(tmp_path))
    ready = corpus.prepare(files).collect()
    assert files.count() == 2 and [(r["folder"], r["name"], len(r["text"])) for r in ready] == [("a", "x.md", 600)]
    assert [r["name"] for r in corpus.pending(files, files.filter("name = 'x.md'").select("file")).collect()] == ["y.md"]
    with pytest.raises(ValueError):
        corpus.checked_folder("/etc")


def test_models(spark):
    df = spark.createDataFrame([("p1",), (None,)], "prompt string")
    assert [r["answer"] for r in models.generate(df, "prompt", models.create("mock")).collect()] == ["p1", ""]
    got = models.generate_json(df, "prompt", models.Mock('so: {"a": 5}')).select(F.try_variant_get("answer", "$.a", "int").alias("a")).collect()
    assert [r["a"] for r in got] == [5, 5]
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.Retrying(flaky, pause=0).batch(["x"]) == ["ok"] and len(calls) == 3
    with pytest.raises(ValueError):
        models.create("none")


def test_extraction(spark):
    class Model:
        def batch(self, prompts):
            if len(prompts) > 1 or "broken" in prompts[0]:
                raise OSError
            return ['[{"content": "a", "person": "p", "extra": {"x": 1}}, 5]' if "array" in prompts[0].split("\n\n")[1] else 'facts:\n{"content": "b"},\nno {json\n{"content": "c", "chain_position": 3}']

    pad = " w" * 300
    files = spark.createDataFrame([("1", "f", "one.md", "array" + pad), ("2", "f", "two.md", "lines" + pad), ("3", "f", "bad.md", "broken" + pad), ("4", "f", "short.md", "x"), ("5", "f", "old.md", "array" + pad)], "file string, folder string, name string, text string").coalesce(1)
    old = spark.createDataFrame([("kept", "f/old.md")], "content string, _source string")
    facts_, done, counts = extract.extract(files, files.filter("file = '5'").select("file"), old, Model())
    got = sorted((r["_source"], r["content"], r["person"], r["chain_position"]) for r in facts_.collect())
    assert got == [("f/old.md", "kept", None, None), ("f/one.md", "a", "p", None), ("f/two.md", "b", None, None), ("f/two.md", "c", None, 3)]
    assert sorted(r["file"] for r in done.collect()) == ["1", "2", "5"] and tuple(counts.first()) == (2, 1)
    again, _, none = extract.extract(files.filter("file = '1'"), done, facts_, Model())
    assert again.count() == 4 and tuple(none.first()) == (0, 0)


def test_every_rule_of_the_detailed_checks_can_fire(spark):
    def m(i, name, action, city="北京", product="书", chain="", pos=0, relation=None, cluster=None):
        return (f"m{i}", {"name": name}, {"action": action, "product": product}, {"city": city}, chain, pos, relation, cluster)

    mems = spark.createDataFrame(
        [m(1, "甲", "之后", chain="C", pos=1, relation="时序"), m(2, "乙", "买", chain="C", pos=3, relation="时序"), m(3, "丙", "卖", chain="D", pos=1, relation="因果", cluster="k1"), m(4, "丁", "卖", cluster="k2")],
        "memory_id string, person struct<name:string>, event struct<action:string,product:string>, location struct<city:string>, reasoning_chain string, chain_position int, chain_relation string, cluster_id string",
    )
    rows = [
        ("q1", "从别处出发，能推导出什么", "推导推理链", ["m2", "m1"], "甲", False, None), ("q2", "后续事件依次是什么", "时序推理链", ["m1", "m3"], "甲丙", False, None), ("q3", "单", "因果推理链", ["m1"], "甲", False, None),
        ("q4", "聚", "聚类检索", ["m3", "m4"], "", False, None), ("q5", "聚一", "聚类检索", ["m3"], "", False, None), ("q6", "甲做了什么", "人物检索", ["m1"], "乙", False, None), ("q7", "在上海发生过什么", "地点检索", ["m1"], "北京", False, None),
        ("q8", "跨", "跨版本", ["m1"], "", False, ["a"]), ("q9", "之后了 chain_id", "组合检索", ["m1"], "", False, None), ("q9", "之后了 chain_id", "组合检索", ["m1"], "", False, None), *[(f"n{i}", f"同 {i}", "负样本", ["m1"] if i == 0 else [], "", True, None) for i in range(4)],
    ]
    queries = spark.createDataFrame(rows, "query_id string, query_text string, query_type string, expected_memory_ids array<string>, expected_answer_text string, is_negative boolean, acceptable_answers array<string>")
    got = {}
    for r in quality.detailed(mems, queries).collect():
        got.setdefault(r["rule"], set()).add((r["subject"], r["detail"]))
    assert got.pop("answer_member") == {("q1", "乙")} and got.pop("premise") == {("q1", "别处")} and got.pop("chain_gap") == {("C", "1")}
    assert got.pop("chain_first_verb") == {("q2", "之后"), ("q3", "之后")} and got.pop("answer_versions") == {("q8", "1")} and got.pop("several_chains") == {("q2", "2")}
    assert set(got) == {"repeated_text", "negative_with_ids", "chain_too_short", "chain_start", "cluster_too_small", "several_clusters", "answer_person", "answer_place", "grammar", "leaked_name", "negative_person", "negative_kinds"}
