"""Parsed questions, hits of an outer index, templates, verbs and the command line."""

import json

import pytest

from recollex.__main__ import main
from recollex.operators import extract, prompts, search, seeds
from recollex.sources import database, models


class Numbers:
    """Fails on prompts with "bad"; names each line's text as its product."""

    def batch(self, texts):
        if any("bad" in t for t in texts):
            raise ConnectionError
        lines = [[x.split(": ", 1) for x in t.split("\n") if x[:1].isdigit()] for t in texts]
        return ["\n".join(["Sure:", *[f'{i}: {{"event_product": "{q}"}}' for i, q in each], '99: {"x": 1}']) for each in lines]


def test_parse_queries(spark):
    asked = [(i, f"q{i}") for i in range(40)] + [(40, None), (41, "two\nlines  here"), (42, "q3")]
    got = {r["query_text"]: json.loads(r["parsed"]) for r in extract.parse_queries(spark.createDataFrame(asked, "ord long, query_text string"), Numbers()).collect()}
    assert got == {**{f"q{i}": {"event_product": f"q{i}"} for i in range(40)}, "two\nlines  here": {"event_product": "two lines here"}}
    bad = spark.createDataFrame([(i, "bad" if i == 20 else f"q{i}") for i in range(45)], "ord long, query_text string")
    assert {r["query_text"] for r in extract.parse_queries(bad, Numbers()).collect()} == {f"q{i}" for i in (*range(15), *range(30, 45))}
    assert extract.parse_queries(bad.limit(0), Numbers()).collect() == []


def test_two_stage(spark):
    nodes = spark.createDataFrame([("n1", "M1", 2), ("n1", "M0", 1), ("n2", "M2", 3), (None, "M3", 4)], "node_id string, memory_id string, ord int")
    probes, asked = spark.createDataFrame([("p",)], "probe string"), []
    hits = [("p", 1, "n2", 0.9, "s", "two  [人物:甲, 乙]"), ("p", 2, "n1", None, None, None), ("p", 3, "other", 0.5, "S", "x [人物:甲] y"), ("p", 4, None, 0.4, None, "four"), ("p", 5, "n2", 0.3, None, "five")]

    def retrieve(p, k):
        asked.append(k)
        return spark.createDataFrame(hits[:k], "probe string, place int, node_id string, score double, summary string, content string")

    got = sorted((r["rank"], r["memory_id"], r["score"], r["content"]) for r in search.two_stage(retrieve, nodes, probes, 4).collect())
    assert asked == [8] and got == [(1, "M2", 0.9, "two"), (2, "M0", 0.0, ""), (3, "S", 0.5, "x [人物:甲] y"), (4, "", 0.4, "four")]


def test_template(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "ask.md").write_text("问 {x}", encoding="utf-8")
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert prompts.template("ask", folders, {"ask": "other"}) == "问 {x}"
    assert prompts.template("else", folders, {"else": "kept"}) == "kept" and prompts.template("none", folders) == ""


def test_verbs(spark):
    rows = [("a", 'so: ["购买", "之后"] done', 2), ("b", '["购买"]', 2), ("c", "none", 1), ("d", None, 0), ("e", "[]", 0), ("f", '["结果", "结果", "结果"]', 3)]
    df = spark.createDataFrame(rows, "key string, answer string, hops int")
    got = {r["key"]: r["v"] for r in df.select("key", prompts.verbs(df["answer"], df["hops"], df["key"]).alias("v")).collect()}
    assert got["a"][0] == "购买" and got["a"][1] in prompts.SAFE_VERBS and got["b"] is None and got["c"] is None and got["d"] is None and got["e"] == []
    assert set(got["f"]) <= set(prompts.SAFE_VERBS)


def test_shuffled(spark):
    df = spark.range(50).repartition(3)
    ids = [r["id"] for r in prompts.shuffled(df, "id").collect()]
    assert sorted(ids) == list(range(50)) != ids and ids == [r["id"] for r in prompts.shuffled(df.repartition(5), "id").collect()]


def test_command_line(spark, tmp_path, capsys):
    made, tidy = str(tmp_path / "db"), str(tmp_path / "clean")
    assert main(["generate", made, "--size", "60", "--questions", "20"], spark) == 0
    assert main(["check", made, "--detailed"], spark) in (0, 1) and "errors" in capsys.readouterr().out
    assert main(["clean", made, tidy, "--stdout"], spark) == 0
    printed = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    db = database.load(spark, tidy)
    assert len(printed) == db["memories"].count() + db["queries"].count() > 20
    assert main(["evaluate", tidy], spark) == 0 and capsys.readouterr().out
    with pytest.raises(SystemExit) as wrong:
        main(["clean", made], spark)
    assert wrong.value.code == 2


def test_check_fails_on_errors(spark, tmp_path, capsys):
    path = tmp_path / "bad.json"
    record = {"memory_id": "M1", "content": "x"}
    path.write_text(json.dumps({"memories": [record, record], "queries": [{"query_id": "Q1", "query_text": "t", "expected_memory_ids": ["gone"]}]}))
    assert main(["check", str(path)], spark) == 1 and "ERROR" in capsys.readouterr().out


def test_extract_goes_on(spark, tmp_path, capsys):
    models.register("one-fact", lambda: models.Mock('[{"content": "f", "person": "p"}]'))
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.md").write_text("long enough text " * 100)
    assert main(["extract", str(folder), out, "--model", "one-fact"], spark) == 0 and "1 answers, 0 failed" in capsys.readouterr().out
    (folder / "b.md").write_text("another long enough text " * 100)
    assert main(["extract", str(folder), out, "--model", "one-fact"], spark) == 0 and "1 answers, 0 failed" in capsys.readouterr().out
    assert spark.read.json(f"{out}/facts-2").count() == 2


SEED = "ord long, id string, person string, identity string, partner string, partner_identity string, relation string, city string, place string, landmark string, event_type string, action string, product string, quantity long, price long, ts string, days long, tags array<string>, cluster_id string, cluster_kind string, chain_id string, chain_pos int, chain_total int, asks array<string>"


def test_seeds(spark):
    def seed(i, **values):
        row = {"ord": i, "id": f"S{i}", "person": "甲", "city": "乙城", "place": "馆", "action": "买", "product": "书", "event_type": "购物", "quantity": 2, "ts": "2020-01-01 00:00:00", "days": 800, "tags": ["推理测试", "困难", "因果"], "asks": []}
        return tuple({**row, **values}.get(f.split()[0]) for f in SEED.split(", "))

    rows = [seed(1, chain_id="H", chain_pos=2, chain_total=2, person="丙"), seed(2, chain_id="H", chain_pos=1, chain_total=2), seed(3, cluster_id="C", cluster_kind="地点"), seed(4, asks=["跨版本", "人物检索"], days=None, ts=None), seed(5, person=None, tags=None)]
    df = spark.createDataFrame(rows, SEED)
    mems = {r["memory_id"]: r for r in seeds.seed_memories(df).collect()}
    assert (mems["S2"]["chain_prev"], mems["S2"]["chain_next"], mems["S1"]["chain_prev"]) == ("", "S1", "S2") and mems["S1"]["logic"]["type"] == "因果" and mems["S3"]["chain_prev"] is None
    assert mems["S1"]["category"] == "推理测试测试集" and mems["S1"]["weight"] == 1.5 and mems["S1"]["versions"][0]["content"] == "丙在乙城馆买了书，数量2" and mems["S5"]["category"] is None
    assert mems["S4"]["retrieval_keywords"] == ["甲", "乙城", "购物", "买", "书"] and mems["S3"]["retrieval_keywords"] is None and mems["S4"]["time"]["timestamp"] is None
    got = sorted((r["query_text"], r["query_type"], r["expected_memory_ids"], r["expected_answer_text"]) for r in seeds.seed_questions(df).collect())
    assert got == sorted([
        ("因为甲在乙城买了书，后续导致了哪些事件？", "因果推理链", ["S2", "S1"], "甲在乙城买了书 → 丙在乙城买了书"), ("在乙城发生的事件有哪些", "聚类检索", ["S3"], "甲在乙城买了书"),
        ("关于甲在乙城买了书的详情，多说点", "跨版本", ["S4"], "甲在乙城买了书，数量2"), ("甲做了什么", "人物检索", ["S4"], "甲在乙城买了书，数量2"),
    ])
    assert seeds.seed_memories(df.limit(0)).count() == seeds.seed_questions(df.limit(0)).count() == 0
