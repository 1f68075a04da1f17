import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollex.llm import sharding as sh
from tests.llm.helpers import AWKWARD, table


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))


def test_spread_and_growth(spark, keys):
    got = sh.assign(keys, sh.PRODUCTION).collect()
    n = Counter(r["shard"] for r in got)
    assert sorted(n) == list(range(24)) and max(n.values()) < 2 * min(n.values())
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 0.5 < len(moved) / (4000 / 25) < 1.6
    again = sh.descend(keys, "doc_id", sh.grown(sh.PRODUCTION), "s").collect()
    assert {r["doc_id"]: r["s"] for r in again} == {r["doc_id"]: r["grown_shard"] for r in got}


def test_a_changed_weight_moves_rows_only_below_its_parent(keys):
    tree = sh.tree(2, 2, 2)
    leaf = tree.children[0].children[1].children[0]
    heavier = sh.Node(leaf.name, 3.0, leaf.shard)
    rack = sh.Node(tree.children[0].children[1].name, 2.0, None, (heavier, tree.children[0].children[1].children[1]))
    region = sh.Node(tree.children[0].name, 4.0, None, (tree.children[0].children[0], rack))
    changed = sh.Node("root", 8.0, None, (region, tree.children[1]))
    got = sh.descend(sh.descend(keys, "doc_id", tree, "a"), "doc_id", changed, "b").filter("a <> b").select("a", "b").distinct().collect()
    assert {tuple(r) for r in got} == {(3, 2)}


def test_slots_and_awkward_rows(spark):
    placed = sh.slots(sh.assign(table(spark, extra="size slot_ lang"), sh.tree(1, 2, 1)), ["doc_id", "text_crc32", "size"]).collect()
    assert len(placed) == len(AWKWARD) and all(r["lang"] == "kept" for r in placed)
    for shard in {r["shard"] for r in placed}:
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))
    for r in placed:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    assert len({r["shard"] for r in placed if r["doc_id"] == 5}) == 1


def test_empty_table(spark):
    assert sh.slots(sh.assign(table(spark).limit(0), sh.PRODUCTION), ["doc_id", "text_crc32", "size"]).collect() == []
