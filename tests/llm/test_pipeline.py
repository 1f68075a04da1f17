import hashlib

import corpus_pipeline as cp
from recollex.llm.decontaminate import mark
from recollex.session import new_path, table
from tests.llm.helpers import table as awkward
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as lines

SF = "/root/testdata/sf0.001"


def reread(spark, df):
    path = new_path(spark, "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    kinds = dict(cp.STAGES)
    assert list(kinds) == ["quality", "lines", "near_copies", "benchmark", "tokens"]
    good = reread(spark, kinds["quality"](spark, docs, SF))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and all(d in kept for d, q in labels.items() if q == 1)

    clean = reread(spark, kinds["lines"](spark, good, SF))
    want = {d: t for d, _, n, t in lines([(r["doc_id"], r["text"]) for r in good.collect()]) if n == 0 or t.strip()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    one = reread(spark, kinds["near_copies"](spark, clean, SF))
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in one.collect()} == {d for d, _, c in components(rows, 5, 4, 5) if d == c}

    pure = reread(spark, kinds["benchmark"](spark, one, SF))
    hit = {r["doc_id"] for r in mark(one, table(spark, SF, "benchmark")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in one.collect()} - hit

    tokens = {r["doc_id"]: r for r in kinds["tokens"](spark, pure, SF).collect()}
    for r in pure.collect():
        assert tokens[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark, extra="n_lines hits score component"), awkward(spark, extra="lang").limit(0)):
        for name, stage in cp.STAGES:
            out = reread(spark, stage(spark, docs, SF))
            assert name == "tokens" or out.columns == docs.columns
            docs = out
