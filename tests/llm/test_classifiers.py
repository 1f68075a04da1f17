import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from recollex.llm import quality, toxicity
from recollex.llm._labels import fold, labelled_sample
from recollex.session import table as load
from tests.llm.helpers import table

SF = "/root/testdata/sf0.1"


def test_fold_is_crc32(spark):
    got = spark.createDataFrame([(17,), (None,)], "doc_id long").select(fold(F.col("doc_id"), 5)).collect()
    assert got[0][0] == zlib.crc32(b"17") % 5 and got[1][0] is None


def test_sample_is_bounded_and_ignores_nulls(spark):
    rows = [(i, i % 2) for i in range(20)] + [(1, 0), (None, 1), (50, None)]
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, toxic int"), "toxic", F.lit(True), 4).collect()
    assert len(got) == 8 and sorted(r["label"] for r in got) == [0] * 4 + [1] * 4 and len({r["doc_id"] for r in got}) == 8


def held_out(spark, scored, label):
    both = scored.join(load(spark, SF, "labels"), "doc_id").toPandas()
    test = both[both.held_out]
    return (test.predicted == test[label]).mean(), test


def test_quality_on_held_out_rows(spark):
    accuracy, test = held_out(spark, quality.op8_quality(spark, SF), "quality")
    assert accuracy > 0.97 and test[test.quality == 1].predicted.mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    accuracy, test = held_out(spark, toxicity.op1_toxicity(spark, SF), "toxic")
    assert accuracy > 0.85 and test[test.toxic == 1].score.mean() > test[test.toxic == 0].score.mean() + 0.3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (7, 0, 0), (8, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = module.train(table(spark), labels, F.lit(True))
    got = module.score_documents(table(spark, extra="score lang"), model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["lang"] == "kept" for r in got)
    assert len({r["score"] for r in got if r["text"] == "The cat sat on the mat."}) == 1
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[2] == by[3]
    assert module.score_documents(table(spark).limit(0), model).collect() == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_with_one_class(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in module.score_documents(table(spark), module.train(table(spark), none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in module.score_documents(table(spark), module.train(table(spark), one, F.lit(True))).collect()} == {1}


def test_interactions_are_learned():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y).score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_keep_good_keeps_columns(spark):
    model = quality.Gam([np.array([])] * len(quality.FEATURES), 1.0, np.zeros((len(quality.FEATURES), quality.BINS)), [])
    docs = table(spark, extra="score")
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs, model).count() == 10
    model.bias = -1.0
    assert quality.keep_good(docs, model).count() == 0


def test_toxic_words_of_three_letters():
    assert toxicity.fragments("Zug, xylophonist ab") == {" zug", " zug "} | {" xylophonist"[:k] for k in range(4, 11)}  # with the space
    r = np.random.default_rng(0)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts = [" ".join([*r.choice(words, 20), *(["zqx"] if i % 2 else []), *r.choice(words, 3)]) for i in range(400)]
    model = toxicity.fit(texts[:300], np.arange(300) % 2.0)
    scorer = toxicity.Scorer(model)
    assert b" zqx " in model.toxic
    assert np.mean([(scorer.score(scorer.evidence(t)) >= 0.5) == i % 2 for i, t in enumerate(texts[300:])]) > 0.9


def test_trainer_gets_all_windows(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples, level: seen.extend(samples) or toxicity.zstandard.ZstdCompressionDict(b"x" * 10))
    toxicity._trained([b"w"] * 200_001)
    assert len(seen) == 200_001


def test_score_by_brute_force_from_stored_dictionaries(spark):
    docs, labels = load(spark, "/root/testdata/sf0.001", "documents"), load(spark, "/root/testdata/sf0.001", "labels")
    m = toxicity.train(docs, labels, F.lit(True))
    params = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, window_log=16, hash_log=15, chain_log=15, search_log=8, write_checksum=False, write_content_size=False, write_dict_id=False
    )

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    for r in toxicity.score_documents(docs.limit(40), m).collect():
        words = (r["text"] or "").lower().split()
        cut = [(" " + " ".join(words[i : i + 12]) + " ").encode() for i in range(0, len(words), 12)]
        d = [size(w, m.ordinary) - size(w, m.toxic) for w in cut]
        x = [min(max(d), 12), sum(max(v, 0) for v in d) / len(d), math.log(1 + len(d)), *(sum(v >= t for v in d) ** 0.5 for t in (1, 2, 4))] if d else [0.0] * 6
        z = m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], x, m.mean, m.scale, strict=True))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_training_bytes_are_bounded(spark):
    rows = [(1, "vile words here"), (2, "kind words here"), (3, "x " * toxicity.LONGEST)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = toxicity.train(docs, labels, F.lit(True))
    assert (seen.weights == toxicity.train(docs.filter("doc_id < 3"), labels, F.lit(True)).weights).all()
    assert len(toxicity.score_documents(docs, seen).collect()) == 3


def test_quality_by_brute_force_from_stored_tables(spark):
    docs, labels = load(spark, "/root/testdata/sf0.001", "documents"), load(spark, "/root/testdata/sf0.001", "labels")
    m = quality.train(docs, labels, F.lit(True))
    assert m.pairs
    for r in quality.score_documents(docs, m).collect():
        x = quality.features(r["text"] or "")
        b = [sum(e <= v for e in edges) for v, edges in zip(x, m.edges, strict=True)]
        z = m.bias + sum(m.mains[j][k] for j, k in enumerate(b)) + sum(cells[b[i]][b[j]] for i, j, cells in m.pairs)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r["predicted"] == (r["score"] >= 0.5)
    kept = {r["doc_id"] for r in quality.keep_good(docs, m).collect()}
    assert kept == {r["doc_id"] for r in quality.score_documents(docs, m).filter("score >= 0.5").collect()}
