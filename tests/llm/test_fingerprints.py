import hashlib

from recollex.llm import fingerprints as fp
from recollex.llm._ordered import map_with_next
from recollex.llm._shingles import shingle_hashes
from tests.llm.helpers import AWKWARD, table
from pyspark.sql import functions as F


def exact(a, b, size=5):
    x, y = (set(shingle_hashes(t.encode().lower().split(), size).tolist()) for t in (a, b))
    return len(x & y) / min(len(x), len(y))


def test_containment_estimate():
    words = [f"w{i}" for i in range(20_000)]
    book, page = " ".join(words), " ".join(words[5000:6000])
    a, b = fp.Sketch.of(book), fp.Sketch.of(page)
    assert abs(len(a.kept) / a.count - 1 / fp.SCALE) < 0.02
    assert b.containment(a) == 1.0 and a.containment(b) == 1.0 and a.jaccard(b) < 0.1
    mixed = " ".join(words[5500:6500])
    assert abs(fp.Sketch.of(page).containment(fp.Sketch.of(mixed)) - exact(page, mixed)) < 0.15


def test_merge_and_parse():
    left, right = " ".join(f"a{i}" for i in range(500)), " ".join(f"b{i}" for i in range(500))
    whole = fp.Sketch.of(left + " " + right)
    union = fp.merged(fp.Sketch.of(left).kept, fp.Sketch.of(right).kept)
    assert set(union.tolist()) <= set(whole.kept.tolist()) and len(whole.kept) - len(union) <= 4
    again = fp.Sketch.parse(str(whole))
    assert str(again) == str(whole) and again.jaccard(whole) == 1.0


def test_empty_sketches():
    nothing, same, other = fp.Sketch.of(""), fp.Sketch.of(" "), fp.Sketch.of("a b c d e")
    assert nothing.containment(same) == 1.0 and (len(other.kept) or nothing.containment(other) == 0.0)


def test_next_document(spark):
    rows = AWKWARD
    docs = table(spark).withColumn("_tie", F.xxhash64("text"))
    got = map_with_next(docs, "doc_id", "_tie", fp._edited, fp.EDITED, pieces=3).collect()
    assert len(got) == len(rows)
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["_tie"]))
    want = []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        x, y = a["text"] or "", b["text"] or ""
        half = len(x) // 2
        e = x[: len(x) - half] + y[:half]
        want.append((str(a["doc_id"]), len(x), hashlib.sha256(e.encode()).hexdigest(), str(fp.Sketch.of(x)), str(fp.Sketch.of(e))))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == sorted(want)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    assert map_with_next(one, "doc_id", "_tie", fp._edited, fp.EDITED).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert map_with_next(one.limit(0), "doc_id", "_tie", fp._edited, fp.EDITED).collect() == []


def test_other_columns(spark):
    got = fp.fingerprint_documents(table(spark, extra="fingerprint lang"))
    assert got.columns == ["doc_id", "text", "lang", "fingerprint"] and got.count() == 10
    assert len({r["fingerprint"] for r in got.collect() if r["text"] == "The cat sat on the mat."}) == 1


def test_short_texts_have_sketches():
    texts = [" ".join(f"{i}w{k}" for k in range(14)) for i in range(200)]
    sketches = [fp.Sketch.of(t) for t in texts]
    assert sum(not len(s.kept) for s in sketches) <= 5
    near = [fp.Sketch.of(t + " one more") for t in texts]
    assert sum(a.containment(b) == 1.0 for a, b in zip(sketches, near, strict=True)) >= 195
