import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from recollex.llm.filter_audit import audit, marked, mask_counts
from tests.llm.helpers import AWKWARD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, s in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {s for s, *_ in rows}:
        mine = [x for x in rows if x[0] == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                shapley[f] += len(gone)
                kept = [x for x in left if not x[1][f]]
                redundant = sum(x[1][f] for x in mine) - len(gone)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                out[part, "".join(order), step + 1] = [len(kept), len(gone), redundant, unique, sum(x[2] for x in gone), sum(x[3] for x in gone), f]
                left = kept
        for k in out:
            if k[0] == part:
                out[k][6] = shapley[out[k][6]] if isinstance(out[k][6], str) else out[k][6]
    return out


DOCS = [(d, t, s) for (d, t), s in zip(AWKWARD, ["a", None, "", "a", "b", "a", "b", "a", "b", "a"], strict=True)]
DOCS += [(100 + i, "same text over and over", "a") for i in range(20)] + [(130 - i, " ".join(f"w{k % (50 + i)}" for k in range(220)), "b") for i in range(5)]
DOCS += [(200, "x" * 5000 + "tail one", "b"), (201, "x" * 5000 + "tail two", "b"), (202, "x" * 5000 + "tail one", "a"), (1, "The cat sat on the mat.", "z"), (-5, "the END & more", "z")]
LABELS = [(1, 1, 0), (2, 0, 1), (100, 1, 1), (101, 1, 1), (101, 0, 0), (None, 1, 1), (6, None, 1), (201, 1, None)]


def frames(spark, docs=DOCS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit(3), "_first": F.lit("clash"), "good": F.lit(1)}), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_equals_brute_force(spark):
    docs, labels = frames(spark)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(mask_counts(docs, labels)).collect()}
    assert got == brute(DOCS, LABELS)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c) % 2])
def test_duplicates_also_when_hashes_clash(spark, digest):
    docs, _ = frames(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.duplicate) for r in marked(docs, {"text": F.col("text")}, digest).collect())
    first = {}
    for d, t, _ in DOCS:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    assert got == sorted((d is None, d or 0, t or "", d is not None and d > first[t or ""]) for d, t, _ in DOCS)


def test_empty_table(spark):
    docs, labels = frames(spark)
    assert audit(mask_counts(docs.limit(0), labels)).collect() == []
    assert len(audit(mask_counts(docs, labels.limit(0))).collect()) == 600 * 4
