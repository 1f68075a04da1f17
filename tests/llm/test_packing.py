import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from recollex.llm._packer import INSIDE, SENTENCE, SPLIT, Packer, cuts, places
from recollex.llm.bpe import default_path
from recollex.llm.packing import SIZE, op11_packing, pack, sentence_ends
from tests.llm.helpers import AWKWARD, table


def slow_cost(every, cost, size, powers):
    at, price = [0, *every], [0, *cost]
    f = [0] + [None] * len(every)
    for j in range(1, len(at)):
        best = None
        for i in range(j):
            u = at[j] - at[i]
            if u <= size:
                pad = SPLIT if u in powers else size - u
                pad = min(pad, size - u)
                best = f[i] + pad if best is None else min(best, f[i] + pad)
        f[j] = best + price[j]
    return f


def test_cuts_equal_all_transitions():
    r = random.Random(5)
    for n in range(60):
        size = r.choice([32, 64])
        ends = np.cumsum([r.randint(1, 70) for _ in range(r.randint(1, 25))])
        sentences = np.array(sorted({r.randint(1, int(ends[-1])) for _ in range(10)}))
        every, cost = np.unique(np.concatenate([ends, sentences, np.arange(16, ends[-1], 16)])), None
        cost = np.where(np.isin(every, ends), 0, np.where(np.isin(every, sentences), SENTENCE, INSIDE))
        f, before = cuts(every, cost, size, False)
        assert f == slow_cost(every.tolist(), cost.tolist(), size, {size // 2, size // 4}), n


def test_places_leave_no_wide_gap():
    every, cost = places(np.array([3, 5000]), np.array([40, 50, 4000]), False, 2048)
    assert np.diff([0, *every]).max() <= 256 and dict(zip(every.tolist(), cost.tolist(), strict=True))[3] == 0
    assert dict(zip(every.tolist(), cost.tolist(), strict=True))[4000] == SENTENCE


def test_chunks_change_little():
    r = np.random.default_rng(1)
    stop = np.zeros(1 << 16, bool)
    stop[:3000] = True
    docs = [r.integers(0, 50_000, int(n)) for n in r.integers(1, 3000, 400)]
    used = []
    for chunk in (1 << 16, 1 << 30):
        packer, rows = Packer(stop, chunk=chunk), []
        for k, ids in enumerate(docs):
            rows += packer.add(k, ids)
        rows += packer.close()
        assert sum(x[2] for x in rows) == sum(map(len, docs))
        used.append(max(x[5] for x in rows) + 1)
    assert abs(used[0] - used[1]) <= 0.05 * used[1]


def check_pieces(rows, want):
    """want: (doc_id, ids) of every document."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append((x.offset, x.length))
    by = defaultdict(list)
    for doc, ids in want:
        by[doc, len(ids)].append(ids)
    for x in rows:
        assert (x.doc_id, x.doc_tokens) in by
        assert any(zlib.crc32(np.array(i[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 for i in by[x.doc_id, x.doc_tokens])
        docs[x.doc_id].append((x.start, x.length, x.doc_tokens))
    assert sorted((d, sum(l for _, l, _ in v)) for d, v in docs.items() if d is not None) == sorted((d, sum(len(i) for (a, _), v in by.items() if a == d for i in v)) for d in {d for d, _ in want} if d is not None)
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert 0 < at <= SIZE
        padding += 0 if at & (at - 1) == 0 else SIZE - at
    return padding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path("word_bpe_49k.json"))


def test_awkward_rows(spark, library):
    rows = [*AWKWARD, *[(9, f"Hot id number {i}. " * 20) for i in range(60)], *[(None, f"no id {i}") for i in range(30)]]
    got = pack(table(spark, rows, extra="lang start offset"), pieces=6).collect()
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    check_pieces(got, want)
    order = [x.doc_id for x in sorted(got, key=lambda x: (x.sequence_id, x.offset))]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert len({x.sequence_id for x in got if x.doc_id == 9}) > 1


def test_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    got = op11_packing(spark, sf).collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(x.doc_id, [*library.encode(x.text or "", add_special_tokens=False).ids, 1]) for x in texts]
    padding = check_pieces(got, want)
    assert padding <= 0.02 * sum(len(i) for _, i in want)


def test_empty_table_and_sentence_ends(spark, library):
    assert pack(table(spark).limit(0)).collect() == []
    ends = sentence_ends(default_path("word_bpe_49k.json"))
    for text, yes in (("end.", True), ('end."', True), ("end", False), ("why?", True), ("3.5", False)):
        assert ends[library.encode(text, add_special_tokens=False).ids[-1]] == yes
