import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollex.llm import alignment
from recollex.llm.alignment import UNIT, link_documents, op12_alignment
from recollex.llm.bpe import default_path
from recollex.session import settings
from tests.llm.helpers import AWKWARD, table


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))


def letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            back[chr(256 + extra)] = b
            extra += 1
    return back


def brute(rows, both):
    a, b = both
    back = letters()
    raw_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if all(c in back for c in t)}
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    found, count = [], Counter()
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(raw_a[i] for i in x) != want or b"".join(raw_b[i] for i in y) != want:
            x, y = [], []
        ends_a, ends_b, at = [], [], 0
        for i in x:
            ends_a.append(at := at + len(raw_a[i]))
        at = 0
        for i in y:
            ends_b.append(at := at + len(raw_b[i]))
        cuts = sorted({*ends_a} & {*ends_b})
        groups, i, j = [], 0, 0
        for c in cuts:
            g, h = [], []
            while i < len(x) and ends_a[i] <= c:
                g.append(x[i])
                i += 1
            while j < len(y) and ends_b[j] <= c:
                h.append(y[j])
                j += 1
            groups.append((g, h))
        links = [(p, q) for g, h in groups for p in g for q in h]
        count.update(set(links))
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((doc, len(x), len(y), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    return sorted((str(d), n, m, g, len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), h) for d, n, m, g, links, h in found), count


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def noise(r):
    parts = ["  ", " ", "\n", " \n ", "\t", "　", "\xa0", "\x85 ", "a", "the", "The", "'s", "é", "é", "漢字", "12", "3.5", "▁" if r.random() < 0.05 else "x", "<|endoftext|>", "<s>", "<0x0A>", "!!", "🙂", "\x00", "\x1c ", "ing", "tion"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 40)))


def test_units_make_the_text():
    r = random.Random(2)
    for _ in range(500):
        x = " " + noise(r)
        assert "".join(UNIT.findall(x)) == x


def test_awkward_rows_and_noise(spark, both):
    r = random.Random(4)
    rows = [*AWKWARD, (20, "▁"), (21, "a ▁ b"), (22, "▁▁ x"), *[(1000 + i, noise(r)) for i in range(300)]]
    got, pairs = link_documents(table(spark, rows, extra="lang n block unit"), block_rows=40)
    want, count = brute(rows, both)
    assert rows_of(got) == want
    assert {(p.pair >> 20, p.pair & (1 << 20) - 1): p.n for p in pairs.collect()} == count


def test_documents(spark, both):
    sf = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op12_alignment(spark, sf)) == brute(rows, both)[0]


def test_little_is_shuffled(spark):
    """Units go to their places as numbers, a row a block; no text of a unit or of its groups is shuffled again."""
    def shuffled():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before, sf = shuffled(), "/root/testdata/sf0.01"
    op12_alignment(spark, sf).write.format("noop").mode("overwrite").save()
    mine = sum(n for key, n in shuffled().items() if key not in before)
    texts = sum(len(x.text.encode()) for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if x.text)
    assert 0 < mine < 5 * texts


def test_counts_in_parts(spark, both, monkeypatch):
    r = random.Random(6)
    rows = [(i, noise(r)) for i in range(60)]
    monkeypatch.setattr(alignment, "COUNTS", 50)
    assert rows_of(link_documents(table(spark, rows), block_rows=25)[0]) == brute(rows, both)[0]


def test_parts_are_bounded(spark, both, monkeypatch):
    """However few shuffle partitions there are, a bounded number of units is sorted together."""
    align, sizes = alignment.align, []

    def seen(*given):
        found = align(*given)
        sizes.extend(x["count"] for x in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
        return found

    r = random.Random(8)
    rows = [(i, noise(r)) for i in range(200)]
    monkeypatch.setattr(alignment, "PART", 64, raising=False)
    monkeypatch.setattr(alignment, "align", seen)
    with settings(spark, spark__sql__shuffle__partitions="1"):
        assert rows_of(link_documents(table(spark, rows))[0]) == brute(rows, both)[0]
    assert sum(sizes) > 4 * 64 and max(sizes) < 3 * 64


def test_empty_table(spark):
    assert link_documents(table(spark).limit(0))[0].collect() == []
