import hashlib
import random

import pytest
from tokenizers import Tokenizer

from recollex.llm._bpe import ByteBPE, sure_border
from recollex.llm.bpe import default_path, encode_documents
from tests.llm.helpers import AWKWARD, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


ALPHABETS = ["abcdefgh", "ab '", "'sltrevedm x", " \n\t", "aé漢字ßñ'1 2", "  　a\x85b1!?", "0123456789abcdef", "ÀÉ̀́ªºⅫ²٣३ "]


def noise(r):
    if r.random() < 0.3:
        return "".join(r.choice(["<|endoftext|>", "it's", "'ll", " ", "  ", "foo", "bar12", "!!", "é", "thethe", "\n"]) for _ in range(r.randint(0, 60)))
    letters = r.choice(ALPHABETS)
    return "".join(r.choice(letters) for _ in range(r.randint(0, 300)))


def test_tree_equals_library_at_tiny_leaves(library):
    bpe, r = ByteBPE(default_path(), leaf=16), random.Random(3)
    for _ in range(1500):
        x = noise(r)
        want = library.encode(x, add_special_tokens=False).ids
        assert bpe.encode(x) == list(want), x
        assert bpe.decode(bpe.encode(x)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["abcdefghij" * 3000, " " * 20_000, "a" * 30_001, "é" * 9000, "1" * 9000, "!?" * 9000])
def test_long_unsplit_texts(library, text):
    bpe = ByteBPE(default_path(), leaf=512)
    assert bpe.encode(text) == list(library.encode(text, add_special_tokens=False).ids)


def test_sure_borders():
    assert sure_border("a", " ") and sure_border("a", "1") and sure_border("1", "a") and sure_border("a", "!") and sure_border("!", "a")
    assert not sure_border(" ", "a") and not sure_border(" ", " ") and not sure_border("'", "s") and not sure_border("a", "b")


def test_awkward_rows(spark, library):
    got = encode_documents(table(spark, extra="n_tokens lang"), default_path()).collect()
    assert sorted(got[0].asDict()) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "lang", "n_tokens", "text"]
    for (_, text), r in zip(AWKWARD, sorted(got, key=lambda r: [x for _, x in AWKWARD].index(r["text"])), strict=False):
        assert r["lang"] == "kept"
    for r in got:
        ids = list(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert encode_documents(table(spark).limit(0)).collect() == []
