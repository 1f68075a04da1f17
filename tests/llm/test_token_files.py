import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from recollex.llm._bpe import SPACE
from recollex.llm._planes import Reader, Writer
from recollex.llm._words import WordEncoder
from recollex.llm.bpe import default_path
from recollex.llm.token_files import read_token_files, write_token_files
from recollex.session import new_path
from tests.llm.helpers import AWKWARD, table

PATH = default_path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("width,top", [(2, 49408), (4, 1 << 32)])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 4097, 10_000])
def test_round_trip(bits, width, top, n):
    r, out = np.random.default_rng(n), io.BytesIO()
    docs = [r.integers(0, top, k).astype(f"<u{width}") for k in (n, 0, 3, n // 2)]
    w = Writer(out, width=width, bits=bits, block=4096)
    for i, d in enumerate(docs):
        w.add(None if i == 1 else i, d)
    w.close()
    raw = out.getvalue()
    got = list(Reader(io.BytesIO(raw), len(raw)).documents())
    assert [i for i, _ in got] == [0, None, 2, 3]
    for d, (_, parts) in zip(docs, got, strict=True):
        assert (np.concatenate([np.zeros(0, np.uint32), *parts]) == d).all()


def test_words_equal_library():
    library, e, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(5)
    letters = ["\x01", "<|endoftext|>", "'ll", "\x1c", "​", "﻿", "é", "ﬁ", "İ", "͸", *SPACE, "\u0301", "Ɓ", "Ə", "Ⱥ", "Ʒ", ". ", ", ", ".\n", "., ", "'. ", "<|ENDOFTEXT|>", *"ab'SDLL éÉÀ̈ßΣσ12.!<|>漢ªº²½ŉ"]
    for _ in range(1500):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(e.encode([x])[0], "<u2").tolist() == list(library.encode(x, add_special_tokens=False).ids), x


def test_every_character_equals_library():
    library, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    texts = [x for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 for x in (f"ab{c}cd", f"x {c} Y", f"a{c}. b{c}, ")]
    texts += [f"ab{chr(c)}cd" for c in range(0x10000, 0x20000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, got, ids in zip(texts, e.encode(texts), want, strict=True) if np.frombuffer(got, "<u2").tolist() != ids]
    assert wrong == []


def test_capitals_and_marks_equal_library():
    """Capitals before and after every character, and every two ASCII characters beside a letter and a digit."""
    library, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    texts = [f"AB{chr(c)}CD W{chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts += [f"ab{chr(a)}{chr(b)}c X1{chr(b)}{chr(a)} é{chr(a)}{chr(b)}" for a in range(128) for b in range(128)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, got, ids in zip(texts, e.encode(texts), want, strict=True) if np.frombuffer(got, "<u2").tolist() != ids]
    assert wrong == []


def test_array_with_nulls_and_slices():
    library, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    texts = [None, "", "  ", " A b\n", None, "<|endoftext|>x", "Ḧ H\u0331 y'all've", "tail  "]
    for array in (pa.array(texts), pa.array(["before", *texts, "after"]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None, " "])):
        got = e.encode_array(array).to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [list(library.encode(t or "", add_special_tokens=False).ids) for t in array.to_pylist()]


def test_documents_equal_library():
    library, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    got = [raw for i in range(0, len(texts), 64) for raw in e.encode(texts[i : i + 64])]
    for raw, want in zip(got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == want.ids


def test_remembered_words_are_bounded(monkeypatch):
    from recollex.llm import _words

    monkeypatch.setattr(_words, "KNOWN_WORDS", 5)
    library, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for t in ("a b c", "b c d e", "e f g h i j k", "x" * 100 + " a", "a b"):
        assert np.frombuffer(e.encode([t])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(e.known) <= 5 and all(len(w) <= _words.LONGEST for w in e.known)


def test_files(spark):
    folder, library = new_path(spark, "t"), Tokenizer.from_file(PATH)
    files = write_token_files(table(spark), folder, PATH, pieces=3)
    got = sorted(read_token_files(spark, folder, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    at, texts = 0, dict(AWKWARD)
    for r in got:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert r["ids"] == ids and (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark):
    folder = new_path(spark, "t")
    files = write_token_files(table(spark).limit(0), folder, PATH)
    assert read_token_files(spark, folder, files).collect() == []
