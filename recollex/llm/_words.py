"""Encoding by the tokenizers library with a vocabulary whose words never span white space, each distinct word of a worker once.

The vocabulary's normaliser works on characters between white space, its splitting pattern matches no white space,
and none of its special tokens has any.  So a text's ids are those of its white-space separated words in order, and the
library encodes each of these as a text of its own.  So that fewer of them differ, ASCII letters are made small first, as the
normaliser would, and words of plain characters are cut where the splitting pattern cuts them anyway.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Small letters that the normaliser leaves alone, and marks that the splitting pattern takes in runs (no apostrophe, which may
#: begin a piece of its own, and no bar, which special tokens have).
LETTERS, MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{}~"
PLAIN = re.compile(f"[{LETTERS}0-9{MARKS}]+").fullmatch
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+").findall
PIECE = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+").fullmatch
#: Texts that keep their capitals: a capital and its small letter can join differently with a combining mark, and special tokens
#: are found before letters are made small.
KEPT = "[\u0300-\u036f]|<[|]"
#: Bounds of what a worker remembers: so many words, none longer.
KNOWN_WORDS, LONGEST = 1 << 19, 64


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.between = "<|endoftext|>"
        self.cut = self.library.token_to_id(self.between)
        self.last = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.last[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _joined(self, words: list[str], between: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of every word as little-endian numbers of ``width`` bytes; the library encodes many in one call.

        A piece by the splitting pattern ends in the one token that ends a word.  What may be several pieces is parted by a
        special token: the library cuts a text at these before all else and encodes what is between them by itself.
        """
        w, out = self.width, {}
        pieces = [x for x in words if PIECE(x)]
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            ids = self._joined(part, " ")
            ends, raw = (np.flatnonzero(self.last[ids]) + 1).tolist(), ids.tobytes()
            for word, start, end in zip(part, [0, *ends[:-1]], ends, strict=True):
                out[word] = raw[start * w : end * w]
        others = [x for x in words if x not in out and "<|" not in x]
        for i in range(0, len(others), 1000):
            part = others[i : i + 1000]
            ids = self._joined(part, self.between)
            cuts, raw = np.flatnonzero(ids == self.cut).tolist(), ids.tobytes()
            for word, start, end in zip(part, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
                out[word] = raw[start * w : end * w]
        for word in words:
            if word not in out:
                out[word] = self._joined([word], "").tobytes()
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different words."""
        out = [self.known.get(word) for word in words]
        parts = {i: PIECES(words[i]) if PLAIN(words[i]) else [words[i]] for i, ids in enumerate(out) if ids is None}
        needed = set().union(*parts.values())
        ids = {x: v for x in needed if (v := self.known.get(x)) is not None}
        fresh = self._learn([x for x in needed if x not in ids])
        ids |= fresh
        for i, pieces in parts.items():
            out[i] = b"".join([ids[x] for x in pieces])
        self.known.update((x, v) for x, v in fresh.items() if len(x) <= LONGEST)
        if len(self.known) > KNOWN_WORDS:  # what this batch has is what others are likely to have
            here = {x: v for x in [*needed, *words] if (v := self.known.get(x)) is not None}
            self.known = dict(islice(here.items(), KNOWN_WORDS))
        return out

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: none) as little-endian numbers of ``width`` bytes."""
        texts = texts.fill_null("")
        texts = pc.if_else(pc.match_substring_regex(texts, KEPT), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        if len(ids) == 0:
            return pa.array([b""] * len(texts), pa.binary())
        # the words' ids stand one after the other already: a text's are those from its first word on to the next text's
        _, places, data = ids.buffers()
        at = np.frombuffer(places, "<i4", len(ids) + 1)[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), data])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``width`` bytes."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()
