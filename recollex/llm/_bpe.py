"""Byte-level BPE of one text by tree concatenation, with the ranks of a public vocabulary.

A text longer than ``leaf`` code points is halved until the halves fit, all leaves are encoded as texts of
their own in parallel, and neighbours are joined upwards: a window around the join is encoded anew, and
grows until the old ids on the left and those on the right are met again at a place that proves both sides
exact, or until it holds both halves whole.

Two kinds of place prove it.  (1) A sure border: two neighbouring characters between which the splitting
pattern always cuts, whatever stands around them (something other than white space before white space; a
letter or other character beside a digit; and so on).  Encoding is independent on its two sides.  (2) Inside
one run of letters a token with the same place and id in both encodings: a sequence of tokens in one piece
is the piece's encoding if and only if each two neighbours are the encoding of their joined text, so
sequences that share a token can be joined there.
"""

from __future__ import annotations

import base64
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import tiktoken

#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as the pattern's \s has it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def kind(c: str) -> str:
    """s: white space, L: letter, N: number, q: apostrophe, o: other."""
    if c in SPACE:
        return "s"
    if c.isalpha():
        return "L"
    if c.isnumeric():
        import unicodedata

        return "N" if unicodedata.category(c)[0] == "N" else "L" if unicodedata.category(c)[0] == "L" else "o"
    return "q" if c == "'" else "o"


def sure_border(before: str, after: str) -> bool:
    a, b = kind(before), kind(after)
    if b == "s":
        return a != "s"
    if a == "s":
        return False  # a space may belong to what follows it
    if {a, b} == {"L", "N"}:
        return True
    if b in "oq":
        return a in "LN"
    return a == "o"  # not after an apostrophe, which may begin 's, 't ...


@dataclass
class Piece:
    """A text and its exact ids."""

    text: str
    ids: list[int]


class ByteBPE:
    """Encoder and decoder for one vocabulary of the tokenizers library's JSON format (byte level)."""

    def __init__(self, path: str, leaf: int = 4096, threads: int | None = None):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = {c: b for b, c in _byte_letters().items()}
        vocab = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in back for c in token)}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        for token, i in self.special.items():
            vocab.pop(token.encode(), None)
        # ranks must equal ids, or merges would be tried in another order than the file's
        order = {a + b if isinstance(a, str) else a[0] + a[1]: n for n, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])}
        ids = [vocab[bytes(back[c] for c in t)] for t in order]
        assert ids == sorted(ids), "merges are not in the order of ids"
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.leaf = leaf
        self.threads = threads or min(2, os.cpu_count() or 1)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._pool: ThreadPoolExecutor | None = None

    # one text of its own

    def piece(self, text: str) -> Piece:
        return Piece(text, self.encoding.encode_ordinary(text))

    def _head(self, p: Piece, reach: int) -> dict[int, int]:
        """For the tokens that begin in the first ``reach`` code points: where each begins, and which it is.

        Tokens that begin inside a code point are left out: no border is there.
        """
        found, at = {}, 0
        for k, i in enumerate(p.ids):
            if at >= reach:
                break
            token = self.bytes_of[i]
            if (token[0] & 0xC0) != 0x80:
                found[at] = k
            at += sum((b & 0xC0) != 0x80 for b in token)
        return found

    def _tail(self, p: Piece, reach: int) -> dict[int, int]:
        """The same for the tokens that begin in the last ``reach`` code points, last first."""
        found, at = {}, len(p.text)
        for k in range(len(p.ids) - 1, -1, -1):
            token = self.bytes_of[p.ids[k]]
            at -= sum((b & 0xC0) != 0x80 for b in token)
            if at < len(p.text) - reach:
                break
            if (token[0] & 0xC0) != 0x80:
                found[at] = k
        return found

    def join(self, left: Piece, right: Piece) -> Piece:
        """The exact encoding of both texts together."""
        cut, reach = len(left.text), 32
        while True:
            window = self.piece(left.text[-reach:] + right.text[:reach])
            a = max(0, cut - reach)  # where the window begins
            here = self._head(window, len(window.text))
            letters = all(kind(c) == "L" for c in window.text)
            sure = lambda s: sure_border(window.text[s - 1], window.text[s])
            lefts, rights = self._tail(left, reach), self._head(right, reach)
            same = lambda s, ids, k: letters and window.ids[here[s]] == ids[k]
            begin = (0, 0) if a == 0 else next(((k, here[s]) for at, k in lefts.items() if (s := at - a) in here and s > 0 and (sure(s) or same(s, left.ids, k))), None)
            whole = len(right.text) <= reach
            end = (len(window.ids), len(right.ids)) if whole else next(((here[s], k) for at, k in rights.items() if (s := at + cut - a) in here and at > 0 and (sure(s) or same(s, right.ids, k))), None)
            if begin is not None and end is not None:
                return Piece(left.text + right.text, left.ids[: begin[0]] + window.ids[begin[1] : end[0]] + right.ids[end[1] :])
            reach *= 2

    # whole texts

    def _leaves(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return [text]
        half = len(text) // 2
        return [*self._leaves(text[:half]), *self._leaves(text[half:])]

    def _tree(self, text: str) -> list[int]:
        parts = self._leaves(text)
        if len(parts) == 1:
            return self.encoding.encode_ordinary(text)
        if len(parts) > 8 and self.threads > 1:
            self._pool = self._pool or ThreadPoolExecutor(self.threads)
            level = list(self._pool.map(self.piece, parts))
        else:
            level = [self.piece(p) for p in parts]
        while len(level) > 1:  # neighbours, pair by pair; an odd one waits for the next level
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0].ids

    def encode(self, text: str) -> list[int]:
        """Ids as the tokenizers library gives them without special tokens added; their strings in a text are one id."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._tree(text)
        out: list[int] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._tree(part))
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which the strings of special tokens are text like any other."""
        return self._tree(text)

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids joined; what is no UTF-8 becomes replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
