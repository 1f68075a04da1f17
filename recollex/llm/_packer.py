"""Cuts of a token stream into windows, by order-preserving dynamic programming.

``f[j]`` is the least cost of a stream cut at place ``j``; a window from ``i`` to ``j`` of ``u <= size`` tokens costs
its padding ``size - u`` (a power of two has none, but ``SPLIT``) and what the cut at ``j`` breaks: nothing at the end of a document,
``SENTENCE`` at the end of a sentence, ``INSIDE`` elsewhere.  Padding is ``(f[i] + i) + size - j``, so the best start is the least
``f[i] + i`` over a window of starts that moves with ``j``, which a queue of rising values holds: each start enters and leaves it once.

A stream is cut in chunks: once a chunk is solved, its cuts are settled but for the last few windows, which are solved again with what follows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Costs in tokens of padding.
SENTENCE, INSIDE, SPLIT = 4, 32, 8
#: At most one sentence end in so many tokens is a place to cut; without one for GAP tokens every EVERY-th token is.
GRAIN, GAP, EVERY = 32, 256, 64
#: Tokens that are solved together, at least, and those at their end whose cuts are not settled yet.
CHUNK, OPEN = 1 << 19, 1 << 14


def places(ends: np.ndarray, sentences: np.ndarray, last: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places to cut, cost of each): ``ends`` of documents, rising, the last one the end of the stream, and of sentences."""
    total = int(ends[-1])
    sentences = sentences[np.unique(sentences // GRAIN, return_index=True)[1]] if len(sentences) else sentences
    soft = np.unique(np.concatenate([ends, sentences]))
    starts = np.concatenate([[0], soft[:-1]])
    wide = np.flatnonzero(soft - starts > GAP)
    inside = [np.arange(a + EVERY, b, EVERY) for a, b in zip(starts[wide].tolist(), soft[wide].tolist(), strict=True)]
    if last:  # the stream's end can be made of powers of two
        inside.append(np.arange(max(1, total - size), total))
    every = np.unique(np.concatenate([soft, *inside]))
    cost = np.full(len(every), INSIDE, np.int64)
    cost[np.searchsorted(every, sentences)] = SENTENCE
    cost[np.searchsorted(every, ends)] = 0
    return every, cost


def cuts(every: np.ndarray, cost: np.ndarray, size: int, last: bool) -> tuple[list[int], list[int]]:
    """(f, before): the least cost of a stream that is cut at each place, and the number of the place before; place 0 is the start."""
    at, price = [0, *every.tolist()], [0, *cost.tolist()]
    where, total = np.array(at), at[-1]
    powers = [1 << k for k in range(size.bit_length() - 1)]
    found: dict[int, list[int]] = {}
    for p in powers if last else powers[-2:]:
        # short powers only help the end of the stream
        j0 = 0 if p >= size // 4 else int(np.searchsorted(where, total - size))
        want = where[j0:] - p
        i = np.searchsorted(where, want)
        for j, k in zip((np.flatnonzero(where[i] == want) + j0).tolist(), i[where[i] == want].tolist(), strict=True):
            found.setdefault(j, []).append(k)
    f, before = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f[i] + at[i], i), rising in both
    for j in range(1, len(at)):
        here = at[j]
        least = here - size
        while at[queue[0][1]] < least:
            queue.popleft()
        value, i = queue[0]
        best = value + size - here
        if j in found:
            for k in found[j]:
                if f[k] + SPLIT < best:
                    best, i = f[k] + SPLIT, k
        best += price[j]
        f[j], before[j] = best, i
        best += here
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    return f, before


class Packer:
    """Takes documents in order and gives pieces (doc, start, length, crc32, doc_tokens, sequence, offset), sequences from 0 on."""

    def __init__(self, sentence_end: np.ndarray, size: int = 2048, chunk: int = CHUNK):
        self.sentence_end, self.size, self.chunk = sentence_end, size, chunk
        self.docs: list[tuple] = []  # (doc_id, ids, of these already given)
        self.waiting = self.sequence = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        if self.waiting >= self.chunk:
            yield from self._solve(False)

    def close(self) -> Iterator[tuple]:
        if self.waiting:
            yield from self._solve(True)

    def _solve(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([x[done:] for _, x, done in self.docs])
        ends = np.cumsum([len(x) - done for _, x, done in self.docs])
        every, cost = places(ends, np.flatnonzero(self.sentence_end[ids]) + 1, last, self.size)
        f, before = cuts(every, cost, self.size, last)
        at, total = [0, *every.tolist()], int(ends[-1])
        j = len(at) - 1 if last else min((k for k in range(int(np.searchsorted(at, total - self.size)), len(at))), key=f.__getitem__)
        chosen = []
        while j:
            chosen.append(at[j])
            j = before[j]
        chosen.reverse()
        yield from self._give(chosen if last else [c for c in chosen if c <= total - OPEN])

    def _give(self, chosen: list[int]) -> Iterator[tuple]:
        n, now, made = 0, 0, 0
        doc, ids, done = self.docs[0]
        for cut in chosen:
            offset = 0
            while now < cut:
                if done == len(ids):
                    n += 1
                    doc, ids, done = self.docs[n]
                length = min(cut - now, len(ids) - done)
                part = ids[done : done + length]
                yield doc, done, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence + made, offset
                done, offset, now = done + length, offset + length, now + length
            made += 1
        self.sequence += made
        self.waiting -= now
        self.docs = [(doc, ids, done), *self.docs[n + 1 :]] if done < len(ids) else self.docs[n + 1 :]
