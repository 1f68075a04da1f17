"""The bit-plane file format for token ids.

    file    magic, blocks, directory, footer
    block   up to BLOCK ids; the ids' bits (or bytes) transposed into planes, lowest first, each plane a zstandard frame
    directory  zstandard frame of: for each block its offset, number of ids and the length of each plane; doc ids; tokens of each document
    footer  offset and length of the directory, magic

All numbers are little-endian.  Blocks are decoded one by one, so neither side holds a file's ids at once.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"RCXPLANE"
BLOCK = 1 << 16
NULL_ID = -(1 << 63)


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """Planes of one block; ``width`` is the number of bytes an id takes."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        cells = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(cells, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(n).astype(np.uint32)


@dataclass
class Writer:
    """Streams documents to ``out``; ``close`` writes what is left and the directory."""

    out: BinaryIO
    width: int = 2
    bits: bool = False
    level: int = 1
    block: int = BLOCK
    at: int = 0
    total: int = 0
    _left: list[np.ndarray] = field(default_factory=list)
    _n_left: int = 0
    _blocks: list[list[int]] = field(default_factory=list)
    _docs: list[int] = field(default_factory=list)
    _counts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._zstd = zstandard.ZstdCompressor(level=self.level)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(NULL_ID if doc_id is None else doc_id)
        self._counts.append(len(ids))
        self.total += len(ids)
        self._left.append(ids)
        self._n_left += len(ids)
        if self._n_left >= self.block:
            waiting = np.concatenate(self._left)
            whole = len(waiting) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(waiting[i : i + self.block])
            self._left, self._n_left = [waiting[whole:]], len(waiting) - whole

    def _flush(self, ids: np.ndarray) -> None:
        frames = [self._zstd.compress(p) for p in to_planes(ids, self.width, self.bits)]
        self._blocks.append([self.at, len(ids), *map(len, frames)])
        for f in frames:
            self._put(f)

    def close(self) -> None:
        if self._n_left:
            self._flush(np.concatenate(self._left))
        head = struct.pack("<BBIQQ", self.width, self.bits, self.block, len(self._blocks), len(self._docs))
        tables = [np.array(self._blocks, dtype="<u8").tobytes(), np.array(self._docs, dtype="<i8").tobytes(), np.array(self._counts, dtype="<u8").tobytes()]
        directory, begin = self._zstd.compress(head + b"".join(tables)), self.at
        self._put(directory)
        self._put(struct.pack("<QQ", begin, len(directory)) + MAGIC)


class Reader:
    """Random access by the chunk index, and a stream of whole documents."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        source.seek(size - 24)
        begin, length, magic = struct.unpack("<QQ8s", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(begin)
        self._zstd = zstandard.ZstdDecompressor()
        raw = self._zstd.decompress(source.read(length))
        self.width, self.bits, self.block, n_blocks, n_docs = struct.unpack_from("<BBIQQ", raw)
        planes = self.width * (8 if self.bits else 1)
        at = struct.calcsize("<BBIQQ")
        self.blocks = np.frombuffer(raw, "<u8", n_blocks * (2 + planes), at).reshape(n_blocks, 2 + planes)
        at += self.blocks.nbytes
        self.docs = np.frombuffer(raw, "<i8", n_docs, at)
        self.counts = np.frombuffer(raw, "<u8", n_docs, at + self.docs.nbytes)

    def ids(self, block: int) -> np.ndarray:
        offset, n, *lengths = (int(x) for x in self.blocks[block])
        self.source.seek(offset)
        data, at, planes = self.source.read(sum(lengths)), 0, []
        for length in lengths:
            planes.append(self._zstd.decompress(data[at : at + length]))
            at += length
        return from_planes(planes, n, self.width, bool(self.bits))

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(doc_id, pieces of its ids), in order; a piece lies in one block."""
        block, now, at = 0, np.zeros(0, np.uint32), 0
        for doc, count in zip(self.docs.tolist(), self.counts.tolist(), strict=True):
            pieces = []
            while count:
                if at == len(now):
                    now, at, block = self.ids(block), 0, block + 1
                pieces.append(now[at : at + count])
                at += len(pieces[-1])
                count -= len(pieces[-1])
            yield (None if doc == NULL_ID else doc), pieces


def encoded(ids: np.ndarray, **options) -> bytes:
    """One document's ids as a file of its own."""
    out = io.BytesIO()
    w = Writer(out, **options)
    w.add(0, ids)
    w.close()
    return out.getvalue()
