"""Alignment of two tokenizers' tokens by byte offsets, and counts of the id pairs that it links.

Units.  A is a byte-level BPE whose splitting pattern cuts before a space that follows no white space, and no piece of
B has a space after another character.  So both tokenizers cut a text there, and what lies between two such places, a
unit, has the same tokens, groups and links in every text.  Units repeat as words do: every different one is aligned once.

Alignment is relational: token lists of both sides are exploded with their positions, a window adds up byte lengths, rows that meet on unit and
end are the ends that both sides share, a running count of these cuts is the group of every token, and a unit's tokens are put together by group: in
each group first A's, then B's, so that the list alone tells the groups.  All of it happens where a unit's rows are: they are shuffled once, as lists,
to parts of a bounded number of units, which a task sorts one after the other: its memory doesn't grow with the table or with few shuffle partitions.

Documents.  Texts are cut into units where they are read.  A block, which is one Arrow batch of documents, keeps its different units and, a
document, the numbers of its units in order.  A unit is gathered once, with its places (block and number there), and goes back to these places: a
word has at most one a block, and what goes from one batch of units to one block is one row.  A block's documents are put together from
them in one task.  A pair's count comes from the blocks' counts; it goes back the same way, as sums over the links of a unit, the counts
sent to every task in parts of bounded size.

Cases: null and empty texts have no tokens; neither has a text with a unit whose tokens' bytes are not its own (one that has U+2581);
strings of special tokens are text; a row is a document of its own, whatever its doc_id, so repeated rows repeat their results
and count each; a very long text without spaces is one unit of one task; an empty table gives no rows; only doc_id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from recollex.llm.bpe import default_path, encoder
from recollex.session import importable, settings, table, written

#: Documents and bytes of a block, at most (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: From a space on to the next one that follows a character other than white space.
UNIT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
#: An id pair is one number; a token is its id and its length in one number, and the complement of that for B.
PAIR, SIZE_BITS = 1 << 20, 12
#: Units of documents whose pairs are told apart together; units that are dealt to their blocks together; pairs whose counts are in every task at a time.
AT_ONCE, DEALT, COUNTS = 1 << 18, 1 << 16, 1 << 21
#: Units of a part whose tokens are sorted together, about; parts that a task takes one after the other, at most.
PART, PARTS = 1 << 15, 4

CODED = "block long, n int, doc_id long, codes binary, unit string"
MADE = "block long, n int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long"
SUMS = "block long, n int, n_best long, count_sum long"
PLACES = "places array<struct<block: bigint, n: int>>"


@lru_cache(maxsize=2)
def _pieces(path: str):
    """(processor, UTF-8 bytes of every piece), one for each worker process."""
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    raw = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return b, raw


def _released() -> None:
    """Give memory that is free in this worker back to the machine: a worker outlives its tasks, and would keep the most that any of them took."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def _squeezed(codes: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as byte planes in a zstandard frame."""
    width = np.dtype(kind).itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes())


def _numbers(raw: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind).astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch its documents (n: their number) and its different units (n: their number, the most frequent first)."""
    partition = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        block, lengths, found = partition << 32 | k, [], []
        for text in batch.column("text"):
            mine = UNIT.findall(" " + value) if (value := text.as_py()) else []
            lengths.append(len(mine))
            found.extend(mine)
        words = pa.array(found, pa.string()).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(codes, minlength=len(words.dictionary))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.cumsum([0, *lengths])
        blobs = [_squeezed(rank[codes[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n, u = len(blobs), len(order)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + u, block, np.int64)), pa.array(np.concatenate([np.arange(n), np.arange(u)]).astype(np.int32)),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(u, pa.int64())]), pa.array([*blobs, *[None] * u], pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.string()), words.dictionary.take(pa.array(order))]),
            ], names=["block", "n", "doc_id", "codes", "unit"],
        )
        del found, words, codes, counts, order, rank, blobs
        _released()


def encode_units(units: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """units(unit, places): places and the tokens of A, then of B (id << SIZE_BITS | length in bytes); none if their bytes are not the unit's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (sp, raw_b) = encoder(path_a, 4096), _pieces(path_b)
        raw_a, lone = bpe.bytes_of, sp.piece_to_id("▁")
        size_a, size_b = np.array([len(x) for x in raw_a], np.int32), np.array([len(x) for x in raw_b], np.int32)
        if max(size_a.max(), size_b.max()) >> SIZE_BITS or max(len(size_a), len(size_b)) > PAIR >> 1:
            raise ValueError("a vocabulary with more ids or longer tokens than fit in one number")
        token_a, token_b = (np.arange(len(x), dtype=np.int32) << SIZE_BITS | x for x in (size_a, size_b))
        token = np.concatenate([token_a, ~token_b])
        for batch in batches:
            texts = batch.column("unit").to_pylist()
            a = [bpe.encode_plain(x) for x in texts]
            b = [y if len(x) > 1 else [lone] for x, y in zip(texts, sp.encode([x[1:] for x in texts], num_threads=1), strict=True)]
            whole = [b"".join(map(raw_a.__getitem__, x)) == (t := u.encode()) and b"".join(map(raw_b.__getitem__, y)) == t for x, y, u in zip(a, b, texts, strict=True)]
            ids = [[*x, *(i + len(size_a) for i in y)] if w else [] for x, y, w in zip(a, b, whole, strict=True)]
            at = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = np.array([i for x in ids for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("places"), pa.ListArray.from_arrays(at, pa.array(token[flat]))], names=["places", "tokens"])
            del texts, a, b, whole, ids, at, flat
            _released()

    return units.mapInArrow(run, f"{PLACES}, tokens array<int>")


def align(encoded: DataFrame, parts: int) -> DataFrame:
    """encoded(u, tokens), u unique: u, groups (ids by group, in each those of A and then the complements of B's); units without tokens have no row."""
    rows = encoded.select("u", "tokens").repartition(parts, "u").select("u", F.posexplode("tokens").alias("pos", "t"))
    rows = rows.select("u", "pos", (F.col("t") < 0).alias("b"), F.when(F.col("t") < 0, F.bitwise_not("t")).otherwise(F.col("t")).alias("t"))
    so_far = W.partitionBy("u", "b").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = rows.select("u", "b", F.sum(F.col("t").bitwiseAND((1 << SIZE_BITS) - 1)).over(so_far).alias("end"), F.shiftright("t", SIZE_BITS).alias("id"))
    shared = ends.withColumn("cut", F.count("*").over(W.partitionBy("u", "end")) == 2)  # a side has one token that ends there
    before = W.partitionBy("u").orderBy("end").rangeBetween(W.unboundedPreceding, -1)
    numbered = shared.withColumn("g", F.count(F.when(F.col("cut") & F.col("b"), 1)).over(before))
    each = F.sort_array(F.collect_list(F.struct("g", "b", "end", "id")))
    return numbered.groupBy("u").agg(F.transform(each, lambda x: F.when(x["b"], F.bitwise_not(x["id"])).otherwise(x["id"])).alias("groups"))


def aligned(encoded: DataFrame) -> DataFrame:
    """places, groups of every unit of a written table (none if its tokens are not its bytes)."""
    spark = encoded.sparkSession
    parts = -(-max(1, encoded.count()) // PART)
    groups = F.coalesce("groups", F.array().cast("array<int>")).alias("groups")
    # rows are in order of u where they are gathered; a hash table of lists would sort them once more
    with settings(spark, spark__sql__execution__useObjectHashAggregateExec="false"):
        known = encoded.select("u", "places").join(align(encoded, parts), "u", "left").select("places", groups)
        return written(known.coalesce(max(-(-parts // PARTS), min(parts, 2 * spark.sparkContext.defaultParallelism))), "aligned-units")


def _by_block(places: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, rows that have a place there, their numbers there, ascending)"""
    flat, row = places.flatten(), pc.list_parent_indices(places).to_numpy()
    block, n = (flat.field(c).to_numpy() for c in ("block", "n"))
    order = np.lexsort((n, block))
    blocks, first = np.unique(block[order], return_index=True)
    for x, some in zip(blocks.tolist(), np.split(order, first[1:]) if len(order) else [], strict=True):
        yield x, row[some], n[some]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units' groups at their places: a row a block, with numbers (as steps), sizes and tokens of its units."""
    for batch in batches:
        rows = []
        for block, row, n in _by_block(batch.column("places")):
            lists = batch.column("groups").take(pa.array(row))
            rows.append((block, _squeezed(np.diff(n, prepend=0)), _squeezed(pc.list_value_length(lists).to_numpy()), _squeezed(lists.flatten().to_numpy())))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), *[pa.binary()] * 3)], names=["block", "n", "sizes", "tokens"])


def _column(units: pa.Table, column: str, kind: str = "<u4") -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[_numbers(x.as_py(), kind) for x in units[column]]])


def _places(units: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_numbers(x.as_py())) for x in units["n"]]])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _units(units: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(where the tokens of each of a block's units begin, and the end; all tokens), by the units' numbers."""
    order = np.argsort(_places(units))
    sizes = _column(units, "sizes")
    first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return np.cumsum([0, *sizes]), _column(units, "tokens").astype(np.uint32).view(np.int32).astype(np.int64)[_ranges(first, sizes)]


def _begins(at: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token is the first of its group; of its unit)"""
    unit = np.zeros(len(tokens) + 1, bool)
    unit[at] = True
    unit = unit[:-1]
    return unit | (tokens >= 0) & (np.concatenate([[0], tokens[:-1]]) < 0), unit


def _texts(at: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """The groups of each unit as text."""
    group, unit = _begins(at, tokens)
    ids, turns = np.where(tokens < 0, ~tokens, tokens), (tokens < 0) & (np.concatenate([[0], tokens[:-1]]) >= 0)
    mark = np.where(unit, 0, np.where(group, 1, np.where(turns, 2, 3)))
    most = int(ids.max(initial=0)) + 1
    names = pa.array([f"{m}{i}".encode() for m in ("", ";", "|", ",") for i in range(most)], pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), names.take(pa.array(mark * most + ids))), b"").to_pylist()


def _pairs(at: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the pairs of each unit begin, and the end; all pairs; where its groups begin, and the end)"""
    group, _ = _begins(at, tokens)
    first = np.flatnonzero(group)
    n_b = np.diff(np.concatenate([[0], np.cumsum(tokens < 0)])[np.append(first, len(tokens))])
    n_a = np.diff(np.append(first, len(tokens))) - n_b
    many = n_a * n_b
    inside, of = _ranges(np.zeros(len(many), np.int64), many), np.repeat(np.arange(len(many)), many)
    a, b = tokens[first[of] + inside // n_b[of]], ~tokens[first[of] + n_a[of] + inside % n_b[of]]
    groups = np.concatenate([[0], np.cumsum(group)])[at]
    return np.concatenate([[0], np.cumsum(many)])[groups], a * PAIR + b, groups


def _totals(values: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values[codes])])
    return sums[at[1:]] - sums[at[:-1]]


def _documents(docs: pa.Table, whole: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(codes of each document, without those that have no tokens; all of them; where each begins)."""
    lists = [_numbers(x.as_py()) for x in docs["codes"]]
    lists = [c if whole[c].all() else c[:0] for c in lists]
    return lists, np.concatenate([*lists, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, lists)])


def _together(docs: pa.Table, units: pa.Table) -> pa.Table:
    """One block: a row a document, and a row an id pair with the number of the block's documents that hold it."""
    _released()
    first, tokens = _units(units)
    n, u = docs.num_rows, len(first) - 1
    n_tokens, n_a = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(tokens >= 0)])[first])
    lists, codes, at = _documents(docs, n_a > 0)
    texts = _texts(first, tokens)
    shas = [hashlib.sha256(b";".join(map(texts.__getitem__, c.tolist()))).hexdigest() if len(c) else "" for c in lists]
    del texts
    _released()
    starts, flat, groups = _pairs(first, tokens)
    sums = {c: _totals(v, codes, at) for c, v in (("n_a", n_a), ("n_b", n_tokens - n_a), ("n_groups", np.diff(groups)), ("n_links", np.diff(starts)))}
    different, number = np.unique(flat, return_inverse=True)
    held, first = np.zeros(len(different), np.int64), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + AT_ONCE)) - 1)
        of = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
        mine = np.unique(of * max(u, 1) + codes[at[first] : at[last]])
        of, code = mine // max(u, 1), mine % max(u, 1)
        count = starts[code + 1] - starts[code]
        key = np.unique(np.repeat(of, count) * max(len(different), 1) + number[_ranges(starts[code], count)])
        held += np.bincount(key % max(len(different), 1), minlength=len(different))[: len(different)]
        first = last
    used = np.flatnonzero(held)
    m = len(used)
    block = docs["block"].combine_chunks()
    return pa.table(
        {"block": pa.concat_arrays([block, pa.nulls(m, pa.int64())]), "n": pa.concat_arrays([docs["n"].combine_chunks(), pa.nulls(m, pa.int32())]), "doc_id": pa.concat_arrays([docs["doc_id"].combine_chunks(), pa.nulls(m, pa.int64())])}
        | {c: pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(m, pa.int64())]) for c, v in sums.items()}
        | {"groups_sha256": pa.concat_arrays([pa.array(shas, pa.string()), pa.nulls(m, pa.string())])}
        | {"pair": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(different[used], pa.int64())]), "docs": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(held[used], pa.int64())])}
    )


def _unit_sums(counts: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of units' links that are among counts(pair, n, best): at each place how many are best, and the sum of their counts."""
    turn = np.argsort(counts["pair"].to_numpy())
    pair, n, best = (counts[c].to_numpy()[turn].astype(np.int64) for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column("groups"), []
            at = np.cumsum([0, *pc.list_value_length(lists).to_numpy()])
            starts, flat, _ = _pairs(at, lists.flatten().to_numpy().astype(np.int64))
            place = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            held = pair[place] == flat if len(pair) else np.zeros(len(flat), bool)
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(held, x[place], 0) if len(pair) else held)])[starts]) for x in (best, n)]
            for block, row, number in _by_block(batch.column("places")):
                rows.append((block, _squeezed(np.diff(number, prepend=0)), *[_squeezed(x[row], "<u8") for x in sums]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["block", "n", "n_best", "count_sum"])

    return run


def _summed(docs: pa.Table, units: pa.Table) -> pa.Table:
    n, sums = _places(units), {}
    for c in ("n_best", "count_sum"):
        sums[c] = np.zeros(n.max(initial=-1) + 1, np.int64)
        np.add.at(sums[c], n, _column(units, c, "<u8"))
    _, codes, at = _documents(docs, sums["count_sum"] > 0)  # a unit of a document that has tokens has a link that is counted
    return pa.table({"block": docs["block"], "n": docs["n"]} | {c: pa.array(_totals(v, codes, at), pa.int64()) for c, v in sums.items()})


def _per_block(docs: DataFrame, units: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    names = [x.name for x in T._parse_datatype_string(schema)]
    docs, units = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (docs, units))  # both come from one table; their columns are told apart
    return docs.groupBy("block").cogroup(units.groupBy("block")).applyInArrow(lambda a, b: f(a, b).select(names), schema)


def link_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text): (a row a document; the id pairs: pair, n, best), both over tables that are already written."""
    spark = docs.sparkSession
    importable(spark)
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    batch = {"spark__sql__execution__arrow__maxBytesPerBatch": str(BLOCK_BYTES), "spark__sql__parquet__compression__codec": "zstd"}
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(block_rows), **batch):
        coded = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded, CODED), "coded")
    texts = coded.filter("codes is not null").select("block", "n", "doc_id", "codes")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(DEALT), **batch):
        units = coded.filter("unit is not null").groupBy("unit").agg(F.collect_list(F.struct("block", "n")).alias("places"))
        encoded = written(encode_units(units, path_a, path_b).withColumn("u", F.monotonically_increasing_id()), "units")
        known = aligned(encoded)
        dealt = known.mapInArrow(_dealt, "block long, n binary, sizes binary, tokens binary")
        rows = written(_per_block(texts, dealt, _together, MADE), "aligned")
        # a pair's A id has at most as many pairs as B has pieces
        counts = rows.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("best", F.max("n").over(W.partitionBy(F.floor(F.col("pair") / PAIR))) == F.col("n"))
        counts = written(counts, "pairs", few=True)
        parts = max(1, -(-counts.count() // COUNTS))
        sums = []
        for i in range(parts):
            # no more than a part at a time is on the driver, as if it were broadcast
            part = _unit_sums(counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i).toArrow())
            sums.append(written(known.mapInArrow(part, "block long, n binary, n_best binary, count_sum binary"), "unit-sums"))
        back = written(_per_block(texts.drop("doc_id"), reduce(DataFrame.union, sums), _summed, SUMS), "sums")
    out = rows.filter("pair is null").join(back, ["block", "n"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
