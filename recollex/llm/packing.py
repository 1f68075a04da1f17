"""Packing of all documents, in ascending doc_id order, into sequences of a bounded number of tokens.

Documents are dealt to ranges of doc_id, encoded where they are read, and only their ids (two bytes each if the
vocabulary allows) are shuffled.  Each range is one stream in one task, sorted by doc_id, which _packer cuts at the ends of
documents and sentences where it can.  So order holds over all sequences, a range costs one short last sequence (of powers of
two, mostly), and a task holds some 2**19 tokens or one document.  A doc_id that many rows have is dealt to as many ranges as quantiles fall on it.

Cases: a null or empty text is its end id alone; null doc_ids come first, over ranges in proportion to their number;
repeated doc_ids are ordered by a hash of their texts and then by place in the input; a document longer than a
sequence is cut at sentences, and where a sentence is longer than 256 tokens at multiples of 64; an empty table gives no rows; only doc_id and text of the
input are used, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from recollex.llm._packer import Packer
from recollex.llm.bpe import default_path
from recollex.llm.token_files import word_encoder
from recollex.session import importable, settings, table, written

SIZE, END_ID = 2048, 1
#: Characters that end a sentence, perhaps before closing marks.
STOPS, CLOSING = ".!?…。！？", "\"')]}»”’"

_LONGS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_seq", "offset")
PIECES = T.StructType([T.StructField("_range", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _LONGS]])


def sentence_ends(path: str) -> np.ndarray:
    """By id: whether the token ends a word whose last mark ends a sentence."""
    with open(path, encoding="utf-8") as f:
        vocab: dict[str, int] = json.load(f)["model"]["vocab"]
    out = np.zeros(1 << 16 if max(vocab.values()) < 1 << 16 else max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        word = token.removesuffix("</w>")
        out[i] = word != token and word.rstrip(CLOSING)[-1:] in tuple(STOPS)
    return out


def _bounds(docs: DataFrame, pieces: int) -> tuple[np.ndarray, int]:
    """(quantiles of doc_id, some of them equal where one doc_id has many rows; ranges for rows without a doc_id)."""
    n, nulls = docs.select(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    found = docs.select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [(i + 1) / pieces for i in range(pieces - 1)], 0.2 / pieces) if n > nulls else []
    return np.sort(np.array(found, np.float64)).astype(np.int64), max(1, round(pieces * nulls / max(n, 1)))


def _deal(bounds: np.ndarray, for_nulls: int, keys: pa.Array, places: np.ndarray) -> np.ndarray:
    """The range of each key: rising with it; a key that is a bound is dealt to all ranges that meet there."""
    null = np.asarray(keys.is_null())
    raw = np.asarray(keys.fill_null(0), dtype=np.int64)
    low, high = np.searchsorted(bounds, raw, side="left"), np.searchsorted(bounds, raw, side="right")
    mixed = (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    spread = low + (mixed % (high - low + 1).astype(np.uint64)).astype(np.int64)
    return np.where(null, (mixed % np.uint64(for_nulls)).astype(np.int64), spread + for_nulls).astype(np.int32)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, pieces: int | None = None) -> DataFrame:
    """docs(doc_id, text): (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece, already computed."""
    spark, path = docs.sparkSession, path or default_path("word_bpe_49k.json")
    importable(spark)
    pieces = pieces or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, for_nulls = _bounds(docs, pieces)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = word_encoder(path)
        for batch in batches:
            dealt = _deal(bounds, for_nulls, batch.column("doc_id"), np.asarray(batch.column("_place")))
            yield pa.RecordBatch.from_arrays([pa.array(dealt), batch.column("doc_id"), batch.column("_tie"), batch.column("_place"), e.encode_array(batch.column("text"))], names=["_range", "doc_id", "_tie", "_place", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, ends = word_encoder(path).width, sentence_ends(path)
        end = np.array([end_id], f"<u{width}")
        now, packer, out = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.int32()) for k in range(len(PIECES))], names=PIECES.names)

        for batch in batches:
            for r, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if r != now:
                    if packer is not None:
                        out += [(now, *p) for p in packer.close()]
                    now, packer = r, Packer(ends, size)
                out += [(r, *p) for p in packer.add(doc, np.concatenate([np.frombuffer(raw.as_py(), f"<u{width}"), end]))]
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if packer is not None:
            out += [(now, *p) for p in packer.close()]
        yield batch_of(out)

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    # the more texts a batch has, the more of their words are the same; its bytes are bounded, for these jobs alone
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2048", spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20)):
        coded = keyed.mapInArrow(encode, "_range int, doc_id long, _tie long, _place long, ids binary")
        dealt = coded.repartition(pieces, "_range").sortWithinPartitions("_range", F.col("doc_id").asc_nulls_first(), "_tie", "_place")
        made = written(dealt.mapInArrow(run, PIECES), "pieces", few=True)
    counts = made.groupBy("_range").agg((F.max("_seq") + 1).alias("_n"))  # a row a range
    base = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return made.join(F.broadcast(base), "_range").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_seq")).alias("sequence_id"), "offset")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
