"""Token ids in bit-plane files, in ascending doc_id order, and back.

Documents are cut into ranges of doc_id at quantiles and encoded where they are read; only ids (two bytes each
if the vocabulary allows) are shuffled, one file for each range is streamed out in doc_id order to the shared
folder, under a name of its attempt until it is whole.  The number of ids before each file comes from the files'
counts, one row a file.

Cases: a null or empty text is the end id alone; null doc_ids come first; repeated doc_ids are ordered by a hash
of their texts and rows equal in both in any order; very long texts span blocks; an empty table
writes no file and gives no rows; only doc_id and text of the input are used.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.llm._ordered import _range_of, _ranges
from recollex.llm._planes import Reader, Writer
from recollex.llm._words import WordEncoder
from recollex.llm.bpe import default_path
from recollex.session import importable, new_path, settings, table, written

END_ID = 2


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)


def _filesystem(uri: str):
    """(filesystem, path): the folder may be local, HDFS or an object store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


FILES = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, bits: bool = False, pieces: int | None = None) -> DataFrame:
    """Writes the files of docs(doc_id, text) under ``folder``; returns (file, path, n_docs, n_ids), already computed."""
    spark, path = docs.sparkSession, path or default_path("word_bpe_49k.json")
    pieces = pieces or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(docs, "doc_id", pieces)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = word_encoder(path)
        for batch in batches:
            ids = e.encode_array(batch.column("text"))
            file = len(bounds) + 1 - _range_of(bounds, batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), batch.column("doc_id"), batch.column("_tie"), ids], names=["file", "doc_id", "_tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, made = word_encoder(path).width, []
        store, root = _filesystem(folder)
        now, writer, stream, temporary = None, None, None, ""

        def close() -> None:
            if writer is not None:
                writer.close()
                stream.close()
                final = f"{root}/part-{now:06d}.rcx"
                store.move(temporary, final)
                made.append((now, final, len(writer._docs), writer.total))

        store.create_dir(root, recursive=True)
        for batch in batches:
            for file, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if file != now:
                    close()
                    now, temporary = file, f"{root}/part-{file:06d}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.tmp"
                    stream = store.open_output_stream(temporary)
                    writer = Writer(stream, width=width, bits=bits)
                ids = np.frombuffer(raw.as_py(), dtype=f"<u{width}")
                writer.add(doc, ids if end_id is None else np.append(ids, np.array(end_id, dtype=ids.dtype)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["file", "path", "n_docs", "n_ids"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    encoded = keyed.mapInArrow(encode, "file int, doc_id long, _tie long, ids binary")
    dealt = encoded.repartition(pieces, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "_tie")
    return written(dealt.mapInArrow(write, FILES), "token-files")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in ``files``, read back from them, in file order."""
    listed = sorted(files.select("file", "path", "n_ids").collect())  # one row a file
    base, rows = 0, []
    for _, path, n in listed:
        rows.append((path, base))
        base += n
    plan = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    schema = T.StructType(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    out: list[tuple] = []
                    for doc, parts in Reader(source, source.size()).documents():
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                        out.append((doc, at, n, crc, np.concatenate(parts) if ids and parts else None))
                        at += n
                        if len(out) >= (256 if ids else 4096):
                            yield _rows(out, ids)
                            out = []
                    yield _rows(out, ids)

    return plan.mapInArrow(read, schema)


def _rows(out: list[tuple], ids: bool) -> pa.RecordBatch:
    arrays = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
    if ids:
        arrays.append(pa.array([None if x[4] is None else x[4].astype(np.int32) for x in out], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    folder = new_path(spark, "tokens")
    # the more texts a batch has, the more of their words are the same; its bytes are bounded, for these jobs alone
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2048", spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20)):
        files = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, files, ids=False)
