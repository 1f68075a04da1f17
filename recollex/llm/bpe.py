"""BPE encoding and decoding of whole texts by tree concatenation (see _bpe).

Cases: a null or empty text has no ids and decodes to the empty text; the ids of a text do not depend on its
row, so repeated rows repeat their result; very long texts are encoded leaf by leaf; an empty table gives no
rows; other columns are kept by ``encode_documents``, but for those that it adds, which replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recollex.llm._bpe import ByteBPE
from recollex.session import small_batches, table


@lru_cache(maxsize=4)
def encoder(path: str, leaf: int) -> ByteBPE:
    """One for each worker process; the file lies in the installed package, not in the repository."""
    return ByteBPE(path, leaf)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", leaf: int = 4096, decode: bool = True, keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (if keep_ids), ids_sha256 and, if decode, decoded_sha256.  No shuffle: a row is encoded where it is read."""
    path = path or default_path()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]
    added += [T.StructField("decoded_sha256", T.StringType())] if decode else []
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    drop_text = not keep_ids and [f.name for f in docs.schema] == ["doc_id", text]
    kept = [f for f in docs.schema if f.name not in {x.name for x in added} and not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, names = encoder(path, leaf), [str(i) for i in range(100_000)]
        for batch in batches:
            n, shas, texts, lists = [], [], [], []
            for value in batch.column(text):
                ids = bpe.encode(value.as_py() or "")
                n.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                if decode:
                    texts.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if keep_ids:
                    lists.append(pa.array(ids, pa.int32()))
            columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts, pa.string()) if decode else None}
            if keep_ids:
                offsets = pa.array([0, *_running(n)], pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [columns[f.name] for f in added], names=[f.name for f in (*kept, *added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def _running(n: list[int]) -> list[int]:
    out, total = [], 0
    for x in n:
        total += x
        out.append(total)
    return out


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
