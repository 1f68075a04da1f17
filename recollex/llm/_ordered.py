"""Each row beside the one that follows it in descending key order, without a task that sees all rows.

Keys are cut into ranges at quantiles; each range is one sorted stream in one task, and the row that heads a
range is also sent to the range before it.  Rows without a key are one range of their own, sorted in one task: a corpus
that lacks keys for a large share of its rows should be given some first.  Only the ranges' bounds and head keys come to the driver: two
numbers a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 16 << 20


def _ranges(df: DataFrame, key: str, pieces: int) -> np.ndarray:
    probabilities = [(i + 1) / pieces for i in range(pieces - 1)]
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", probabilities, 0.2 / pieces)
    return np.unique(np.array(found, dtype=np.float64))


def _range_of(bounds: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Ranges count from the highest keys down; nulls come last."""
    raw = np.array([np.nan if k is None else float(k) for k in keys.to_pylist()], dtype=np.float64)
    return np.where(np.isnan(raw), len(bounds) + 1, len(bounds) - np.searchsorted(bounds, raw, side="right")).astype(np.int32)


def map_with_next(df: DataFrame, key: str, tie: str, one: Callable[[dict, dict], dict], schema: T.StructType, pieces: int | None = None) -> DataFrame:
    """``one(row, next row)`` for every row of ``df`` in order of ``key`` descending, then ``tie``; after the last comes the first.

    Rows equal in both keep their number in any order.  Nulls follow all keys.
    """
    spark = df.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(df, key, pieces)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for r, k, t in zip(_range_of(bounds, batch.column(0)).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rank = (0 if k is None else -k, t)
                if r not in best or rank < best[r][0]:
                    best[r] = (rank, k, t)
        rows = [(r, k, t) for r, (_, k, t) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())], names=["r", "k", "t"])

    found: dict[int, tuple] = {}
    small = df.select(F.col(key).cast("long").alias("k"), F.col(tie).alias("t")).mapInArrow(heads, "r int, k long, t long")
    for x in small.groupBy("r").agg(F.min(F.struct((-F.coalesce("k", F.lit(0))).alias("minus"), F.col("t"), F.col("k"))).alias("h")).collect():
        found[x["r"]] = (x["h"]["k"], x["h"]["t"])
    order = sorted(found)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's head closes the last range
    names = df.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, r = batch.column(key), _range_of(bounds, batch.column(key))
            ties = batch.column(tie).to_pylist()
            extra = [i for i, (x, k) in enumerate(zip(r.tolist(), keys.to_pylist(), strict=True)) if found.get(x) == (k, ties[i])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(np.zeros(len(r), np.int32))], names=[*names, "_range", "_extra"])
            if extra:
                more = batch.take(pa.array(extra, pa.int32()))
                to = [before[int(r[i])] for i in extra]
                yield pa.RecordBatch.from_arrays([*more.columns, pa.array(to, pa.int32()), pa.array(np.ones(len(extra), np.int32))], names=[*names, "_range", "_extra"])

    inside = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_extra", T.IntegerType())])
    dealt = df.mapInArrow(spread, inside).repartition(pieces, "_range").sortWithinPartitions("_range", "_extra", F.col(key).desc_nulls_last(), tie)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None
        for batch in batches:
            out, size = [], 0
            for row in _rows(batch):
                if last is not None and last["_range"] == row["_range"]:
                    out.append(one(last, row))
                    size += sum(len(v) for v in out[-1].values() if isinstance(v, str))
                last = None if row["_extra"] else row
                if size > BATCH_BYTES:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

    return dealt.mapInArrow(pairs, schema)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [(n, batch.column(n)) for n in batch.schema.names]
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in columns}


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))
