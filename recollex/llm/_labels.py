"""Bounded samples of labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts`` (null for a null doc_id)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts


def labelled_sample(labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` rows of each of the labels 0 and 1, lowest md5 of doc_id first.

    A doc_id with several labels counts with the highest; nulls are left out.
    """
    one = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [one.filter(F.col("label") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for c in (0, 1)]
    return reduce(DataFrame.union, parts)
