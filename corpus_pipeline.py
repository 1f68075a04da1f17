"""A training-data pipeline over documents: each stage is one operator, written as Parquet and read by the next.

quality      documents that the quality classifier rejects go (trained on labels outside of fold 1 of 3)
lines        of lines within one edit of each other the earliest stays; a document that loses all its lines goes
near_copies  of documents linked by a Jaccard similarity of 0.8 of five-word shingles one stays
benchmark    documents that hold ten words in a row of a benchmark item go
tokens       byte-level BPE ids of what is left, with digests of the ids and of the text decoded from them

Columns other than doc_id and text travel beside the operators, so no name clashes with theirs; n_chars, where there
is one, follows the text.  Nulls, empty texts, repeated rows and empty tables are treated as each operator's
module says; all of them pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from recollex.llm._labels import fold
from recollex.session import new_path, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all else in one column."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    fresh = {"n_chars": F.length("text").cast("long")}
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else fresh[c].alias(c) if c in fresh else F.col("_rest")[c].alias(c) for c in columns])


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.keep_good(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(_packed(docs))
    return _unpacked(clean.filter("n_removed = 0 or trim(text) <> ''"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _unpacked(jaccard_join.keep_one(_packed(docs)), docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), "documents"), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_poor),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("tokens", tokenize),
]

#: A trained model decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
