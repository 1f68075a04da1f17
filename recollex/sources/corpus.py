"""Markdown corpora: recursive scan, preparation, ledger of finished files, intermediate tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import indexed

MIN_CHARS, HEAD_CHARS, BATCH = 500, 3000, 3


def checked_folder(path: str, blocked: tuple[str, ...] = ("/etc", "/proc", "/sys", "/dev", "/boot")) -> str:
    """The folder's real path; system folders are refused.  Paths with a scheme are left to Spark."""
    if "://" in path:
        return path
    real = os.path.realpath(path)
    if any(real == b or real.startswith(b + "/") for b in blocked):
        raise ValueError(f"not a corpus folder: {path}")
    return real


def _leaving(root: str) -> list[str]:
    """Links under ``root`` to files and folders that are not under it; few, as a corpus has few links."""
    found = [os.path.join(at, name) for at, folders, files in os.walk(root) for name in (*folders, *files)]
    return [x for x in found if os.path.islink(x) and not os.path.realpath(x).startswith(root + os.sep)]


def scan(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(file, folder, name, text) of every file under ``path``; what links lead out of a local folder is left out.  Nothing found gives no rows."""
    root = checked_folder(path)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    out = _leaving(root) if "://" not in root else []
    raw = reader.text(root, wholetext=True)
    if out:  # names of files and folders that Spark's listing would follow
        at = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
        raw = raw.filter(~reduce(lambda a, b: a | b, [(at == x) | at.startswith(x + "/") for x in out]))
    parts = F.split(F.col("file"), "/")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).select("file", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "text")


def prepare(files: DataFrame, least: int = MIN_CHARS, head: int = HEAD_CHARS) -> DataFrame:
    """Without front matter, trimmed; short files dropped; the first ``head`` characters, which is what a model is shown."""
    body = F.regexp_replace(F.col("text"), r"(?s)^---.*?---", "")
    trimmed = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return files.withColumn("text", trimmed).filter(F.length("text") >= least).withColumn("text", F.substring("text", 1, head))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that the ledger lacks, by whole path."""
    return files.join(done.select("file").distinct(), "file", "left_anti")


def batches(df: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """Adds batch: runs of ``size`` rows in order."""
    return indexed(df, [order], "_i").withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)
