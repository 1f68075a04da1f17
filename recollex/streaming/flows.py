"""Streams that run to the end of what is there (availableNow): ledger of files, upsert store, windows, sessions, repeats and joins.

Each returns what its sink holds after the run; run again with the same folder they take only what is new.  State is bounded
by watermarks; rows that come too late for them are dropped and counted: ``late_rows`` tells how many a folder's runs have lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollex.session import new_path
from recollex.sources.bucketed import BUCKETS, BucketedStore


def files(spark: SparkSession, path: str, schema: StructType, at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files that match ``path`` (a folder, or a pattern), ``at_once`` in a batch, oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader if at_once is None else reader.option("maxFilesPerTrigger", at_once)).parquet(path)


def _run(df: DataFrame, folder: str, mode: str = "append") -> None:
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    if late:  # one number a run
        df.sparkSession.createDataFrame([(str(q.runId), late)], "run string, late long").coalesce(1).write.mode("append").parquet(f"{folder}/late")


def late_rows(spark: SparkSession, folder: str) -> int:
    """Rows that the runs of a folder dropped as too late.  Windows count what a task has folded for a key as one row."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/late")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.parquet(f"{folder}/late").agg(F.sum("late")).first()[0]


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def ledger(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Every row once: the checkpoint remembers which files were read."""
    spark, folder = stream.sparkSession, folder or new_path(stream.sparkSession, "ledger")
    _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windows(stream: DataFrame, time: str, by: str, value: str, size: str = "1 day", late: str = "10 minutes", folder: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, by, n, total) of tumbling windows, or of ones that begin every ``slide``, that the watermark has closed."""
    spark, folder = stream.sparkSession, folder or new_path(stream.sparkSession, "windows")
    counted = _timed(stream, time, late).groupBy(F.window(time, size, slide), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    out = counted.select(F.col("window.start").alias("start"), by, "n", "total")
    _run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "1 day", late: str = "10 minutes", folder: str | None = None) -> DataFrame:
    """(by, start, finish, n) of sessions that the watermark has closed."""
    spark, folder = stream.sparkSession, folder or new_path(stream.sparkSession, "sessions")
    counted = _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    out = counted.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")
    _run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def without_repeats(stream: DataFrame, time: str, key: list[str], late: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Rows whose key has not come before within ``late`` of event time; a key is forgotten once the watermark has passed it."""
    spark, folder = stream.sparkSession, folder or new_path(stream.sparkSession, "repeats")
    out = _timed(stream, time, late).dropDuplicatesWithinWatermark(key)
    _run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def joined(left: DataFrame, right: DataFrame, key: str, time: str, within: str = "1 hour", late: str = "10 minutes", folder: str | None = None, prefix: str = "other_") -> DataFrame:
    """Pairs of a row of ``left`` and one of ``right`` with its key that came at its time or up to ``within`` before.

    Both sides keep rows only as long as a partner can still come.  Columns of ``right`` stand under ``prefix``.
    """
    spark, folder = left.sparkSession, folder or new_path(left.sparkSession, "joined")
    a, b = _timed(left, time, late), _timed(right, time, late)
    b = b.select(*[F.col(c).alias(f"{prefix}{c}") for c in b.columns])
    then = F.col(f"{prefix}{time}")
    out = a.join(b, (F.col(key) == F.col(f"{prefix}{key}")) & (then <= F.col(time)) & (then >= F.col(time) - F.expr(f"interval {within}")))
    _run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def upsert(stream: DataFrame, key: str, content: str, order: list[str], folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, content, first): the last content of each key and the place of its first, kept in a BucketedStore.

    A batch writes its own rows, and only buckets with a deep log are written anew, so its cost follows the batch, not the store.
    A batch that is repeated after a failure writes the same again.  A run with nothing new returns what there is.
    """
    spark, folder = stream.sparkSession, folder or new_path(stream.sparkSession, "upsert")
    rows = stream.select(F.col(key).alias("key"), F.col(content).alias("content"), F.struct(*order).alias("sequence"))
    kinds = tuple(f.dataType.simpleString() for f in rows.schema)
    merge = lambda batch, number: BucketedStore(batch.sparkSession, kinds, f"{folder}/store", buckets).upsert(batch, number)
    q = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return BucketedStore(spark, kinds, f"{folder}/store", buckets).read().select(F.col("key").alias(key), "content", "first")
