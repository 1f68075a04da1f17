"""Session helpers: tables, shared storage for cut lineage, and sizes that are measured before use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, bench) gets a temporary folder of its own;
    on a cluster a missing setting is an error, as executors would not see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = "spark.recollex.localShared"
    if not spark.conf.get(key, None):
        spark.conf.set(key, "file://" + tempfile.mkdtemp(prefix="recollex-"))
    return spark.conf.get(key)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/recollex/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (``__`` for a dot) that hold for what is run inside, and then as before."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    for k, name in names.items():
        spark.conf.set(name, values[k])
    try:
        yield
    finally:
        for k, name in names.items():
            spark.conf.unset(name) if before[k] is None else spark.conf.set(name, before[k])


def write(df: DataFrame, path: str, few: bool = False) -> None:
    """Write ``df`` as Parquet.  ``few``: the rows are cheap to make, so that shuffled partitions are joined up to the advisory size rather
    than spread over all cores.  Shuffle files of the write go as soon as the table is whole: nothing reads them again.
    """
    with settings(df.sparkSession, spark__sql__adaptive__coalescePartitions__parallelismFirst=str(not few).lower(), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Cut the lineage: ``write`` ``df`` to the shared folder and read it back.

    Unlike localCheckpoint, a lost executor costs nothing; unlike checkpoint(), columns stay prunable.
    """
    path = new_path(df.sparkSession, label)
    write(df, path, few)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``: the gapless place of each row, from 0, in a total order of all rows.

    Rows are dealt to ranges of the order and ranked inside a range; only one count for each range is added up in
    one place.  The ranks are written before they are counted, so that both see the same ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranked = written(ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order))), "ranked")
    sizes = ranked.groupBy("_p").agg(F.max("_r").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranked.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")  # a row for each range


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder the driver was started in."""
    root, sc = str(Path(__file__).resolve().parent.parent), spark.sparkContext
    known = [x for x in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole documents may hold in a Python worker."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
