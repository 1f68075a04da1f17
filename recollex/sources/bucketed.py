"""A store of the last content of every key, split by key hash, with a log of changes.

    log/batch=N/bucket=B     what batch N brought for keys of bucket B: (key, content, last, first)
    base/upto=N/_b=B         all keys of bucket B after batch N
    state/N                  a row a bucket that has a base: (bucket, upto)

A batch writes only its own rows, in the buckets that they touch.  A read takes the base of each bucket and the log after it.  When a bucket's
log is DEEP batches deep it is compacted, alone: its base is written anew and the other buckets stay as they are.  A
batch that is repeated after a failure writes the same part again; a compaction counts once its state is whole, and it always
leaves the bases that the state before it names.

Cases: null keys are left out; of a key's rows the one with the greatest sequence counts, whatever batch it comes with; equal sequences
keep the greater content; ``first`` is the lowest sequence seen; an empty batch is a part without rows; an empty store reads as no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import new_path

BUCKETS, DEEP = 64, 8


class BucketedStore:
    def __init__(self, spark: SparkSession, kinds: tuple[str, str, str], folder: str | None = None, buckets: int = BUCKETS, deep: int = DEEP):
        """kinds: the types of key, content and sequence (any type that has an order)."""
        self.spark, self.folder, self.buckets, self.deep = spark, folder or new_path(spark, "bucketed"), buckets, deep
        key, content, sequence = kinds
        self.schema = f"key {key}, content {content}, last {sequence}, first {sequence}"

    # files

    def _list(self, path: str) -> list[str]:
        """Names of the folders in ``path`` that were written whole."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        found = hadoop.Path(f"{self.folder}/{path}")
        store = found.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in store.listStatus(found)] if store.exists(found) else []
        return sorted(x.getName() for x in names if store.exists(hadoop.Path(x, "_SUCCESS")))

    def batches(self) -> list[int]:
        return [int(x.removeprefix("batch=")) for x in self._list("log")]

    def bases(self, below: int | None = None) -> dict[int, int]:
        """By bucket the batch up to which its base goes, by the last whole state (before batch ``below``)."""
        states = [int(x) for x in self._list("state") if below is None or int(x) < below]
        return {r["bucket"]: r["upto"] for r in self.spark.read.parquet(f"{self.folder}/state/{states[-1]:08d}").collect()} if states else {}  # a row a bucket

    # rows

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "bucket").agg(F.max_by("content", F.struct("last", "content")).alias("content"), F.max("last").alias("last"), F.min("first").alias("first"))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, bucket int")

    def _parts(self, bases: dict[int, int], buckets: list[int] | None, upto: int | None) -> DataFrame:
        """All rows of the bases and of the log after them, of some buckets; folder names say which files are read."""
        wanted = range(self.buckets) if buckets is None else buckets
        whole = [b for b in self.batches() if upto is None or b <= upto]
        out = self._empty()
        paths = [f"{self.folder}/base/upto={bases[b]}/_b={b}" for b in wanted if b in bases]
        if paths:
            out = out.unionByName(self.spark.read.schema(f"{self.schema}, bucket int").parquet(*paths))
        after = [b for b in whole if b > min((bases.get(x, -1) for x in wanted), default=-1)]
        if after:
            log = self.spark.read.schema(f"{self.schema}, bucket int, batch int").option("basePath", f"{self.folder}/log").parquet(*[f"{self.folder}/log/batch={b}" for b in after])
            since = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, n in bases.items() for x in (b, n)]), F.col("bucket")), F.lit(-1)) if bases else F.lit(-1)
            log = log.filter(F.col("batch") > since) if buckets is None else log.filter(F.col("bucket").isin(wanted) & (F.col("batch") > since))
            out = out.unionByName(log.drop("batch"))
        return out

    def upsert(self, rows: DataFrame, batch: int) -> list[int]:
        """rows(key, content, sequence) as batch number ``batch``; returns the buckets that were compacted after it."""
        fresh = self._folded(rows.filter("key is not null").select("key", self._bucket(F.col("key")).alias("bucket"), "content", F.col("sequence").alias("last"), F.col("sequence").alias("first")))
        fresh.select("key", "content", "last", "first", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/log/batch={batch}")
        bases = self.bases(batch)
        depth: dict[int, int] = {}
        for r in self._log().filter(F.col("batch") <= batch).groupBy("bucket", "batch").agg(F.count("*")).collect():  # a row a bucket and batch since its base
            if r["batch"] > bases.get(r["bucket"], -1):
                depth[r["bucket"]] = depth.get(r["bucket"], 0) + 1
        due = sorted(b for b, n in depth.items() if n >= self.deep)
        if due:
            self._compact(due, bases, batch)
        return due

    def _log(self) -> DataFrame:
        batches = self.batches()
        if not batches:
            return self._empty().withColumn("batch", F.lit(0)).limit(0)
        return self.spark.read.schema(f"{self.schema}, bucket int, batch int").option("basePath", f"{self.folder}/log").parquet(*[f"{self.folder}/log/batch={b}" for b in batches])

    def _compact(self, due: list[int], bases: dict[int, int], batch: int) -> None:
        merged = self._folded(self._parts(bases, due, batch)).withColumn("_b", F.col("bucket"))
        merged.select("key", "content", "last", "first", "bucket", "_b").repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.folder}/base/upto={batch}")
        state = bases | dict.fromkeys(due, batch)
        self.spark.createDataFrame(sorted(state.items()), "bucket int, upto int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/{batch:08d}")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, content, last, first) of all keys, or of keys(key), for which only their buckets are read."""
        buckets = None
        if keys is not None:
            buckets = [r["b"] for r in keys.filter("key is not null").select(self._bucket(F.col("key")).alias("b")).distinct().collect()]  # at most ``buckets`` rows
        out = self._folded(self._parts(self.bases(), buckets, None)).drop("bucket")
        return out if keys is None else out.join(keys.select("key").distinct(), "key", "left_semi")

    def changes(self, since: int, upto: int | None = None) -> DataFrame:
        """(batch, key, content, last, first) of the batches after ``since``: what each brought, the log that others follow."""
        log = self._log().filter(F.col("batch") > since)
        return (log if upto is None else log.filter(F.col("batch") <= upto)).select("batch", "key", "content", "last", "first")
