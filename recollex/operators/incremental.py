"""Near duplicates of records that come in batches: each batch meets a stored index, and no old pair is looked at again.

A store is a folder of tables, each with a part a batch:

    order     (k, counts): how often words stood in the first batch, by place; this order of words never changes, so prefixes of all batches agree
    sets      (ord, person, h, length) of every record; h are its words as numbers, told apart by block
    prefixes  (word, ord, n, i): a record's first numbers in that order, enough to meet all that are alike in several of them
    nodes     (node, root): every record that has a link, with its component when its first link came
    merges    (root, component): what became of components since, whole for every batch

A batch's records are joined to the prefixes of all earlier ones and of their own, met pairs are verified, and the new links
are drawn between components, not records: their components are found among these few, and only ``merges`` is written anew.  A batch that is
repeated after a failure writes its own part again; a part counts once its ``merges`` is whole.

Cases: a record without words has no links; the order of batches does not change the result; an ``ord`` must come once; records with
null blocks or persons are in no block with others, as in a run over all; an empty batch adds nothing; frequent words are in the prefixes of
short records only, and a join on them is split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollex.functions.text import content_words
from recollex.operators.components import connected_components
from recollex.operators.mining import SIMILARITY, alike, counted_places, hashed_words, met_pairs, prefixes, slices
from recollex.session import new_path, written

TABLES = {
    "order": "k int, counts binary",
    "sets": "ord long, person string, h array<long>, length int",
    "prefixes": "word long, ord long, n int, i int",
    "nodes": "node long, root long",
    "merges": "root long, component long",
}


class NearDuplicates:
    """The store in ``folder``; a part counts if the batch's number is below ``upto``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: float = SIMILARITY):
        self.spark, self.folder, self.threshold = spark, folder or new_path(spark, "near-duplicates"), threshold

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch-{batch:06d}"

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/merges")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(x.getName().removeprefix("batch-")) for x in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        schema = TABLES[name]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(name, b) for b in batches])

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        columns = [f.name for f in StructType.fromDDL(TABLES[name])]
        df.select(*columns).write.mode("overwrite").parquet(self._path(name, batch))
        return self._read(name, [batch])

    def add(self, df: DataFrame, batch: int) -> DataFrame:
        """df(ord, content, block, person) as batch number ``batch``; returns its new links (a, b, similarity)."""
        old = [b for b in self.batches() if b < batch]
        h = F.when(F.col("block").isNotNull(), hashed_words(F.col("block"), content_words(F.col("content")))).otherwise(F.array().cast("array<long>"))
        sets = self._write(df.select("ord", F.col("person").cast("string").alias("person"), h.alias("h"), F.length(F.coalesce("content", F.lit(""))).alias("length")), "sets", batch)
        order = self._read("order", [old[0]]) if old else self._write(slices(sets), "order", batch)
        # words that are alone so far may meet a later batch
        new = self._write(prefixes(sets, counted_places(order), self.threshold, alone=True), "prefixes", batch)
        # a pair is made from its later batch; inside of one from its smaller ord
        pairs = written(met_pairs(self._read("prefixes", old), self.threshold, new), "met", few=True)
        links = written(self._verified(pairs, self._read("sets", [*old, batch])), "links", few=True)
        self._merge(links, old, batch)
        return links

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of one person go first, so that words are read of what is left only."""
        who = lambda k: sets.select(F.col("ord").alias(k), F.col("person").alias(f"p{k}"))
        told = pairs.join(who("a"), "a").join(who("b"), "b").filter(~F.col("pa").eqNullSafe(F.col("pb"))).select("a", "b")
        return alike(written(told, "told", few=True), sets, self.threshold)

    def _merge(self, links: DataFrame, old: list[int], batch: int) -> None:
        ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
        known = self.components(old).join(ends, "node", "left_semi")
        told = written(ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh")), "ends", few=True)
        of = lambda k: told.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select("ca", "cb")
        found = written(connected_components(edges, "ca", "cb"), "merged", few=True).select(F.col("node").alias("root"), F.col("component").alias("now"))
        self._write(told.filter("fresh").select("node", F.col("node").alias("root")), "nodes", batch)
        # what led to a component that is now part of another leads there; components met for the first time are their own roots
        before = self._read("merges", old[-1:])
        moved = before.join(found.withColumnRenamed("root", "component"), "component", "left").select("root", F.coalesce("now", "component").alias("component"))
        fresh = found.filter("root <> now").join(before.select("root"), "root", "left_anti").select("root", F.col("now").alias("component"))
        self._write(moved.unionByName(fresh), "merges", batch)

    def components(self, batches: list[int] | None = None) -> DataFrame:
        """(node, component) of all records that have links; component is the smallest ord."""
        batches = self.batches() if batches is None else batches
        return self._read("nodes", batches).join(self._read("merges", batches[-1:]), "root", "left").select("node", F.coalesce("component", "root").alias("component"))

    def kept(self) -> DataFrame:
        """(ord): of each component the record with the longest content, the first on ties, and all records without links."""
        batches = self.batches()
        rows = self._read("sets", batches).select("ord", "length").join(self.components(batches), F.col("ord") == F.col("node"), "left")
        # folded by component, so that one with a third of all records is a row a task
        best = rows.filter("component is not null").groupBy("component").agg(F.max_by("ord", F.struct("length", -F.col("ord"))).alias("ord")).select("ord")
        return rows.filter("component is null").select("ord").union(best)
