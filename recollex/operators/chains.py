"""Chains of records: grouping, mixed-time order, positions, links, summaries and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.functions.times import relative_offset, sortable
from recollex.session import indexed

DEPTH = 6
UNKNOWN = "未知"


def _over(by: list[str], *order) -> W:
    w = W.partitionBy(*by)
    return w.orderBy(*order) if order else w


def linked(df: DataFrame, chain: str = "chain", position: str = "pos", memory_id: str = "memory_id") -> DataFrame:
    """Adds chain_prev and chain_next, '' at the ends."""
    w = _over([chain], position)
    return df.withColumns({"chain_prev": F.lag(memory_id, 1, "").over(w), "chain_next": F.lead(memory_id, 1, "").over(w)})


def time_order(time: Column, text: Column, by: list[str]) -> tuple[Column, Column]:
    """Sort key of a row in its chain, and whether any row of the chain has it.

    Two or more rows with an absolute time: by that, rows without it first.  Else two or more with a relative one:
    by its offset.  Else as they came.
    """
    absolute, relative = sortable(time), relative_offset(text)
    w = _over(by)
    n_absolute, n_relative = F.sum(F.when(absolute > 0, 1).otherwise(0)).over(w), F.count(relative).over(w)
    return F.when(n_absolute >= 2, absolute).when(n_relative >= 2, F.coalesce(relative, F.lit(0)).cast("bigint")).otherwise(F.lit(0).cast("bigint")), F.max(F.coalesce(time, F.lit("")) != "").over(w)


def build_chains(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """df(ord, memory_id, chain_id, person, time, text): adds chain, pos, total, relation, chain_prev, chain_next.

    Rows that name a chain form it if there are two or more of them; rows that name none form one with their
    person's if there are three or more.  What exceeds ``depth`` stays without a chain.
    """
    named = F.coalesce(F.col("chain_id"), F.lit("")) != ""
    person = F.when(F.coalesce(F.col("person"), F.lit("")).isin("", UNKNOWN), F.lit(None)).otherwise(F.col("person"))
    keyed = df.withColumns({"_kind": F.when(named, 0).when(person.isNotNull(), 1), "_key": F.when(named, F.col("chain_id")).otherwise(person)})
    by = ["_kind", "_key"]
    sized = keyed.withColumns({"_n": F.count("*").over(_over(by)), "_first": F.min("ord").over(_over(by))})
    chained = sized.filter(((F.col("_kind") == 0) & (F.col("_n") >= 2)) | ((F.col("_kind") == 1) & (F.col("_n") >= 3)))
    key, _ = time_order(F.col("time"), F.col("text"), by)
    placed = chained.withColumn("_sort", key).withColumn("pos", F.row_number().over(_over(by, "_sort", "ord"))).filter(F.col("pos") <= depth)
    timed = F.max(F.coalesce(F.col("time"), F.lit("")) != "").over(_over(by))
    ids = chain_ids(chained, "CHAIN_%05d", ["_kind", "_first"], by)
    told = placed.withColumns({"relation": F.when(timed, "时序").when(F.col("_kind") == 0, "因果").otherwise("关联"), "total": F.least(F.col("_n"), F.lit(depth)).cast("int")}).join(ids, by)
    links = linked(told).select("ord", "chain", "pos", "total", "relation", "chain_prev", "chain_next")
    return df.join(links, "ord", "left")


def chain_ids(df: DataFrame, label: str, order: list[str], by: list[str]) -> DataFrame:
    """(by..., chain): dense numbers in order of first appearance.  One row a chain is numbered, not the records."""
    groups = df.select(*by, *[c for c in order if c not in by]).distinct()
    return indexed(groups, order, "_i").select(*by, F.format_string(label, F.col("_i") + 1).alias("chain"))


def temporal_chains(df: DataFrame, least: int = 3, depth: int = DEPTH, label: str = "CHAIN_temporal_%04d") -> DataFrame:
    """df(ord, memory_id, person, time), all rows eligible: chains by person in order of time (as text), numbered by first appearance."""
    kept = df.filter((F.coalesce(F.col("person"), F.lit("")) != "") & (F.col("person") != UNKNOWN))
    firsts = kept.groupBy("person").agg(F.min("ord").alias("_first"))
    timed = kept.filter(F.coalesce(F.col("time"), F.lit("")) != "")
    w = _over(["person"])
    placed = timed.withColumns({"_n": F.count("*").over(w), "pos": F.row_number().over(w.orderBy("time", "ord"))}).filter((F.col("_n") >= least) & (F.col("pos") <= depth))
    ids = chain_ids(placed.select("person").distinct().join(firsts, "person"), label, ["_first"], ["person"])
    told = placed.join(ids, "person").withColumns({"total": F.least(F.col("_n"), F.lit(depth)).cast("int"), "relation": F.lit("时序")})
    return linked(told).drop("_n")


def summaries(df: DataFrame, by: str, position: str, text: str, separator: str = " → ", numbered: bool = False) -> DataFrame:
    """(by, n, members, summary): members and texts in order of position."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("memory_id").alias("m"), F.col(text).alias("t"))))  # a chain's rows
    got = df.groupBy(by).agg(F.count("*").alias("n"), listed.alias("x"))
    one = F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])) if numbered else F.transform("x", lambda x: x["t"])
    return got.select(by, "n", F.transform("x", lambda x: x["m"]).alias("members"), F.array_join(one, separator).alias("summary"))


def contiguity(df: DataFrame, chain: str, position: str) -> DataFrame:
    """(chain, n, contiguous): are the positions 1 to n?"""
    p = F.coalesce(F.col(position), F.lit(0))
    return df.filter(F.coalesce(F.col(chain), F.lit("")) != "").groupBy(chain).agg(
        F.count("*").alias("n"), ((F.min(p) == 1) & (F.max(p) == F.count("*")) & (F.countDistinct(p) == F.count("*"))).alias("contiguous")
    )


def gaps(df: DataFrame, chain: str, position: str) -> DataFrame:
    """(chain, gaps): chains with neighbours more than one position apart, and how many such places."""
    step = F.col(position) - F.lag(position).over(_over([chain], position))
    return df.filter(F.col(position).isNotNull()).select(chain, step.alias("step")).filter("step > 1").groupBy(chain).agg(F.count("*").alias("gaps"))


def broken_links(df: DataFrame, chain: str, position: str) -> DataFrame:
    """Rows whose chain_prev or chain_next is not the neighbour's id."""
    again = linked(df.withColumnsRenamed({"chain_prev": "_prev", "chain_next": "_next"}), chain, position)
    return again.filter((F.col("_prev") != F.col("chain_prev")) | (F.col("_next") != F.col("chain_next")))


def neighbour_links(df: DataFrame, keys: list[str], reach: int = 4, strength: float = 0.3) -> DataFrame:
    """(src, dst, kind, strength): each row with the next ``reach`` of the same key, for each of ``keys``, in order of ord.

    Rows are ranked in ranges of (key, ord) and meet the next ranks by an equi-join, so a key that a third of all rows have
    is spread over many tasks.
    """
    parts = []
    for k in keys:
        kept = df.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").select(F.col(k).alias("_k"), "ord", "memory_id")
        placed = indexed(kept, ["_k", "ord"], "_i").select("_k", "_i", "memory_id")
        asks = placed.select(F.col("_k").alias("_key"), F.col("memory_id").alias("src"), F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + reach)).alias("_next"))
        met = asks.join(placed, (F.col("_next") == F.col("_i")) & (F.col("_key") == F.col("_k")))
        parts.append(met.select("src", F.col("memory_id").alias("dst"), F.lit(k).alias("kind"), F.lit(strength).alias("strength")))
    return reduce(DataFrame.union, parts)
