"""Joins in time: the row that held at a moment, and intervals that overlap.  No range join: rows meet by key and time bucket.

As-of join.  Facts and versions are dealt to (key, bucket of time).  Inside one, a window carries the last version on to the facts after
it.  What a bucket hands on is one row, its last version; those rows, at most one a key and bucket, are carried on over the buckets
of the key in a second window, and each bucket takes what came before it.  So a key with a third of all rows is as many tasks' work as it has
buckets, and neither side is sorted whole.

Interval join.  Each interval is cut to the buckets that it touches and meets there what has the same key and bucket; a pair is
made once, in the bucket where the later of the two begins.

Cases: rows with a null key or a null time meet nothing (facts keep their row in the as-of join, with nulls beside it); of versions with one key and
time the one with the greatest order counts; an interval that ends before it starts is empty and meets nothing; intervals are half open, so one
that ends where another starts does not meet it, and one of no length meets those that it lies in; columns of the other side keep their names
under a prefix; an empty side gives what a left or an inner join with it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bucket_of(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (1_000_000 * seconds))


def as_of(facts: DataFrame, versions: DataFrame, key: str, time: str, order: str, seconds: int = 86_400, within: int | None = None, prefix: str = "as_of_") -> DataFrame:
    """All rows of ``facts`` with the columns of the last of ``versions`` (same key, time not later) under ``prefix``, or nulls.

    ``order`` is a column of versions that tells those of one time apart; ``within``: a version older than so many seconds does not count.
    """
    names, held = facts.columns, [c for c in versions.columns if c != key]
    moment = lambda t: F.unix_micros(t.cast("timestamp"))
    left = facts.select(F.col(key).alias("_k"), moment(F.col(time)).alias("_t"), bucket_of(F.col(time), seconds).alias("_b"), F.struct(*names).alias("_fact"), F.lit(None).cast(versions.select(F.struct(*held)).schema[0].dataType).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(versions.schema[order].dataType).alias("_o"))
    right = versions.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_k"), moment(F.col(time)).alias("_t"), bucket_of(F.col(time), seconds).alias("_b"), F.lit(None).cast(facts.select(F.struct(*names)).schema[0].dataType).alias("_fact"), F.struct(*held).alias("_v"), F.lit(0).alias("_side"), F.col(order).alias("_o"),
    )
    timed = left.filter("_k is not null and _t is not null")
    # versions of one moment come before the facts of it
    inside = W.partitionBy("_k", "_b").orderBy("_t", "_side", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = timed.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1").select("_k", "_b", "_t", "_fact", "_v")
    lasts = right.groupBy("_k", "_b").agg(F.max_by(F.struct("_v", "_t"), F.struct("_t", "_o")).alias("_last"))
    # one row a key and bucket that has facts or versions: what the buckets before it leave
    present = timed.select("_k", "_b").distinct().join(lasts, ["_k", "_b"], "full_outer")
    before = F.last("_last", ignorenulls=True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    inherited = present.withColumn("_old", before).filter("_old is not null").select("_k", "_b", F.col("_old._v").alias("_old"))
    found = carried.join(inherited, ["_k", "_b"], "left").withColumn("_v", F.coalesce("_v", "_old"))
    lost = left.filter("_k is null or _t is null").select("_t", "_fact", "_v")
    out = found.select("_t", "_fact", "_v").unionByName(lost)
    if within is not None:
        out = out.withColumn("_v", F.when(F.col("_t") - moment(F.col(f"_v.{time}")) <= within * 1_000_000, F.col("_v")))
    return out.select("_fact.*", *[F.col(f"_v.{c}").alias(f"{prefix}{c}") for c in held])


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, seconds: int = 86_400, prefix: str = "other_") -> DataFrame:
    """Pairs of a row of each side with one key whose intervals [start, end) overlap; columns of ``right`` stand under ``prefix``."""

    def cut(df: DataFrame, side: str) -> DataFrame:
        whole = df.filter(F.col(key).isNotNull() & (F.col(start).cast("timestamp") <= F.col(end).cast("timestamp")))
        first, s, e = bucket_of(F.col(start), seconds), F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
        last = F.greatest(first, F.floor((e - 1) / (1_000_000 * seconds)))  # the bucket of its last moment
        return whole.select(F.col(key).alias("_k"), F.explode(F.sequence(first, last)).alias("_b"), s.alias(f"_s{side}"), e.alias(f"_e{side}"), first.alias(f"_f{side}"), F.struct(*df.columns).alias(f"_{side}"))

    met = cut(left, "l").join(cut(right, "r"), ["_k", "_b"]).filter(F.col("_b") == F.greatest("_fl", "_fr"))
    # of two that start together both have to hold a moment, unless one of them is that moment
    starts, ends = F.greatest("_sl", "_sr"), F.least("_el", "_er")
    point = ((F.col("_sl") == F.col("_el")) & (F.col("_sl") >= F.col("_sr")) & (F.col("_sl") < F.col("_er"))) | ((F.col("_sr") == F.col("_er")) & (F.col("_sr") >= F.col("_sl")) & (F.col("_sr") < F.col("_el")))
    both = met.filter((starts < ends) | point)
    return both.select("_l.*", *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in right.columns])
