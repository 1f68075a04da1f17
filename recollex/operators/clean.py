"""Cleaning of an existing database: duplicates go, questions lose ids that are gone, no person has too many questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.operators.evaluate import own_text
from recollex.operators.mining import deduplicate

QUESTIONS_PER_PERSON = 10
UNKNOWN = "未知"


def prune_ids(queries: DataFrame, mems: DataFrame, keep_negatives: bool = False) -> DataFrame:
    """Expected ids that exist, in order, repeats kept; questions left without one go, negatives too unless kept."""
    each = queries.select("ord", F.posexplode("expected_memory_ids").alias("p", "memory_id"))
    valid = each.join(mems.select("memory_id").distinct(), "memory_id", "left_semi")
    lists = valid.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "memory_id"))), lambda x: x["memory_id"]).alias("_valid"))
    kept = queries.join(lists, "ord", "left")
    stays = F.col("_valid").isNotNull() | ((F.size("expected_memory_ids") == 0) & F.col("is_negative") if keep_negatives else F.lit(False))
    return kept.filter(stays).withColumn("expected_memory_ids", F.coalesce("_valid", F.array().cast("array<string>"))).drop("_valid")


def with_person(queries: DataFrame, mems: DataFrame) -> DataFrame:
    """Adds person: of the first expected record, or 未知."""
    people = mems.select(F.col("memory_id").alias("_m"), F.col("person.name").alias("_p")).dropDuplicates(["_m"])
    first = queries.withColumn("_f", F.get("expected_memory_ids", F.lit(0)))
    return first.join(people, F.col("_f") == F.col("_m"), "left").withColumn("person", F.coalesce("_p", F.lit(UNKNOWN))).drop("_f", "_m", "_p")


def cap_questions(queries: DataFrame, cap: int = QUESTIONS_PER_PERSON, varied: bool = False) -> DataFrame:
    """At most ``cap`` questions of each person: the first, or (varied) as many of each type as fit, then in hash order."""
    w = W.partitionBy("person")
    if not varied:
        return queries.withColumn("_r", F.row_number().over(w.orderBy("ord"))).filter(F.col("_r") <= cap).drop("_r")
    types = queries.groupBy("person").agg(F.countDistinct("query_type").alias("_types"), F.count("*").alias("_n"))
    ranked = queries.join(types, "person").withColumn("_in", F.row_number().over(W.partitionBy("person", "query_type").orderBy("ord")))
    even = ranked.filter((F.col("_n") <= cap) | (F.col("_in") <= F.greatest(F.floor(F.lit(cap) / F.col("_types")), F.lit(1))))
    order = F.md5(F.concat(F.lit("42:"), F.col("ord").cast("string")))
    return even.withColumn("_r", F.row_number().over(w.orderBy(order, "ord"))).filter((F.col("_n") <= cap) | (F.col("_r") <= cap)).drop("_types", "_n", "_in", "_r")


def clean(mems: DataFrame, queries: DataFrame, keep_negatives: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, queries, statistics) after deduplication, pruning and capping."""
    slim = mems.select(
        "ord", own_text(mems).alias("content"), F.coalesce("person.name", F.lit(UNKNOWN)).alias("person"), F.coalesce(F.col("attrs")["event_type"], F.col("event.product"), F.lit("")).alias("event_type"),
        F.coalesce(F.col("attrs")["book"], F.lit("")).alias("book"),
    )
    kept, stats = deduplicate(slim)
    left = mems.join(kept.select("ord"), "ord", "left_semi")
    pruned = with_person(prune_ids(queries, left, keep_negatives), left)
    return left, cap_questions(pruned).drop("person"), stats
