"""Six evaluations of a retriever over a record database, from one search job.

All probes of all evaluations are searched together for their first 20 results; an evaluation that looks at
fewer takes the first of them, which are the same.  The report is a long frame (dimension, metric, key, value),
unrounded; a value that does not apply is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.functions.text import entities
from recollex.operators.search import Retriever, keyword_ranks
from recollex.session import written
from recollex.sources.database import entries, store

K, PER_CLUSTER, PER_DECAY, DEEP = 20, 3, 20, 30
#: Names that the records use.
HIGH, LOW = ("高频记忆",), ("低频记忆", "偶发事件")
CHAIN_TYPES, LOGIC_TYPES = ("组合推理",), ("事件检索", "组合检索")
DEEP_CATEGORY = "长期记忆深度检索测试集"
DISTANCES = {"近": "near", "中": "mid", "远": "far"}


def text_of(mems: DataFrame) -> Column:
    """The first version's content, else the record's."""
    first = F.when(F.size("versions") > 0, F.coalesce(F.get("versions", F.lit(0))["content"], F.lit("")))
    return F.coalesce(first, F.col("content"), F.lit(""))


def own_text(mems: DataFrame) -> Column:
    """The record's content, else that of its first version: what cleaning compares."""
    return F.coalesce(F.col("content"), F.when(F.size("versions") > 0, F.get("versions", F.lit(0))["content"]), F.lit(""))


def entity_index(stored: DataFrame) -> DataFrame:
    """(entity, memory_id): distinct names found in the contents that the store ends up with."""
    return stored.select("memory_id", F.explode(entities(F.col("content"))).alias("entity")).distinct().select("entity", "memory_id")


def expected_ids(queries: DataFrame, stored: DataFrame, extended: bool = True) -> DataFrame:
    """(ord, memory_id): the ids a query names, else those of its target entity."""
    named = queries.select("ord", F.explode(F.array_distinct("expected_memory_ids")).alias("memory_id"))
    if not extended:
        return named
    asked = queries.filter((F.size("expected_memory_ids") == 0) & F.col("target_entity").isNotNull()).select("ord", F.col("target_entity").alias("entity"))
    return named.union(asked.join(entity_index(stored), "entity").select("ord", "memory_id"))


def first_in(df: DataFrame, by: list[str], n: int, order: str = "ord") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("_r") <= n).drop("_r")


def cluster_probes(mems: DataFrame) -> DataFrame:
    """The first three members of each cluster of two or more: (eval, key, ord, memory_id, text)."""
    sized = mems.filter(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != "")).withColumn("_n", F.count("*").over(W.partitionBy("cluster_id"))).filter("_n >= 2")
    named = F.trim(F.concat_ws(" ", F.coalesce("person.name", F.lit("")), F.coalesce("event.product", F.lit(""))))
    return first_in(sized, ["cluster_id"], PER_CLUSTER).select(
        F.lit("cluster").alias("eval"), F.col("cluster_id").alias("key"), "ord", "memory_id", F.when(named != "", named).otherwise(F.substring(F.coalesce("content", F.lit("")), 1, 40)).alias("text")
    )


def decay_probes(mems: DataFrame) -> DataFrame:
    level = F.when(F.col("decay.level").isin(*HIGH), "high").when(F.col("decay.level").isin(*LOW), "low")
    kept = mems.withColumn("key", level).filter("key is not null")
    return first_in(kept, ["key"], PER_DECAY).select(F.lit("decay").alias("eval"), "key", "ord", "memory_id", text_of(mems).alias("text"))


def deep_probes(mems: DataFrame) -> DataFrame:
    raw = F.coalesce("depth.semantic_distance", F.lit("近"))
    key = F.coalesce(*[F.when(raw == a, b) for a, b in DISTANCES.items()], F.when(raw.isin(*DISTANCES.values()), raw))
    first = mems.filter(F.col("category") == DEEP_CATEGORY).orderBy("ord").limit(DEEP)
    return first.select(F.lit("deep").alias("eval"), key.alias("key"), "ord", "memory_id", text_of(mems).alias("text"))


def _rows(df: DataFrame, dimension: str, values: dict[str, Column | str], key: Column | None = None) -> DataFrame:
    """One row for each metric of each row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value")) for m, v in values.items()])
    made = df.select((F.lit("") if key is None else key).alias("key"), F.explode(pairs).alias("x"))
    return made.select(F.lit(dimension).alias("dimension"), F.col("x.metric").alias("metric"), "key", F.col("x.value").alias("value"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def storage(mems: DataFrame) -> DataFrame:
    stored = entries(mems).agg(F.count("*").alias("stored"))
    both = stored.crossJoin(mems.agg(F.count("*").alias("total")))  # one row each
    return _rows(both, "storage", {"stored_count": "stored", "total": "total", "integrity": _share(F.col("stored"), F.col("total"))})


def retrieval(queries: DataFrame, expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked(ord, rank, memory_id): by type over the queries that expect something; overall precision counts all queries.

    One pass: each query is a row with what it expects and what of it was found, and grouping sets make the types and the whole of it.
    """
    hits = ranked.select("ord", "memory_id").distinct().withColumn("hit", F.lit(1))
    wanted = expected.join(hits, ["ord", "memory_id"], "left").groupBy("ord").agg(F.count("*").alias("expected"), F.count("hit").alias("correct"))
    each = queries.select("ord", F.coalesce("query_type", F.lit("unknown")).alias("type")).join(wanted, "ord", "left")
    nothing = each.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in each.schema])
    each = each.unionByName(nothing)  # counts nothing, but without queries there is a total too
    sums = each.groupingSets([[F.col("type")], []], "type").agg(F.grouping_id().alias("whole"), F.count("ord").alias("all"), F.count("expected").alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("c"), F.coalesce(F.sum("expected"), F.lit(0)).alias("e"))
    recall = _share(F.col("c"), F.col("e"))
    values = {0: {"precision": _share(F.col("c"), F.col("n") * K), "recall": recall, "count": F.col("n")}, 1: {"overall_precision": _share(F.col("c"), F.col("all") * K), "overall_recall": recall}}
    by, total = (F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values[i].items()]) for i in (0, 1))
    made = sums.filter("whole = 1 or n > 0").select(F.coalesce("type", F.lit("")).alias("key"), F.explode(F.when(F.col("whole") == 1, total).otherwise(by)).alias("x"))
    return made.select(F.lit("retrieval").alias("dimension"), F.col("x.metric").alias("metric"), "key", F.col("x.value").alias("value"))


def organization(mems: DataFrame, found: DataFrame) -> DataFrame:
    """found(key, ord, memory_id, result): a probe is right if a mate of its cluster, not itself, is among its first ten."""
    clustered = mems.filter(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != ""))
    mates = clustered.select(F.col("cluster_id").alias("key"), F.col("memory_id").alias("result"))
    right = found.filter("rank <= 10 and result <> memory_id").join(mates, ["key", "result"], "left_semi").select("key", "ord").distinct().withColumn("hit", F.lit(1))
    probes = cluster_probes(mems).select("key", "ord").join(right, ["key", "ord"], "left")
    one = probes.agg(F.count("*").alias("n"), F.count("hit").alias("c")).crossJoin(clustered.agg(F.countDistinct("cluster_id").alias("clusters")))
    accuracy = F.when(F.col("clusters") > 0, _share(F.col("c"), F.col("n")))
    return _rows(one, "organization", {"cluster_accuracy": accuracy, "clusters_tested": "clusters"})


def _self_hits(probes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: for each key the share of probes that found themselves among their first ten, and their number."""
    hit = found.filter("rank <= 10 and result = memory_id").select("key", "ord").distinct().withColumn("hit", F.lit(1))
    joined = probes.select("key", "ord").join(hit, ["key", "ord"], "left")
    return joined.agg(*[x for k in keys for x in (F.count(F.when((F.col("key") == k) & (F.col("hit") == 1), 1)).alias(f"c_{k}"), F.count(F.when(F.col("key") == k, 1)).alias(f"n_{k}"))])


def forgetting(mems: DataFrame, found: DataFrame) -> DataFrame:
    one = _self_hits(decay_probes(mems), found, ["high", "low"])
    high, low = _share(F.col("c_high"), F.col("n_high")), _share(F.col("c_low"), F.col("n_low"))
    valid = (F.bround(high, 3) > F.bround(low, 3)).cast("int")
    return _rows(one, "forgetting", {"high_freq_retention": high, "low_freq_retention": low, "forgetting_ratio_valid": valid})


def deep(mems: DataFrame, found: DataFrame) -> DataFrame:
    one = _self_hits(deep_probes(mems), found, list(DISTANCES.values())).crossJoin(mems.agg(F.count(F.when(F.col("category") == DEEP_CATEGORY, 1)).alias("all")))
    return _rows(one, "deep_retrieval", {k: F.when(F.col("all") > 0, _share(F.col(f"c_{k}"), F.col(f"n_{k}"))) for k in DISTANCES.values()})


def reasoning(queries: DataFrame, ranked: DataFrame, extended: bool = False) -> DataFrame:
    """Share of queries of a kind with any named id among their results; ``extended`` also takes the chain types of generated databases."""
    named = queries.select("ord", F.explode("expected_memory_ids").alias("memory_id"))
    hit = ranked.join(named, ["ord", "memory_id"], "left_semi").select("ord").distinct().withColumn("hit", F.lit(1))
    chain = F.col("query_type").isin(*CHAIN_TYPES) | (F.col("query_type").endswith("推理链") if extended else F.lit(False))
    each = queries.select("ord", F.when(chain, "chain").when(F.col("query_type").isin(*LOGIC_TYPES), "logic").alias("kind")).filter("kind is not null").join(hit, "ord", "left")
    count = lambda k, hit=False: F.count(F.when((F.col("kind") == k) & ((F.col("hit") == 1) if hit else F.lit(True)), 1))
    one = each.agg(*[x for k in ("logic", "chain") for x in (count(k, True).alias(f"c_{k}"), count(k).alias(f"n_{k}"))])
    return _rows(one, "reasoning", {f"{k}_accuracy": _share(F.col(f"c_{k}"), F.col(f"n_{k}")) for k in ("logic", "chain")})


def search_all(mems: DataFrame, queries: DataFrame, retriever: Retriever = keyword_ranks) -> DataFrame:
    """(eval, key, ord, memory_id, rank, result) for the probes of all evaluations."""
    stored = store(entries(mems), seq="seq")
    asked = queries.select(F.lit("query").alias("eval"), F.lit("").alias("key"), "ord", F.lit("").alias("memory_id"), F.col("query_text").alias("text"))
    probes = asked.union(cluster_probes(mems)).union(decay_probes(mems)).union(deep_probes(mems)).withColumn("probe", F.concat_ws("|", "eval", "key", "ord"))
    probes = written(probes, "probes", few=True)
    ranked = retriever(stored, probes.select("probe", "text"), K).select("probe", "rank", F.col("memory_id").alias("result"))
    return written(probes.select("probe", "eval", "key", "ord", "memory_id").join(ranked, "probe").drop("probe"), "ranked")


def evaluate(mems: DataFrame, queries: DataFrame, retriever: Retriever = keyword_ranks, extended: bool = False) -> DataFrame:
    """The whole report; of an empty database one row (error, empty database)."""
    if not mems.head(1):
        return mems.sparkSession.createDataFrame([("error", "empty database", "", None)], "dimension string, metric string, key string, value double")
    found = search_all(mems, queries, retriever)
    of = lambda e: found.filter(F.col("eval") == e)
    ranked = of("query").select("ord", "rank", F.col("result").alias("memory_id"))
    expected = expected_ids(queries, store(entries(mems), seq="seq"))
    parts = [storage(mems), retrieval(queries, expected, ranked), organization(mems, of("cluster")), forgetting(mems, of("decay")), reasoning(queries, ranked, extended), deep(mems, of("deep"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nested(report: DataFrame) -> dict:
    """The report as nested dicts, rounded to three digits; what does not apply is "N/A"."""
    out: dict = {}
    for r in report.collect():  # a few rows for each metric and query type
        value = "N/A" if r["value"] is None else round(r["value"], 3)
        section = out.setdefault(r["dimension"], {})
        if r["key"]:
            section.setdefault("by_type", {}).setdefault(r["key"], {})[r["metric"]] = value
        else:
            section[r["metric"]] = value
    return out


def summary(report: DataFrame) -> str:
    lines = []
    for dimension, values in nested(report).items():
        lines.append(f"[{dimension}]")
        for metric, v in values.items():
            if isinstance(v, dict):
                lines += [f"  {t}: " + ", ".join(f"{m} {x}" for m, x in row.items()) for t, row in v.items()]
            else:
                lines.append(f"  {metric}: " + (f"{v:.1%}" if isinstance(v, float) and v <= 1 else str(v)))
    return "\n".join(lines)
