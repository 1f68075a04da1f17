"""Records and questions from designed seeds, which come as a frame.

A seed has ord, id, person, identity, partner, partner_identity, relation, city, place, landmark, event_type, action, product, quantity,
price, ts (yyyy-MM-dd HH:mm:ss), days (its age), tags, cluster_id, cluster_kind (what the members share), chain_id, chain_pos,
chain_total and asks (the kinds of questions to be asked about it alone).  Null texts are told as "".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.functions.text import fill
from recollex.functions.times import difficulty, fuzzy_designed, relative_designed, weight
from recollex.operators.chains import linked
from recollex.schema import MEMORIES

#: How a seed's category ends, the relations of which a record has a logic, what stands for an unnamed second person.
SUFFIX, LOGICAL, OTHERS = "测试集", ("因果", "推导"), "其他人"
#: Question, type and dimension of a chain by its relation.
CHAINS = {
    "时序": ("{start}，后续事件依次是什么？", "时序推理链", "时序推理"),
    "因果": ("因为{start}，后续导致了哪些事件？", "因果推理链", "因果推理"),
    "对比": ("{start}，和{other}的做法有什么不同？", "对比推理链", "对比推理"),
    "包含": ("{start}，这件事包含了哪些子事件？", "包含推理链", "包含推理"),
    "推导": ("从{start}出发，能推导出什么？", "推导推理链", "推导推理"),
}
#: Question about a cluster by what its members share, and of any other.
CLUSTERS, CLUSTER = {"人物": "{person}的活动记录有哪些", "事件": "关于{event_type}的事件有哪些", "地点": "在{city}发生的事件有哪些"}, "相关事件"
#: Question, type and dimension of a single record by kind, and of any other kind.
SINGLE = {
    "人物检索": ("{person}做了什么", "人物检索", "精确检索"),
    "地点检索": ("在{city}发生过什么", "地点检索", "精确检索"),
    "事件检索": ("关于{product}的事件有哪些", "事件检索", "精确检索"),
    "组合检索": ("{person}在{city}的{action}记录", "组合检索", "组合检索"),
    "跨版本": ("关于{start}的详情，多说点", "跨版本", "跨版本"),
    "深度检索": ("{person}的早期经历对后续发展有什么影响", "深度推理", "深度检索"),
}
ELSE = "{person}在{city}的事件"

_SLIM = ("ord", "id", "person", "city", "action", "product", "event_type")


def _told(x: Column | None = None, place: bool = False) -> Column:
    """Who did what where."""
    c = lambda n: F.coalesce(F.col(n) if x is None else x[n], F.lit(""))
    return F.concat(c("person"), F.lit("在"), c("city"), *([c("place")] if place else []), c("action"), F.lit("了"), c("product"))


def _counted(text: Column, before: str) -> Column:
    return F.concat(text, F.when(F.col("quantity") > 1, F.concat(F.lit(before), F.col("quantity").cast("string"))).otherwise(""))


def _filled(templates: dict[str, str], kind: Column, any_else: str, **values: Column) -> Column:
    return reduce(lambda c, x: c.when(kind == x[0], fill(x[1], **values)), templates.items(), F.when(F.lit(False), F.lit(""))).otherwise(fill(any_else, **values))


def _looked_up(names: dict[str, str], kind: Column, other: Column) -> Column:
    return reduce(lambda c, x: c.when(kind == x[0], x[1]), names.items(), F.when(F.lit(False), F.lit(""))).otherwise(other)


def seed_memories(seeds: DataFrame) -> DataFrame:
    """The seeds in the schema MEMORIES.  The category is the first tag's, as checks and evaluations of designed records expect."""
    chained, first = F.col("chain_id").isNotNull(), F.get("tags", F.lit(0))
    relation = F.when(chained, F.get("tags", F.lit(2)))
    way = lambda name, style, text: F.struct(F.lit(name).alias("version_id"), F.lit(style).alias("style"), text.alias("content"))
    ways = F.array(
        way("v1", "客观叙述", _counted(_told(place=True), "，数量")), way("v2", "主观视角", _counted(F.concat(F.lit("我记得"), _told(place=True)), "，一共")),
        way("v3", "第三方转述", F.concat(F.coalesce("partner", F.lit("")), F.lit("提起过"), _told())),
    )
    level = difficulty(F.col("days"))
    made = linked(seeds.withColumn("_chain", F.when(chained, F.concat(F.lit("chain:"), "chain_id")).otherwise(F.concat(F.lit("one:"), "id"))), "_chain", "chain_pos", "id")
    columns = {
        "ord": F.col("ord"), "memory_id": F.col("id"), "category": F.concat(first, F.lit(SUFFIX)), "difficulty": level, "weight": weight(level),
        "time": F.struct(F.col("ts").alias("absolute"), relative_designed(F.col("days")).alias("relative"), fuzzy_designed(F.col("days")).alias("fuzzy"), F.unix_timestamp(F.try_to_timestamp("ts")).alias("timestamp"), F.lit("").alias("era")),
        "location": F.struct("city", "place", F.coalesce("landmark", F.lit("")).alias("landmark")),
        "person": F.struct(F.col("person").alias("name"), "identity", F.coalesce("partner", F.lit("")).alias("partner_name"), F.coalesce("partner_identity", F.lit("")).alias("partner_identity"), F.coalesce("relation", F.lit("")).alias("relation")),
        "event": F.struct(F.col("event_type").alias("type"), "action", "product", "quantity", "price"), "versions": ways, "tags": F.col("tags"), "cluster_id": F.col("cluster_id"), "reasoning_chain": F.col("chain_id"),
        "chain_position": F.col("chain_pos"), "chain_hop": F.when(chained, F.col("chain_pos")), "chain_total": F.when(chained, F.col("chain_total")), "chain_relation": relation,
        "chain_prev": F.when(chained, F.col("chain_prev")), "chain_next": F.when(chained, F.col("chain_next")), "logic": F.struct(F.when(relation.isin(*LOGICAL), relation).alias("type")),
        "retrieval_keywords": F.when(~chained & F.col("cluster_id").isNull(), F.array("person", "city", "event_type", "action", "product")),
    }
    return made.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(MEMORIES)])


def _asked(df: DataFrame, text: Column, kind: Column, dimension: Column, ids: Column, answer: Column, level: Column) -> DataFrame:
    return df.select(F.col("sort"), text.alias("query_text"), kind.alias("query_type"), dimension.alias("test_dimension"), ids.alias("expected_memory_ids"), answer.alias("expected_answer_text"), F.array(answer).alias("acceptable_answers"), F.lit(False).alias("is_negative"), level.alias("difficulty"))


def seed_questions(seeds: DataFrame) -> DataFrame:
    """(sort, query_text, ...): one question for each chain and each cluster, and one for each kind that a seed asks.

    The answer lists all members of a chain or cluster, so a chain is as long as its answer may be.
    """
    steps = seeds.filter("chain_id is not null").groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("chain_pos", *_SLIM))).alias("x"), F.min_by(F.get("tags", F.lit(2)), F.struct("chain_pos", "ord")).alias("relation")).withColumn("sort", F.concat(F.lit("1"), "chain_id"))
    x, relation = F.col("x"), F.col("relation")
    first = F.get(x, F.lit(0))
    other = F.coalesce(F.get(F.array_distinct(F.transform(x, lambda s: s["person"])), F.lit(1)), F.lit(OTHERS))
    known = {k: v[0] for k, v in CHAINS.items()}
    listed = lambda between: F.array_join(F.transform(x, lambda s: _told(s)), between)
    ids = F.transform(x, lambda s: s["id"])
    chains = _asked(
        steps, _filled(known, relation, "关于{person}在{city}的事件", start=_told(first), other=other, person=first["person"], city=first["city"]), _looked_up({k: v[1] for k, v in CHAINS.items()}, relation, F.lit("链式查询")),
        _looked_up({k: v[2] for k, v in CHAINS.items()}, relation, F.lit("链式推理")), ids, F.when(relation.isin(*CHAINS), listed(" → ")).otherwise(""), F.lit("中等"),
    )
    groups = seeds.filter("cluster_id is not null").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(*_SLIM))).alias("x"), F.min_by("cluster_kind", "ord").alias("kind")).withColumn("sort", F.concat(F.lit("2"), "cluster_id"))
    clusters = _asked(groups, _filled(CLUSTERS, F.col("kind"), CLUSTER, person=first["person"], event_type=first["event_type"], city=first["city"]), F.lit("聚类检索"), F.lit("聚类检索"), ids, listed("；"), F.lit("简单"))
    each = seeds.withColumn("kind", F.explode("asks")).withColumn("sort", F.concat_ws(":", F.lit("3"), "id", "kind"))
    kind = F.col("kind")
    values = {n: F.col(n) for n in ("person", "city", "product", "action")}
    single = _asked(
        each, _filled({k: v[0] for k, v in SINGLE.items()}, kind, ELSE, start=_told(), **values), _looked_up({k: v[1] for k, v in SINGLE.items()}, kind, kind), _looked_up({k: v[2] for k, v in SINGLE.items()}, kind, F.lit("精确检索")),
        F.array("id"), _counted(_told(), "，数量"), difficulty(F.col("days")),
    )
    return chains.union(clusters).union(single)
