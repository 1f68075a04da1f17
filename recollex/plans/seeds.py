"""Queries of designed seeds; conversations are chains, roles of a conversation clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import seeds as sd
from recollex.plans.catalogue import query
from recollex.session import table

RELATIONS, KINDS, ASKS = ("时序", "因果", "对比", "包含", "推导", "别的"), ("人物", "事件", "地点", "别的"), (*sd.SINGLE, "别的")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, nth = F.col("conv_id"), F.col("turn"), lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    chain, cluster = c % 3 == 0, c % 3 == 1
    name = F.concat(F.lit("p"), c.cast("string"), F.when((c % 2 == 0) & (t % 2 == 1), "b").otherwise(""))
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("ord"), F.format_string("s%d-%d", c, t).alias("id"), name.alias("person"), F.lit("i").alias("identity"), F.lit(None).cast("string").alias("partner"), F.lit(None).cast("string").alias("partner_identity"),
        F.lit(None).cast("string").alias("relation"), F.concat(F.lit("c"), t.cast("string")).alias("city"), F.lit("馆").alias("place"), F.lit(None).cast("string").alias("landmark"), F.col("role").alias("event_type"), F.lit("看").alias("action"),
        F.concat(F.lit("x"), c.cast("string")).alias("product"), (t % 3).alias("quantity"), F.lit(0).cast("bigint").alias("price"), F.lit("2024-01-31 08:00:00").alias("ts"), (t * 150 + c).alias("days"),
        F.array(F.lit("推理测试"), F.lit("y"), nth(RELATIONS, c % 6)).alias("tags"), F.when(cluster, F.concat_ws("-", c.cast("string"), F.col("role"))).alias("cluster_id"), nth(KINDS, F.floor(c / 3) % 4).alias("cluster_kind"),
        F.when(chain, F.concat(F.lit("h"), c.cast("string"))).alias("chain_id"), F.when(chain, t + 1).cast("int").alias("chain_pos"), F.lit(None).cast("int").alias("chain_total"), F.array(nth(ASKS, (c + t) % len(ASKS))).alias("asks"),
    )


_SEEDS = f"""
s as (select *, conv_id * 1000 + turn as ord, 's' || conv_id || '-' || turn as id, 'p' || conv_id || case when conv_id % 2 = 0 and turn % 2 = 1 then 'b' else '' end as person, 'c' || turn as city, 'x' || conv_id as product,
    turn * 150 + conv_id as days, {list(RELATIONS)}[conv_id % 6 + 1] as relation, {list(KINDS)}[(conv_id // 3) % 4 + 1] as kind, {list(ASKS)}[(conv_id + turn) % {len(ASKS)} + 1] as ask from conversations),
t as (select *, person || '在' || city || '看了' || product as told, case when turn % 3 > 1 then '，数量' || (turn % 3) else '' end as counted, case when days > 730 then '困难' when days > 365 then '中等' else '简单' end as level from s)"""


@query(f"""with {_SEEDS}
select id as memory_id, '推理测试测试集' as category, level as difficulty, case level when '困难' then 1.5 when '中等' then 1.0 else 0.5 end::double as weight,
  case when days <= 1 then '刚刚' when days <= 7 then days || '天前' when days <= 30 then days // 7 || '周前' when days <= 365 then days // 30 || '个月前' else days // 365 || '年前' end as relative,
  person || '在' || city || '馆看了' || product || counted as content, case when conv_id % 3 = 0 then relation end as chain_relation, case when conv_id % 3 = 0 and relation in ('因果', '推导') then relation end as logic,
  case when conv_id % 3 = 0 then coalesce(lag(id) over w, '') end as chain_prev, case when conv_id % 3 = 0 then coalesce(lead(id) over w, '') end as chain_next,
  case when conv_id % 3 = 2 then concat_ws(',', person, city, role, '看', product) end as keywords
from t window w as (partition by conv_id order by turn)""")
def seed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.seed_memories(seeds(spark, sf_dir)).select(
        "memory_id", "category", "difficulty", "weight", F.col("time.relative").alias("relative"), F.get("versions", F.lit(0))["content"].alias("content"), "chain_relation", F.col("logic.type").alias("logic"), "chain_prev", "chain_next",
        F.array_join("retrieval_keywords", ",").alias("keywords"),
    )


def _case(column: str, texts: dict[str, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in texts.items()) + f" else {other} end"


_CHAINS = _case("relation", {k: "'" + v[0].replace("{start}", "' || start || '").replace("{other}", "' || other || '") + "'" for k, v in sd.CHAINS.items()}, "'关于' || person || '在' || city || '的事件'")
_SINGLE = _case("ask", {k: "'" + v[0].replace("{start}", "{told}").replace("{action}", "看").replace("{", "' || ").replace("}", " || '") + "'" for k, v in sd.SINGLE.items()}, "person || '在' || city || '的事件'")


@query(f"""with {_SEEDS},
h as (select conv_id, arg_min(told, turn) as start, arg_min(person, turn) as person, arg_min(city, turn) as city, min(relation) as relation, list(id order by turn) as ids, string_agg(told, ' → ' order by turn) as answer,
    case when conv_id % 2 = 0 and count(*) > 1 then 'p' || conv_id || case when min(turn) % 2 = 1 then '' else 'b' end else '其他人' end as other from t where conv_id % 3 = 0 group by conv_id),
g as (select conv_id, role, min(kind) as kind, arg_min(person, turn) as person, arg_min(city, turn) as city, list(id order by turn) as ids, string_agg(told, '；' order by turn) as answer from t where conv_id % 3 = 1 group by conv_id, role)
select '1h' || conv_id as sort, {_CHAINS} as query_text, {_case("relation", {k: f"'{v[1]}'" for k, v in sd.CHAINS.items()}, "'链式查询'")} as query_type, array_to_string(ids, ',') as ids, case when relation = '别的' then '' else answer end as answer, '中等' as difficulty from h
union all select '2' || conv_id || '-' || role, {_case("kind", {"人物": "person || '的活动记录有哪些'", "事件": "'关于' || role || '的事件有哪些'", "地点": "'在' || city || '发生的事件有哪些'"}, "'相关事件'")}, '聚类检索', array_to_string(ids, ','), answer, '简单' from g
union all select '3:' || id || ':' || ask, {_SINGLE}, case ask when '深度检索' then '深度推理' else ask end, id, told || counted, level from t""")
def seed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.seed_questions(seeds(spark, sf_dir)).select("sort", "query_text", "query_type", F.array_join("expected_memory_ids", ",").alias("ids"), F.col("expected_answer_text").alias("answer"), "difficulty")
