"""The driver's tables in the roles of records and questions.

Turns of conversations are records: a conversation is a cluster and a chain, the turn is the place in it; a
record's category, decay and distance follow from its numbers.  Each conversation asks one question, with the words
of its first turn, about its other turns; every fifth is negative, every tenth names an entity and no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import table

CATEGORIES = ("存储正确性测试集", "检索功能测试集", "记忆整理测试集", "遗忘功能测试集", "逻辑推理测试集", "长期记忆深度检索测试集")
DECAY = ("高频记忆", "中等频率", "低频记忆", "偶发事件")
DISTANCES = ("近", "中", "远")
RELATIONS = ("时序", "因果", "对比", "包含", "推导")
TYPES = ("组合推理", "事件检索", "组合检索", "人物检索")


def _nth(values: tuple[str, ...], i) -> F.col:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("ord"), F.format_string("c%d-%d", c, t).alias("memory_id"), _nth(CATEGORIES, t % 6).alias("category"), _nth(("简单", "中等", "困难"), t % 3).alias("difficulty"), F.lit(1.0).alias("weight"),
        F.struct(F.when(t % 3 == 0, "").otherwise(F.concat((F.lit(2020) + t).cast("string"), F.lit("-01-01"))).alias("absolute"), F.lit("").alias("relative")).alias("time"),
        F.struct(F.lit("").alias("city"), F.lit("").alias("place")).alias("location"), F.struct(none.alias("name"), F.lit("").alias("identity")).alias("person"), F.struct(F.col("role").alias("type"), F.lit("").alias("action"), none.alias("product")).alias("event"),
        F.lit(None).cast("array<struct<version_id:string,style:string,content:string>>").alias("versions"), F.col("text").alias("content"), F.array(F.col("role")).alias("tags"), F.format_string("k%d", c).alias("cluster_id"),
        F.format_string("h%d", c).alias("reasoning_chain"), (t + 1).cast("int").alias("chain_position"), _nth(RELATIONS, c % 5).alias("chain_relation"), F.struct(_nth(DECAY, t % 4).alias("level")).alias("decay"), F.struct(_nth(DISTANCES, c % 3).alias("semantic_distance")).alias("depth"),
        F.lit(None).cast("map<string,string>").alias("attrs"),
    )


RECORDS = """
records as (
  select conv_id * 1000 + turn as ord, printf('c%d-%d', conv_id, turn) as memory_id, ['存储正确性测试集', '检索功能测试集', '记忆整理测试集', '遗忘功能测试集', '逻辑推理测试集', '长期记忆深度检索测试集'][turn % 6 + 1] as category,
    case when turn % 3 = 0 then '' else (2020 + turn)::varchar || '-01-01' end as absolute, role, text as content, 'k' || conv_id as cluster_id, 'h' || conv_id as reasoning_chain, turn + 1 as chain_position, conv_id, turn,
    ['时序', '因果', '对比', '包含', '推导'][conv_id % 5 + 1] as chain_relation, ['高频记忆', '中等频率', '低频记忆', '偶发事件'][turn % 4 + 1] as decay_level, ['近', '中', '远'][conv_id % 3 + 1] as distance
  from conversations
)"""


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with every field filled: words of the text are names and things, every third conversation has two versions, every fourth chain has gaps."""
    c, t = F.floor(F.col("ord") / 1000), F.col("ord") % 1000
    word = lambda i: F.get(F.regexp_extract_all("content", F.lit("([A-Za-z]+)"), 1), F.lit(i))
    version = lambda i, style, text: F.struct(F.lit(i).alias("version_id"), F.lit(style).alias("style"), text.alias("content"))
    role = F.col("event.type")
    return records(spark, sf_dir).withColumns({
        "weight": F.when(t != 3, t / 4.0), "time": F.col("time").withField("relative", F.concat(t.cast("string"), F.lit("天前"))),
        "location": F.struct(F.coalesce(word(1), F.lit("")).alias("city"), F.coalesce(word(2), F.lit("")).alias("place")), "person": F.struct(F.when(t % 2 == 0, "甲").otherwise(word(0)).alias("name"), role.alias("identity")),
        "event": F.struct(role.alias("type"), F.when(c % 7 == 2, "然后").otherwise(F.coalesce(word(4), F.lit("做"))).alias("action"), word(3).alias("product")),
        "versions": F.when(c % 3 == 0, F.array(version("v1", "标准", F.col("content")), version("v2", "口语", F.substring("content", 1, 25)))), "tags": F.when(t != 1, F.array(role, F.concat(F.lit("x"), (c % 3).cast("string")))),
        "chain_position": F.when(c % 4 == 1, 2 * t + 1).otherwise(t + 1).cast("int"),
    })


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"), F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.col("turn")))), lambda t: t).alias("turns"))
    entity = F.nullif(F.regexp_extract("query_text", "([A-Z][a-z]+)", 1), F.lit(""))
    negative, named = c % 5 == 0, c % 10 == 3
    return grouped.select(
        c.alias("ord"), F.format_string("Q%d", c).alias("query_id"), "query_text", _nth(TYPES, c % 4).alias("query_type"), F.when(negative | named, F.array().cast("array<string>")).otherwise(F.transform("turns", lambda t: F.format_string("c%d-%d", c, t))).alias("expected_memory_ids"),
        negative.alias("is_negative"), F.when(named, entity).alias("target_entity"), F.lit("").alias("expected_answer_text"), F.array().cast("array<string>").alias("acceptable_answers"),
    )


ASKED = """
asked as (
  select conv_id as ord, 'Q' || conv_id as query_id, arg_min(text, turn) as query_text, ['组合推理', '事件检索', '组合检索', '人物检索'][conv_id % 4 + 1] as query_type,
    case when conv_id % 5 = 0 or conv_id % 10 = 3 then [] else list(printf('c%d-%d', conv_id, turn) order by turn) filter (turn > 0) end as ids, conv_id % 5 = 0 as is_negative,
    case when conv_id % 10 = 3 then nullif(regexp_extract(arg_min(text, turn), '[A-Z][a-z]+'), '') end as target
  from conversations group by conv_id
)"""


#: The CTE records with all fields, as ``rich`` has them.
RICH = RECORDS.replace("records as (", "plain as (").rstrip() + """,
words as (select *, regexp_extract_all(content, '[A-Za-z]+') as w from plain),
records as (
  select * exclude (w, chain_position), ['简单', '中等', '困难'][turn % 3 + 1] as difficulty, case when turn <> 3 then turn / 4 end as weight, turn || '天前' as relative, coalesce(w[2], '') as city, coalesce(w[3], '') as place,
    case when turn % 2 = 0 then '甲' else w[1] end as person, case when conv_id % 7 = 2 then '然后' else coalesce(w[5], '做') end as action, w[4] as product,
    case when conv_id % 3 = 0 then [content, left(content, 25)] else [] end as versions, case when turn <> 1 then [role, 'x' || conv_id % 3] else [] end as tags, case when conv_id % 4 = 1 then 2 * turn + 1 else turn + 1 end as chain_position
  from words
)"""
