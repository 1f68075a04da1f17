"""Queries of what stands around models: parsed questions, hits of an outer index, filtered verbs, questions without a model."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import extract as ex
from recollex.operators import prompts as pr
from recollex.operators import search as se
from recollex.plans.catalogue import query
from recollex.plans.roles import ASKED, asked
from recollex.session import table


class FirstWord:
    """Stands for a model: names each question's first word as its product, in a line with the question's number."""

    def batch(self, prompts: list[str]) -> list[str]:
        return ["\n".join(map(self._line, re.findall(r"(?m)^(\d+): (.*)$", p))) for p in prompts]

    @staticmethod
    def _line(found: tuple[str, str]) -> str:
        word = re.search("[A-Za-z]+", found[1])
        return f"{found[0]}: " + (json.dumps({"event_product": word.group()}) if word else "nothing")


@query(f"""with {ASKED} select query_text, '{{"event_product": "' || regexp_extract(query_text, '[A-Za-z]+') || '"}}' as parsed from asked where regexp_matches(query_text, '[A-Za-z]') group by query_text""")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.parse_queries(asked(spark, sf_dir).select("ord", "query_text"), FirstWord())


@query("""
with hits as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_returnflag = 'R' then null else l_linestatus || l_suppkey end as summary, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) as rank from lineitem)
select l_orderkey as probe, rank, coalesce(p.name, summary, '') as memory_id, l_extendedprice as score, 'line ' || l_linenumber as content
from hits left join (select p_partkey * 2 as node, min(p_name) as name from part group by p_partkey) p on l_partkey = p.node where rank <= 3
""")
def node_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as an outer index's hits, which come in places of their own; even part keys are nodes that are known."""
    part = table(spark, sf_dir, "part")
    nodes = part.select((F.col("p_partkey") * 2).alias("node_id"), F.col("p_name").alias("memory_id"), F.col("p_name").alias("ord"))
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("place"), F.col("l_partkey").alias("node_id"), F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") != "R", F.concat("l_linestatus", F.col("l_suppkey").cast("string"))).alias("summary"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit("  [人物:甲]")).alias("content"),
    )
    return se.from_nodes(hits, nodes, 3)


_WORDS = ("之后", "购买", "结果", "参观", "修理")
_DRAWN = "[{0}][(('0x' || substr(md5({1}), 1, 8))::bigint % {2}) + 1]"
_SAFE = _DRAWN.format(", ".join(f"'{w}'" for w in pr.SAFE_VERBS), "event_id::varchar || ':' || i", len(pr.SAFE_VERBS))


@query(f"""
with said as (select event_id, unnest(range(2 + event_id % 3)) as i from events where event_id % 4 <> 1),
named as (select event_id, i, {list(_WORDS)}[(event_id + 2 * i) % {len(_WORDS)} + 1] as word from said)
select e.event_id, string_agg(case when word in {pr.NO_VERBS} then {_SAFE} else word end, '|' order by i) as actions from events e left join named using (event_id) group by e.event_id
""")
def verb_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two to four actions in prose; every fourth has one action too few."""
    e = F.col("event_id")
    said = F.transform(F.sequence(F.lit(0).cast("bigint"), e % 3 + F.when(e % 4 == 1, 0).otherwise(1)), lambda i: F.get(F.array(*map(F.lit, _WORDS)), ((e + 2 * i) % len(_WORDS)).cast("int")))
    answer = F.concat(F.lit("Actions: "), F.to_json(said), F.lit(" as asked."))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(pr.verbs(answer, (e % 3 + 2).cast("int"), e.cast("string")), "|").alias("actions"))


_ONE, _TWO = "'{person} in {city}'", "'{time}: who {action} {product}?'"


@query(f"""
with k as (select event_id, user_id, event_type, unnest(['a', 'b']) as query_type from events),
t as (select *, case when query_type = 'a' then {_DRAWN.format(f"{_ONE}, {_TWO}", "'42:a:' || event_id", 2)} else '{{place}}' end as text from k)
select event_id::varchar as memory_id, query_type, replace(replace(replace(replace(replace(replace(text, '{{person}}', 'u' || user_id), '{{city}}', 'c' || event_id), '{{time}}', ''), '{{action}}', event_type), '{{product}}', 'p'), '{{place}}', '') as query_text from t
""")
def fallback_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    mems = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("memory_id"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("person"),
        F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("city"), nothing.alias("place")).alias("location"), F.struct(F.col("event_type").alias("action"), F.lit("p").alias("product")).alias("event"),
        F.struct(nothing.alias("relative"), nothing.alias("absolute")).alias("time"),
    )
    return pr.fallback_questions(mems, {"a": (_ONE.strip("'"), _TWO.strip("'")), "b": ("{place}",), "none": ()})
