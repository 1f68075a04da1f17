"""Queries of scalar functions, JSON recovery, classification and corpus preparation."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions import json as js
from recollex.functions import text as tx
from recollex.functions import times as ti
from recollex.operators import facts as fa
from recollex.operators import extract as ex
from recollex.plans.catalogue import query
from recollex.plans.roles import ASKED, asked
from recollex.session import table
from recollex.sources import corpus
from recollex.sources.answers import AnswerStore
from recollex.sources.models import Mock

_DAYS = "date_diff('day', ts::date, date '2024-02-01')"
_STEPS = " ".join(f"when days >= {d} then '{w}'" for d, w in ti.FUZZY)
_DESIGNED = " ".join(f"when days <= {d} then '{w}'" for d, w in ti.FUZZY_DESIGNED)


@query(f"""select days, count(*) as n, case when days = 0 then '刚刚' when days = 1 then '昨天' when days < 7 then days || '天前' when days < 30 then floor(days / 7)::int || '周前' when days < 365 then floor(days / 30)::int || '个月前' else floor(days / 365)::int || '年前' end as told,
case {_STEPS} else '以前' end as fuzzy, case when days <= 1 then '刚刚' when days <= 7 then days || '天前' when days <= 30 then floor(days / 7)::int || '周前' when days <= 365 then floor(days / 30)::int || '个月前' else floor(days / 365)::int || '年前' end as told_designed, case {_DESIGNED} else '多年前' end as fuzzy_designed,
case when days > 730 then '困难' when days > 365 then '中等' else '简单' end as difficulty, (case when days > 730 then 1.5 when days > 365 then 1.0 else 0.5 end)::double as weight
from (select {_DAYS} + k * 37 as days from events, (values (0), (1), (10), (25)) as t(k)) group by days""")
def time_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date"))
    d = table(spark, sf_dir, "events").select(F.explode(F.array(*[(days + 37 * k).cast("bigint") for k in (0, 1, 10, 25)])).alias("days")).groupBy("days").agg(F.count("*").alias("n"))
    c = F.col("days")
    return d.select("days", "n", ti.time_desc(c).alias("told"), ti.fuzzy_time(c).alias("fuzzy"), ti.relative_designed(c).alias("told_designed"), ti.fuzzy_designed(c).alias("fuzzy_designed"), ti.difficulty(c).alias("difficulty"), ti.weight(ti.difficulty(c)).alias("weight"))


_D = "regexp_extract(url, '\\d+')"


@query(f"select page_id, case when length({_D}) = 0 then 0 when length({_D}) = 4 then {_D}::bigint * 10000 when length({_D}) = 6 then {_D}::bigint * 100 when length({_D}) in (12, 14) then left({_D}, 8)::bigint else coalesce(try_cast({_D} as bigint), 0) end as sortable from pages")
def sortable_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ti.sortable(F.col("url")).alias("sortable"))


_PHRASES = list(ti.RELATIVE_DAYS)
_OFFSET = "case " + " ".join(f"when contains(x, '{w}') then {d}" for w, d in ti.RELATIVE_DAYS.items()) + " end"


@query(f"select conv_id, turn, {_OFFSET} as days from (select conv_id, turn, text || case when (conv_id + turn) % 3 = 0 then '' else {_PHRASES}[(conv_id * 8 + turn) % {len(_PHRASES)} + 1] || '十' end as x from conversations)")
def relative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), ((c * 8 + t) % len(_PHRASES)).cast("int"))
    said = F.concat("text", F.when((c + t) % 3 == 0, "").otherwise(F.concat(phrase, F.lit("十"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ti.relative_offset(said).alias("days"))


@query("select event_id, (props::json ->> '$.k')::bigint as k from events")
def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props in the shapes in which models return JSON: fenced, in prose, bare."""
    p, i = F.col("props"), F.col("event_id") % 3
    said = F.when(i == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```\nDone."))).when(i == 1, F.concat(F.lit("Here it is: "), p, F.lit(" I hope it helps."))).otherwise(p)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(js.extract_json(said), "$.k", "bigint").alias("k"))


@query("select user_id, count(*) as n, sum((props::json ->> '$.k')::bigint)::bigint as total from events group by user_id")
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's props as one text with an object a line, some with trailing commas, between lines of prose."""
    line = F.concat("props", F.when(F.col("event_id") % 2 == 0, ",").otherwise("  "))
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws("\n", F.lit("Objects:"), F.collect_list(line), F.lit("{broken")).alias("text"))
    each = texts.select("user_id", F.explode(js.json_lines(F.col("text"))).alias("x"))
    return each.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.try_variant_get(F.parse_json("x"), "$.k", "bigint")).alias("total"))


@query("select event_id, (props::json ->> '$.k')::bigint as k from events where event_id % 40 < 15")
def indexed_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers numbered within batches of forty questions, of which the first fifteen were asked."""
    batch, i = F.floor(F.col("event_id") / 40), F.col("event_id") % 40
    texts = table(spark, sf_dir, "events").groupBy(batch.alias("batch")).agg(F.concat_ws("\n", F.collect_list(F.concat(i.cast("string"), F.lit(": "), "props"))).alias("text"))
    each = texts.select("batch", F.explode(js.indexed_lines(F.col("text"), 15)).alias("x"))
    return each.select((F.col("batch") * 40 + F.col("x.index")).alias("event_id"), F.try_variant_get(F.parse_json("x.object"), "$.k", "bigint").alias("k"))


@query("""select o_orderkey, coalesce(n_name, o_orderpriority) as location, case when o_orderstatus = 'F' then 'done' else o_orderstatus end as "time", case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'old,new' when o_orderstatus = 'F' then 'new' when o_orderkey % 2 = 0 then 'old' else '' end as dynasty
from orders left join nation on n_nationkey = left(o_orderpriority, 1)::int""")
def classify_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as places, nations as what they are classified to, states as times."""
    orders, nation = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    facts = orders.select("o_orderkey", F.col("o_orderpriority").alias("location"), F.col("o_orderstatus").alias("time"), F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise("").alias("dynasty"))
    named = facts.select(F.col("location").alias("term")).distinct().withColumn("k", F.substring("term", 1, 1).cast("int"))
    places = named.join(nation, F.col("k") == F.col("n_nationkey")).select("term", F.col("n_name").alias("place"))
    times = spark.createDataFrame([("F", "done", "new")], "term string, time string, dynasty string")
    return fa.classify(facts, places, times).select("o_orderkey", "location", "time", "dynasty")


@query("""select 'location' as field, o_orderpriority as term from orders group by all union all select 'time', o_orderstatus from orders group by all""")
def terms_to_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.terms_to_classify(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("location"), F.col("o_orderstatus").alias("time")))


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.latest(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""with p as (select page_id, regexp_replace(regexp_replace('---' || chr(10) || url || chr(10) || '---' || chr(10) || html, '^---[\\s\\S]*?---', ''), '^\\s+|\\s+$', '', 'g') as t from pages) select page_id, length(left(t, 3000)) as n, md5(left(t, 3000)) as digest from p where length(t) >= 500""")
def corpus_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a head of front matter; the cut at 3,000 characters is what a model is shown."""
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("---\n"), "url", F.lit("\n---\n"), "html").alias("text"))
    return corpus.prepare(files).select("page_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


class Reader:
    """A model that answers from what it is shown: the title of the page and its first words, as a fenced list before prose."""

    def batch(self, prompts: list[str]) -> list[str]:
        return ["```json\n" + json.dumps(self._facts(p[len(ex.PROMPT) :])) + "\n```\nThat is all." for p in prompts]

    @staticmethod
    def _facts(page: str) -> list[dict]:
        title = re.search(r"<title>([^<]*)", page)
        facts = [{"content": page[:40], "chain_position": len(page)}]
        return facts if title is None else [{"content": title[1], "person": title[1][:12]}, *facts]


_READ = """p as (select page_id, url, regexp_replace(regexp_replace(html, '^---[\\s\\S]*?---', ''), '^\\s+|\\s+$', '', 'g') as h from pages), asked as (select page_id, left(h, 3000) as h from p where length(h) >= 500),
told as (select page_id, regexp_extract(h, '<title>([^<]*)', 1) as content, left(regexp_extract(h, '<title>([^<]*)', 1), 12) as person, null::int as chain_position from asked where contains(h, '<title>')
  union all select page_id, left(h, 40), null, length(h)::int from asked)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.lit("pages").alias("folder"), F.col("page_id").cast("string").alias("name"), F.col("html").alias("text"))


@query(f"with {_READ} select 'pages/' || page_id as source, content, person, chain_position from told")
def corpus_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, and a model that tells what stands in each."""
    files, none = _pages(spark, sf_dir), spark.createDataFrame([], f"{ex.FACT}, _source string")
    facts, _, _ = ex.extract(files, files.select("file").limit(0), none, Reader())
    return facts.select(F.col("_source").alias("source"), "content", "person", "chain_position")


@query(f"with {_READ} select 'pages/' || page_id as source, content, person, chain_position from told")
def answers_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a store of answers that a first run has filled; the second has a model that knows nothing."""
    files, none, answers = _pages(spark, sf_dir), spark.createDataFrame([], f"{ex.FACT}, _source string"), AnswerStore(spark, "reader")
    for model in (Reader(), Mock("")):
        facts, _, _ = ex.extract(files, files.select("file").limit(0), none, model, answers=answers)
    return facts.select(F.col("_source").alias("source"), "content", "person", "chain_position")


@query(f"with {ASKED} select query_type, count(*) as n from asked group by query_type")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.type_counts(asked(spark, sf_dir))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def corpus_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, labelled ones as done."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    return corpus.pending(files, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"))).select(F.col("file").alias("doc_id"))


@query("select item_id, floor((row_number() over (order by item_id) - 1) / 3)::bigint as batch from benchmark")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.batches(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "batch")


@query("select doc_id, text as plain, text || ' [人物:' || lang || ' 地点:' || source || ']' as suffixed from documents")
def place_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("suffixed", tx.with_place(F.col("text"), F.col("lang"), F.col("source")))
    return docs.select("doc_id", tx.without_place(F.col("suffixed")).alias("plain"), "suffixed")


@query("select o_orderkey, o_orderstatus || ' of ' || o_custkey || ' at {place}' as text from orders")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.fill("{state} of {who} at {place}", state=F.col("o_orderstatus"), who=F.col("o_custkey")).alias("text"))


_HEAD = "'张伟在' || role || '和李 b 北京大学历史系的档案馆里，见到 of ' || text"
_HAN = "[一-鿿]"


@query(f"""with c as (select conv_id, turn, {_HEAD} as t from conversations),
k as (select *, list_distinct(flatten(list_transform(string_split_regex(translate(t, '，？。', '   '), '\\s+'), lambda x: case when regexp_matches(x, '{_HAN}') then regexp_extract_all(x, '{_HAN}') when length(x) >= 2 then [x] else [] end))) as k,
  list_concat(regexp_extract_all(t, '{_HAN}{{2,6}}'), regexp_extract_all(t, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*')) as e,
  list_concat(list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z]{{4,}}')), lambda w: not list_contains([{", ".join(f"'{w}'" for w in tx.GENERIC_LATIN)}], w)), list_filter(list_distinct(regexp_extract_all(t, '{_HAN}{{2,6}}')), lambda w: not list_contains([{", ".join(f"'{w}'" for w in tx.GENERIC_CJK)}], w))) as w from c)
select conv_id, turn, array_to_string(list_sort(k), '|') as keywords, array_to_string(e, '|') as entities, array_to_string(list_sort(w), '|') as words from k""")
def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a head of Chinese text: keywords, names and words that both scripts give."""
    head = F.concat(F.lit("张伟在"), "role", F.lit("和李 b 北京大学历史系的档案馆里，见到 of "), "text")
    sorted_ = lambda c: F.array_join(F.array_sort(c), "|")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", head.alias("t"))
    return turns.select("conv_id", "turn", sorted_(tx.keywords(F.col("t"))).alias("keywords"), F.array_join(tx.entities(F.col("t")), "|").alias("entities"), sorted_(tx.content_words(F.col("t"))).alias("words"))


@query("select doc_id from documents where regexp_matches(text, '[，,]')")
def compound_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.compound_times(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("time"))).select("doc_id")
