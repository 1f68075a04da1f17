"""Queries of chains, links, checks and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.times import RELATIVE_DAYS
from recollex.operators import chains as ch
from recollex.operators import clean as cl
from recollex.operators import facts as fa
from recollex.operators import quality as qc
from recollex.operators import questions as qu
from recollex.plans.catalogue import query
from recollex.plans.roles import ASKED, RECORDS, RICH, asked, records, rich
from recollex.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("memory_id"), F.col("user_id").cast("string").alias("person"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "event_type")


_TEMPORAL = """
e as (select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time from events),
p as (select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by time, event_id) as pos, min(event_id) over (partition by user_id) as first from e),
k as (select * from p where n >= 3 and pos <= 6), ids as (select user_id, printf('CHAIN_temporal_%04d', row_number() over (order by first)) as chain from (select distinct user_id, first from k))"""


@query(f"with {_TEMPORAL} select event_id, user_id::varchar as person, chain, pos, least(n, 6) as total, coalesce(lag(event_id) over w::varchar, '') as chain_prev, coalesce(lead(event_id) over w::varchar, '') as chain_next from k join ids using (user_id) window w as (partition by chain order by pos)")
def temporal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ch.temporal_chains(_events(spark, sf_dir))
    return out.select(F.col("ord").alias("event_id"), "person", "chain", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"), "chain_prev", "chain_next")


_OFFSET = "case " + " ".join(f"when contains({{0}}, '{w}') then {d}" for w, d in RELATIVE_DAYS.items()) + " end"
_PHRASES = ("次日", "三天后", "许久之后", "半年后", "", "十一个月后", "随后", "后来")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with chain ids for two conversations of three, persons for the others, and times of either kind."""
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), t.cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("ord"), F.format_string("c%d-%d", c, t).alias("memory_id"), F.when(c % 3 != 0, F.format_string("h%d", c)).otherwise("").alias("chain_id"), F.when(c % 6 == 0, "未知").otherwise(F.format_string("p%d", F.floor(c / 6))).alias("person"),
        F.when(c % 4 == 0, "").when(c % 4 == 1, F.concat((F.lit(2030) - t).cast("string"), F.lit("-05-01"))).when(c % 4 == 2, F.concat(F.lit("第"), (F.lit(383) - t).cast("string"), F.lit("年"))).otherwise("").alias("time"), F.concat(F.col("text"), phrase).alias("text"),
    )


_SORT = """case when length(d) = 0 then 0 when length(d) = 4 then d::bigint * 10000 when length(d) = 6 then d::bigint * 100 when length(d) in (12, 14) then left(d, 8)::bigint else coalesce(try_cast(d as bigint), 0) end"""
_DATED = f"""
dated as (select *, regexp_extract(time, '\\d+') as d from (select conv_id * 1000 + turn as ord, printf('c%d-%d', conv_id, turn) as memory_id, case when conv_id % 3 <> 0 then 'h' || conv_id else '' end as chain_id, case when conv_id % 6 = 0 then '未知' else 'p' || (conv_id // 6) end as person,
  case conv_id % 4 when 1 then (2030 - turn)::varchar || '-05-01' when 2 then '第' || (383 - turn) || '年' else '' end as time, text || {list(_PHRASES)}[turn + 1] as text from conversations)),
timed as (select *, {_SORT} as a, {_OFFSET.format("text")} as r from dated),
keyed as (select *, case when chain_id <> '' then 0 when person <> '未知' then 1 end as kind, case when chain_id <> '' then chain_id when person <> '未知' then person end as key from timed),
sized as (select *, count(*) over g as n, min(ord) over g as first, sum((a > 0)::int) over g as na, count(r) over g as nr from keyed where kind is not null window g as (partition by kind, key)),
chained as (select *, case when na >= 2 then a when nr >= 2 then coalesce(r, 0) else 0 end as s from sized where (kind = 0 and n >= 2) or (kind = 1 and n >= 3)),
ids as (select kind, key, printf('CHAIN_%05d', row_number() over (order by kind, first)) as chain from (select distinct kind, key, first from chained)),
placed as (select * from (select *, row_number() over (partition by kind, key order by s, ord) as pos from chained) where pos <= 6),
told as (select ord, memory_id, chain, pos, least(n, 6) as total, case when bool_or(time <> '') over (partition by kind, key) then '时序' when kind = 0 then '因果' else '关联' end as relation from placed join ids using (kind, key)),
links as (select *, coalesce(lag(memory_id) over w, '') as chain_prev, coalesce(lead(memory_id) over w, '') as chain_next from told window w as (partition by chain order by pos))"""


@query(f"with {_DATED} select d.memory_id, chain, pos, total, relation, chain_prev, chain_next from dated d left join links using (ord)")
def mixed_time_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ch.build_chains(_dated(spark, sf_dir))
    return out.select("memory_id", "chain", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"), "relation", "chain_prev", "chain_next")


@query(f"""with {_DATED} select d.memory_id, d.text as v1, d.time || ' ' || person || '在' || '' || '事件' || '：' || d.text as v2, coalesce(chain, '') as reasoning_chain, coalesce(pos, 0) as chain_position, person as name from dated d left join links using (ord)""")
def facts_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir)
    f = d.select("ord", F.col("text").alias("content"), "person", F.lit("").alias("location"), "time", F.lit(None).cast("string").alias("dynasty"), F.lit(None).cast("string").alias("event_type"), "chain_id")
    out = fa.to_memories(f).join(d.select("ord", F.col("memory_id").alias("turn_id")), "ord")
    return out.select(F.col("turn_id").alias("memory_id"), F.get("versions", F.lit(0))["content"].alias("v1"), F.get("versions", F.lit(1))["content"].alias("v2"), "reasoning_chain", F.col("chain_position").cast("long").alias("chain_position"), F.col("person.name").alias("name"))


@query("""select 'h' || conv_id as chain, count(*) as n, string_agg(printf('c%d-%d', conv_id, turn), ',' order by turn) as members, string_agg(left(text, 40), ' → ' order by turn) as summary from conversations group by conv_id""")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ch.summaries(records(spark, sf_dir).withColumn("short", F.substring("content", 1, 40)), "reasoning_chain", "chain_position", "short")
    return out.select(F.col("reasoning_chain").alias("chain"), "n", F.array_join("members", ",").alias("members"), "summary")


#: Places of all turns; every third conversation has a hole before its third turn, every seventh lacks a first place.
_PLACE = "turn + 1 + case when conv_id % 3 = 0 and turn >= 2 then 1 else 0 end + case when conv_id % 7 = 0 then 2 else 0 end"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.format_string("h%d", "conv_id").alias("chain"), F.expr(_PLACE).alias("pos"))


@query(f"select 'h' || conv_id as chain, count(*) as n, min(pos) = 1 and max(pos) = count(*) and count(distinct pos) = count(*) as contiguous from (select conv_id, {_PLACE} as pos from conversations) group by conv_id")
def chain_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.contiguity(_holed(spark, sf_dir), "chain", "pos")


@query(f"select 'h' || conv_id as chain, count(*) as gaps from (select conv_id, pos - lag(pos) over (partition by conv_id order by pos) as step from (select conv_id, {_PLACE} as pos from conversations)) where step > 1 group by conv_id")
def chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.gaps(_holed(spark, sf_dir), "chain", "pos")


@query("""with t as (select event_id, user_id, event_type, lead(event_id, 1) over u as u1, lead(event_id, 2) over u as u2, lead(event_id, 3) over u as u3, lead(event_id, 4) over u as u4, lead(event_id, 1) over k as k1, lead(event_id, 2) over k as k2, lead(event_id, 3) over k as k3, lead(event_id, 4) over k as k4
  from events window u as (partition by user_id order by event_id), k as (partition by event_type order by event_id))
select event_id::varchar as src, dst::varchar as dst, kind, 0.3::double as strength from (select event_id, unnest([u1, u2, u3, u4]) as dst, 'person' as kind from t union all select event_id, unnest([k1, k2, k3, k4]), 'event_type' from t) where dst is not null""")
def cooccurrence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.neighbour_links(_events(spark, sf_dir), ["person", "event_type"])


@query("""select source as query_id, doc_id::varchar as memory_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions about themselves, labels as the records there are."""
    questions = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.array(F.col("doc_id").cast("string")).alias("expected_memory_ids"))
    return qc.dangling(questions, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("memory_id")))


@query(f"""with {ASKED}, v as (select ord, query_id, list_filter(ids, lambda x: split_part(x, '-', 2)::int % 3 <> 0) as ids from asked)
select query_id, len(ids)::bigint as n, array_to_string(ids, ',') as ids from v where len(ids) > 0""")
def valid_id_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every third turn is asked for by an id that no record has
    lost = F.transform("expected_memory_ids", lambda x: F.when(F.split_part(x, F.lit("-"), F.lit(2)).cast("int") % 3 == 0, F.concat(F.lit("gone-"), x)).otherwise(x))
    out = cl.prune_ids(asked(spark, sf_dir).withColumn("expected_memory_ids", lost), records(spark, sf_dir))
    return out.select("query_id", F.size("expected_memory_ids").cast("long").alias("n"), F.array_join("expected_memory_ids", ",").alias("ids"))


@query("""with q as (select o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) select o_orderkey from q where r <= 10""")
def questions_per_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("query_type"))
    return cl.cap_questions(q).select(F.col("ord").alias("o_orderkey"))


@query("""with t as (select *, count(*) over (partition by o_custkey) as n from orders), k as (select o_custkey, count(distinct o_orderpriority) as kinds from orders group by o_custkey),
i as (select t.*, kinds, row_number() over (partition by t.o_custkey, o_orderpriority order by o_orderkey) as r from t join k using (o_custkey)), e as (select * from i where n <= 8 or r <= greatest(8 // kinds, 1)),
z as (select *, row_number() over (partition by o_custkey order by md5('42:' || o_orderkey), o_orderkey) as turn from e) select o_orderkey from z where n <= 8 or turn <= 8""")
def questions_per_person_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("query_type"))
    return cl.cap_questions(q, 8, varied=True).select(F.col("ord").alias("o_orderkey"))


_RATIOS = ", ".join(f"('{d}', {r})" for d, r in qu.RATIOS.items())
_DIMENSIONS = f"""
tagged as (select memory_id, ord, list_filter([case chain_relation {" ".join(f"when '{k}' then '{v}'" for k, v in qu.BY_RELATION.items())} end, '聚类检索', case category {" ".join(f"when '{k}' then '{v}'" for k, v in qu.BY_CATEGORY.items())} end], lambda x: x is not null) as dims from records)"""


@query(f"with {RECORDS}, {_DIMENSIONS} select dimension, count(*) as n from (select unnest(dims) as dimension from tagged) group by dimension")
def dimension_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir)
    return m.select(F.explode(qu.dimensions(m)).alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))


@query(f"""with {RECORDS}, {_DIMENSIONS}, each as (select memory_id, unnest(dims) as dimension from tagged), quota as (select d as dimension, greatest(1, floor(200 * r::double))::int as quota from (values {_RATIOS}) as t(d, r)),
ranked as (select *, row_number() over (partition by dimension order by md5('42:' || dimension || ':' || memory_id), memory_id) as turn from each join quota using (dimension)) select dimension, memory_id, turn from ranked where turn <= quota""")
def dimension_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.allocate(records(spark, sf_dir), 200).select("dimension", "memory_id", F.col("turn").cast("long").alias("turn"))


_CHECKS = f"""
{RICH}, {ASKED}, told as (select unnest(versions) as v from records),
dang as (select unnest(ids) as id from asked), m as (select count(*) filter (is_negative) as neg, count(*) filter (is_negative and len(ids) > 0) as bn, count(*) filter (not is_negative and len(ids) = 0) as bp, count(*) as n from asked),
cat as (select category, count(*) as n from records group by category), c as (select count(*) as kinds, min(n) as low, max(n) as high from cat),
chain as (select reasoning_chain, count(*) as n, min(chain_position) = 1 and max(chain_position) = count(*) and count(distinct chain_position) = count(*) as ok from records group by all), clu as (select cluster_id, count(*) as n from records group by all)
select 'memory_ids' as "check", case when count(*) > count(distinct memory_id) then 'ERROR' else 'PASS' end as status, '' as subject, count(*) - count(distinct memory_id) as n, (count(*) - count(distinct memory_id))::double as value from records
union all select 'query_ids', case when count(*) > count(distinct query_id) then 'ERROR' else 'PASS' end, '', count(*) - count(distinct query_id), (count(*) - count(distinct query_id))::double from asked
union all select 'references', case when count(*) > 0 then 'ERROR' else 'PASS' end, '', count(*), count(*)::double from dang where id not in (select memory_id from records)
union all select 'negatives_empty', case when bn > 0 then 'ERROR' else 'PASS' end, '', bn, bn::double from m union all select 'positives_filled', case when bp > 0 then 'ERROR' else 'PASS' end, '', bp, bp::double from m
union all select 'negative_share', case when neg / n between 0.15 and 0.25 then 'PASS' else 'WARN' end, '', neg, neg / n from m
union all select 'categories', case when kinds < 6 then 'WARN' else 'PASS' end, '', kinds, kinds::double from c union all select 'category_balance', case when low > 0 and high > 2 * low then 'WARN' else 'PASS' end, '', high, high / low from c
union all select 'chains', case when count(*) = 0 then 'WARN' else 'PASS' end, '', count(*), count(*)::double from chain union all select 'chain_positions', 'WARN', reasoning_chain, n, n::double from chain where not ok
union all select 'clusters', case when count(*) = 0 then 'WARN' else 'PASS' end, '', count(*), count(*)::double from clu union all select 'cluster_size', 'WARN', cluster_id, n, n::double from clu where n < 3
union all select 'version_length', case when avg(length(v)) between 20 and 120 then 'PASS' else 'WARN' end, '', count(*), avg(length(v)) from told having count(*) > 0
union all select k, case when n < 10 then 'WARN' else 'PASS' end, '', n, n::double from (select unnest(['cities', 'names', 'products']) as k, unnest([count(distinct city), count(distinct person), count(distinct product)]) as n from records)
union all select 'query_texts', case when count(*) > count(distinct query_text) then 'WARN' else 'PASS' end, '', count(*) - count(distinct query_text), (count(*) - count(distinct query_text))::double from asked"""


@query(f"with {_CHECKS}")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.check(rich(spark, sf_dir), asked(spark, sf_dir))


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the flaws that the detailed rules look for, one kind for each remainder of the conversation."""
    q, c = asked(spark, sf_dir), F.col("ord")
    kinds = F.get(F.array(*map(F.lit, (*qc.CHAIN_TYPES, "聚类检索", "人物检索", "地点检索", "跨版本"))), (c % 9).cast("int"))
    text = F.concat(F.when(c % 7 == 0, "在火星随后了 location ").when(c % 7 == 1, "甲做了什么 ").when(c % 7 == 2, "在乙发生过 后续事件 ").when(c % 7 == 3, "从丙出发 ").otherwise(""), F.when(c % 11 == 0, "同一个").otherwise(F.col("query_text")))
    ids = F.when(c % 4 == 0, F.slice("expected_memory_ids", 1, 1)).when(c % 4 == 1, F.concat("expected_memory_ids", F.array(F.lit("c0-0")))).otherwise(F.col("expected_memory_ids"))
    return q.withColumns({"query_type": kinds, "query_text": text, "expected_memory_ids": F.when(c % 10 == 0, F.array(F.lit("c0-1"))).otherwise(ids), "expected_answer_text": F.lit("甲")})


_FLAWED = f"""
{RICH}, {ASKED},
fq as (select query_id, ord as c, is_negative, {[*qc.CHAIN_TYPES, "聚类检索", "人物检索", "地点检索", "跨版本"]}[ord % 9 + 1] as t,
  case ord % 7 when 0 then '在火星随后了 location ' when 1 then '甲做了什么 ' when 2 then '在乙发生过 后续事件 ' when 3 then '从丙出发 ' else '' end || case when ord % 11 = 0 then '同一个' else query_text end as x,
  case when ord % 10 = 0 then ['c0-1'] when ord % 4 = 0 then ids[1:1] when ord % 4 = 1 then list_append(ids, 'c0-0') else ids end as ids from asked),
ex as (select query_id, t, x, unnest(ids) as id, generate_subscripts(ids, 1) as p from fq), el as (select query_id, t, x, p, reasoning_chain as chain, cluster_id as cluster, action, person, person || '在' || city || action || '了' || product as told from ex join records on id = memory_id),
verbs as (select query_id, arg_min(action, p) as action from el where t like '%推理链' group by query_id), steps as (select reasoning_chain, chain_position - lag(chain_position) over (partition by reasoning_chain order by chain_position) as step from records where chain_relation = '时序'),
is_chain as (select query_id from fq where t like '%推理链'),
issues as (
  select 'repeated_text' as rule, '🔴' as status, x as subject, count(*)::varchar as detail from fq group by x having count(*) > 1
  union all select 'negative_with_ids', '🔴', query_id, array_to_string(ids, ',') from fq where is_negative and len(ids) > 0
  union all select 'chain_too_short', '🔴', query_id, len(ids)::varchar from fq where t like '%推理链' and len(ids) < 2
  union all select 'several_chains', '🔴', query_id, count(distinct chain)::varchar from el where t like '%推理链' and query_id in (select query_id from fq where len(ids) >= 2) group by query_id having count(distinct chain) > 1
  union all select 'chain_start', '🟡', query_id, x from fq where t like '%推理链' and regexp_matches(x, '后续事件|导致了哪些事件') and not regexp_matches(x, '在\\S+了\\S+')
  union all select 'chain_first_verb', '🔴', query_id, action from verbs where action in ('之后', '然后', '接着', '随后')
  union all select 'chain_gap', '🟡', reasoning_chain, count(*)::varchar from steps where step > 1 group by reasoning_chain
  union all select 'answer_member', '🟡', query_id, person from el where t like '%推理链' and not contains('甲', person)
  union all select 'premise', '🟡', query_id, w from (select *, trim(regexp_extract(x, '从(.+?)出发', 1)) as w from el where t = '推导推理链' and p = 1) where w <> '' and w <> told
  union all select 'cluster_too_small', '🟡', query_id, len(ids)::varchar from fq where t = '聚类检索' and len(ids) < 2
  union all select 'several_clusters', '🔴', query_id, count(distinct cluster)::varchar from el where t = '聚类检索' and query_id in (select query_id from fq where len(ids) >= 2) group by query_id having count(distinct cluster) > 1
  union all select 'answer_person', '🟡', query_id, p from (select *, regexp_extract(x, '^(.+?)做了什么', 1) as p from fq) where t = '人物检索' and p <> '' and not contains('甲', p)
  union all select 'answer_place', '🟡', query_id, p from (select *, regexp_extract(x, '在(\\S+)发生过', 1) as p from fq) where t = '地点检索' and p <> '' and not contains('甲', p)
  union all select 'answer_versions', '🟡', query_id, '0' from fq where t = '跨版本'
  union all select 'grammar', '🔴', query_id, w from fq, (select unnest(['之后了', '然后了', '接着了', '随后了']) as w) where contains(x, w)
  union all select 'leaked_name', '🔴', query_id, w from fq, (select unnest(['event_type', 'memory_id', 'chain_id', 'cluster_id', 'location']) as w) where contains(x, w)
  union all select 'negative_person', '🟡', h, count(*)::varchar from (select regexp_extract(x, '^(\\S+)', 1) as h from fq where is_negative) where h <> '' group by h having count(*) > 3
  union all select 'negative_kinds', '🟡', '*', count(distinct k)::varchar from (select case when contains(x, '在火星') or contains(x, '在木星') then 'a' when regexp_matches(x, '游泳|打篮球|滑雪|唱歌|画画') then 'b' when contains(x, '购买了') then 'c' when contains(x, '最近做了什么') then 'd' else 'e' end as k from fq where is_negative) having count(distinct k) < 3
)"""


@query(f"with {_FLAWED} select rule, status, subject, detail from issues")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.detailed(rich(spark, sf_dir), _flawed(spark, sf_dir))


@query(f"with {_FLAWED} select status, count(*) as n from issues group by status")
def issue_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.severity(qc.detailed(rich(spark, sf_dir), _flawed(spark, sf_dir)))
