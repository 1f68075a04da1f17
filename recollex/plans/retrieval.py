"""Queries of storage, search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.functions.text import keywords
from recollex.operators import evaluate as ev
from recollex.operators import ranked as ra
from recollex.operators import search as se
from recollex.operators import vectors as ve
from recollex.plans.catalogue import query
from recollex.plans.roles import ASKED, RECORDS, RICH, asked, records, rich
from recollex.session import table
from recollex.sources import database as db
from recollex.sources.models import relevance_prompts

WORDS = "list_distinct(list_filter(string_split_regex(translate({0}, '，？。', '   '), '\\s+'), lambda x: length(x) >= 2))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("memory_id"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("probe"), "text")


_SEARCH = f"""
words as (select item_id, unnest({WORDS.format("text")}) as w, len({WORDS.format("text")}) as n from benchmark),
scored as (select item_id, doc_id, count(*) / any_value(n) as score from words join documents on contains(documents.text, w) group by item_id, doc_id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored qualify rank <= 20)"""


@query(f"with {_SEARCH} select item_id, rank, doc_id, score from ranked")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.keyword_search(_documents(spark, sf_dir), _items(spark, sf_dir))
    return found.select(F.col("probe").cast("long").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("memory_id").cast("long").alias("doc_id"), "score")


@query("""select item_id, cast(len(w) as bigint) as n_words, array_to_string(list_sort(w), ' ') as words from (select item_id, list_distinct(list_filter(string_split_regex(translate(text, '，？。', '   '), '\\s+'), lambda x: length(x) >= 2)) as w from benchmark)""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_sort(keywords(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


_EXPECTED = "expected as (select item_id, doc_id from benchmark join documents on contains(documents.text, benchmark.text))"


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.holding(_documents(spark, sf_dir), _items(spark, sf_dir))


@query(f"with {_EXPECTED} select * from expected")
def expected_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expected(spark, sf_dir).select(F.col("probe").cast("long").alias("item_id"), F.col("memory_id").cast("long").alias("doc_id"))


@query(f"""with {_SEARCH}, {_EXPECTED}, first as (select item_id, min(rank) as r from ranked join expected using (item_id, doc_id) group by item_id)
select avg(case when r is null then 0.0 else 1.0 end)::double as hit_rate, avg(coalesce(1.0 / r, 0.0))::double as mrr, count(*) as probes from benchmark left join first using (item_id)""")
def mrr_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.keyword_search(_documents(spark, sf_dir), _items(spark, sf_dir))
    return se.rank_quality(found, _expected(spark, sf_dir), _items(spark, sf_dir))


_TERMS = "regexp_extract_all(lower({0}), '[^\\s!-/:-@\\[-`{{-~]+')"
_STATS = f"""
d as (select doc_id, t as term, count(*) as tf from (select doc_id, unnest({_TERMS.format("text")}) as t from documents) group by all),
q as (select item_id, t as term, count(*) as tf from (select item_id, unnest({_TERMS.format("text")}) as t from benchmark) group by all),
n as (select count(*) as n from documents)"""


_TFIDF = f"""with {_STATS}, idf as (select term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 as idf from d, n group by term),
w as (select doc_id, term, tf * idf as w from d join idf using (term)), norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
qw as (select item_id, term, tf * idf as w from q join idf using (term)), qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by item_id),
s as (select item_id, doc_id, round(sum(w.w * qw.w) / (any_value(norm.norm) * any_value(qn.norm)), 9) as score from w join qw using (term) join norm using (doc_id) join qn using (item_id) group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, round(score, 6) as score from s qualify rank <= 10"""
_BM25 = f"""with {_STATS}, len as (select doc_id, sum(tf) as len from d group by doc_id), mean as (select sum(len) / any_value(n) as mean from len, n),
idf as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from d, n group by term), a as (select distinct item_id, term from q),
s as (select item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 9) as score from d join a using (term) join idf using (term) join len using (doc_id), mean group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, round(score, 6) as score from s qualify rank <= 10"""


def _entries(found: DataFrame) -> DataFrame:
    return found.select(F.col("probe").cast("long").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("memory_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_TFIDF)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(se.tfidf_search(_documents(spark, sf_dir), _items(spark, sf_dir), 10))


@query(_BM25)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(se.bm25_search(_documents(spark, sf_dir), _items(spark, sf_dir), 10))


@query(_TFIDF)
def tfidf_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index with bounds."""
    return _entries(ra.search(ra.build(_documents(spark, sf_dir), "tfidf"), _items(spark, sf_dir), 10))


@query(_BM25)
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(ra.search(ra.build(_documents(spark, sf_dir), "bm25"), _items(spark, sf_dir), 10))


_COSINE = """with v as (select vec_id, embedding::double[] as e from embeddings), m as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
s as (select q.vec_id as probe, m.vec_id, round(list_sum(list_transform(list_zip(m.e, q.e), lambda p: p[1] * p[2])) / (m.n * q.n), 9) as score from m, m q where q.vec_id % 50 = 0 and m.n > 0 and q.n > 0)
select probe, row_number() over (partition by probe order by score desc, vec_id) as rank, vec_id, round(score, 6) as score from s qualify rank <= 10"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated query set: every fiftieth."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return v, v.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("probe"), "vector")


def _hits(found: DataFrame) -> DataFrame:
    return found.select("probe", F.col("rank").cast("long").alias("rank"), F.col("memory_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_COSINE)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(se.cosine_search(*_vectors(spark, sf_dir), 10))


@query(_COSINE)
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an inverted file, exactly."""
    vectors, queries = _vectors(spark, sf_dir)
    return _hits(ve.exact_search(ve.build(vectors), queries, 10))


@query("""with a as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents), b as (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents),
s as (select source, doc_id, round(sum(1.0 / (60 + r)), 9) as score from (select * from a union all select * from b) group by source, doc_id)
select source, row_number() over (partition by source order by score desc, doc_id::varchar) as rank, doc_id, score from s qualify rank <= 5""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("probe"), F.col("doc_id").cast("string").alias("memory_id"), "n_chars", "doc_id")
    w = W.partitionBy("probe")
    rankings = [docs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))), docs.withColumn("rank", F.row_number().over(w.orderBy("doc_id")))]
    return se.fused(rankings, 5).select(F.col("probe").alias("source"), F.col("rank").cast("long").alias("rank"), F.col("memory_id").cast("long").alias("doc_id"), "score")


@query("""select entity, count(*) as n_docs from (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*')) as entity from documents) group by entity""")
def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.entity_index(_documents(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("n_docs"))


_FOUND = f"""
{RECORDS}, {ASKED},
probes as (
  select 'query' as eval, '' as key, ord, '' as memory_id, query_text as text from asked
  union all select 'cluster', cluster_id, ord, memory_id, left(content, 40) from (select *, count(*) over (partition by cluster_id) as n, row_number() over (partition by cluster_id order by ord) as r from records) where n >= 2 and r <= 3
  union all select 'decay', key, ord, memory_id, content from (select *, row_number() over (partition by key order by ord) as r from (select *, case when decay_level = '高频记忆' then 'high' when decay_level in ('低频记忆', '偶发事件') then 'low' end as key from records) where key is not null) where r <= 20
  union all select 'deep', case distance when '近' then 'near' when '中' then 'mid' else 'far' end, ord, memory_id, content from (select * from records where category = '长期记忆深度检索测试集' order by ord limit 30)
),
pw as (select eval, key, ord, unnest({WORDS.format("text")}) as w, len({WORDS.format("text")}) as n from probes),
ps as (select eval, key, pw.ord, r.memory_id as result, r.ord as place, count(*) / any_value(n) as score from pw join records r on contains(r.content, w) group by all),
found as (select eval, key, ord, result, row_number() over (partition by eval, key, ord order by score desc, place) as rank from ps qualify rank <= 20),
entity as (select distinct memory_id, unnest(regexp_extract_all(content, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*')) as entity from records),
want as (select distinct ord, unnest(ids) as memory_id from asked union all select ord, memory_id from asked join entity on target = entity where len(ids) = 0),
each as (select ord, query_type, (select count(*) from want w where w.ord = a.ord) as e, (select count(*) from want w join found f on f.eval = 'query' and f.ord = w.ord and f.result = w.memory_id where w.ord = a.ord) as c from asked a),
good as (select * from each where e > 0),
mates as (select cluster_id as key, memory_id as result from records),
clus as (select count(*) as n, count(h) as c from (select p.key, p.ord, (select 1 from found f join mates m on f.key = m.key and f.result = m.result where f.eval = 'cluster' and f.key = p.key and f.ord = p.ord and f.rank <= 10 and f.result <> p.memory_id limit 1) as h from probes p where eval = 'cluster')),
selfs as (select p.eval, p.key, count(*) as n, count(h) as c from (select p.*, (select 1 from found f where f.eval = p.eval and f.key = p.key and f.ord = p.ord and f.rank <= 10 and f.result = p.memory_id limit 1) as h from probes p where eval in ('decay', 'deep')) p group by all),
share as (select eval, key, c / n as v from selfs),
reason as (select k, count(*) as n, count(h) as c from (select case when query_type = '组合推理' then 'chain' when query_type in ('事件检索', '组合检索') then 'logic' end as k, (select 1 from found f where f.eval = 'query' and f.ord = a.ord and list_contains(a.ids, f.result) limit 1) as h from asked a) where k is not null group by k),
report as (
  select 'storage' as dimension, 'stored_count' as metric, '' as key, (select count(*) from records)::double as value union all select 'storage', 'total', '', (select count(*) from records)::double union all select 'storage', 'integrity', '', 1.0::double
  union all select 'retrieval', 'precision', query_type, sum(c) / (count(*) * 20) from good group by query_type union all select 'retrieval', 'recall', query_type, sum(c) / sum(e) from good group by query_type union all select 'retrieval', 'count', query_type, count(*)::double from good group by query_type
  union all select 'retrieval', 'overall_precision', '', (select sum(c) from good) / ((select count(*) from asked) * 20) union all select 'retrieval', 'overall_recall', '', (select sum(c) / sum(e) from good)
  union all select 'organization', 'cluster_accuracy', '', c / n from clus union all select 'organization', 'clusters_tested', '', (select count(distinct cluster_id) from records)::double
  union all select 'forgetting', 'high_freq_retention', '', (select v from share where key = 'high') union all select 'forgetting', 'low_freq_retention', '', (select v from share where key = 'low')
  union all select 'forgetting', 'forgetting_ratio_valid', '', case when round((select v from share where key = 'high'), 3) > round((select v from share where key = 'low'), 3) then 1.0 else 0.0 end::double
  union all select 'reasoning', k || '_accuracy', '', coalesce((select c / n from reason r where r.k = t.k), 0.0) from (values ('logic'), ('chain')) as t(k)
  union all select 'deep_retrieval', k, '', coalesce((select v from share where eval = 'deep' and key = t.k), 0.0) from (values ('near'), ('mid'), ('far')) as t(k)
)"""


@query(f"with {_FOUND} select dimension, metric, key, value from report")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evaluate(records(spark, sf_dir), asked(spark, sf_dir))


@query(f"with {_FOUND} select metric, key, value from report where dimension = 'retrieval'")
def retrieval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    mems, questions = records(spark, sf_dir), asked(spark, sf_dir)
    stored = db.store(db.entries(mems))
    ranked = se.keyword_ranks(stored, questions.select(F.col("ord").alias("probe"), F.col("query_text").alias("text"))).select(F.col("probe").alias("ord"), "rank", "memory_id")
    return ev.retrieval(questions, ev.expected_ids(questions, stored), ranked).select("metric", "key", "value")


@query(f"""with {RICH} select memory_id, category, difficulty, coalesce(weight, 1.0)::double as weight, absolute as time_absolute, relative as time_relative, city as location_city, place as location_place, coalesce(person, '') as person_name, role as person_identity,
role as event_type, action as event_action, coalesce(product, '') as event_product, array_to_string(tags, '|') as tags, cluster_id, reasoning_chain, chain_position::bigint as chain_position, decay_level from records""")
def flat_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.flat_meta(rich(spark, sf_dir)).withColumns({"tags": F.array_join("tags", "|"), "chain_position": F.col("chain_position").cast("long")})


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("string").alias("version_id"), F.col("l_linestatus").alias("style"), F.col("l_returnflag").alias("content")).alias("v"), "l_linenumber")
    versions = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "v"))), lambda x: x["v"]).alias("versions"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("memory_id"), F.col("o_orderstatus").alias("content"))
    return orders.join(versions, F.col("ord") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("""with s as (select sum(greatest(n, 1)) as stored, count(*) as total from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey))
select m as metric, v as value from (select unnest(['stored_count', 'total', 'integrity']) as m, unnest([stored::double, total::double, stored / total]) as v from s)""")
def version_fanout_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.storage(_orders(spark, sf_dir)).select("metric", "value")


@query("""with l as (select l_orderkey, l_returnflag, (l_linenumber, l_linestatus, l_returnflag) as n from lineitem), e as (select o_orderkey, coalesce(l_returnflag, o_orderstatus) as content, coalesce(n, (1, '', '')) as n from orders left join l on o_orderkey = l_orderkey)
select o_orderkey, arg_max(content, n) as content from e group by o_orderkey""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.store(db.entries(_orders(spark, sf_dir))).select(F.col("memory_id").cast("long").alias("o_orderkey"), "content")


@query("select user_id, arg_max(event_type, (ts, event_id)) as content, min(event_id) filter (ts = first) as first_id from (select *, min(ts) over (partition by user_id) as first from events) group by user_id")
def store_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("memory_id"), F.col("event_type").alias("content"), F.struct("ts", "event_id").alias("seq"))
    return db.store(entries).select(F.col("memory_id").cast("long").alias("user_id"), "content", F.col("ord.event_id").alias("first_id"))


@query(f"""with {RECORDS}, {ASKED}, ranked as (select a.ord, a.query_id, r.content, row_number() over (partition by a.ord order by r.ord) as rank from asked a join records r on r.conv_id = a.ord)
select query_id, 'Query: ' || any_value(query_text) || chr(10) || chr(10) || 'Results:' || chr(10) || string_agg(rank || '. ' || left(content, 200), chr(10) order by rank) || chr(10) || chr(10) || 'Give for each result a number from 0 (irrelevant) to 3 (answers the query).' as prompt
from ranked join (select ord, query_text from asked order by md5('42:' || query_id) limit 50) using (ord) where rank <= 10 group by query_id""")
def relevance_prompt_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    mems, questions = records(spark, sf_dir), asked(spark, sf_dir)
    w = W.partitionBy("cluster_id").orderBy("ord")
    ranked = mems.select(F.concat(F.lit("Q"), F.substring("cluster_id", 2, 20)).alias("query_id"), "content", F.row_number().over(w).alias("rank"))
    return relevance_prompts(ranked, questions)
