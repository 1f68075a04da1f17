"""Queries of joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import timelines as ti
from recollex.plans.catalogue import query
from recollex.session import table

_MONTH = 30 * 86_400


@query("""with lines as (select l_orderkey, l_linenumber, l_shipdate, o_custkey from lineitem join orders on l_orderkey = o_orderkey),
versions as (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by all)
select l_orderkey, l_linenumber, v.o_orderkey as last_order, v.o_orderstatus as last_status from lines l asof left join versions v on l.o_custkey = v.o_custkey and l.l_shipdate >= v.o_orderdate""")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order that its customer had placed when a line was shipped."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    facts = lines.withColumnRenamed("l_shipdate", "time")
    found = ti.as_of(facts, orders.withColumnRenamed("o_orderdate", "time"), "o_custkey", "time", "o_orderkey", _MONTH)
    return found.select("l_orderkey", "l_linenumber", F.col("as_of_o_orderkey").alias("last_order"), F.col("as_of_o_orderstatus").alias("last_status"))


@query("""with v as (select user_id, ts, event_id, value from events where event_type = 'signup'), f as (select event_id, user_id, ts from events where event_type = 'purchase')
select f.event_id, case when f.ts - v.ts <= interval 2 day then v.event_id end as signup_id, case when f.ts - v.ts <= interval 2 day then v.value end as value from f asof left join v on f.user_id = v.user_id and f.ts >= v.ts""")
def recent_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase beside the last sign-up of its user, if that is not older than two days."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    facts, versions = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.filter("event_type = 'signup'").drop("event_type")
    found = ti.as_of(facts, versions, "user_id", "ts", "event_id", 86_400, within=2 * 86_400)
    return found.select("event_id", F.col("as_of_event_id").alias("signup_id"), F.col("as_of_value").alias("value"))


_OPEN = "select o_orderkey, o_custkey, o_orderdate as opened, max(l_shipdate) as closed from orders join lineitem on o_orderkey = l_orderkey group by all"


@query(f"with o as ({_OPEN}) select a.o_orderkey as first, b.o_orderkey as second from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.opened < b.closed and b.opened < a.closed and a.opened < a.closed and b.opened < b.closed")
def concurrent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer that were open, from their date to the last shipping, at the same time."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened"))
    each = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").filter("opened < closed")
    met = ti.overlapping(each, each, "o_custkey", "opened", "closed", _MONTH)
    return met.filter("o_orderkey < other_o_orderkey").select(F.col("o_orderkey").alias("first"), F.col("other_o_orderkey").alias("second"))


@query("""with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, min(ts) as start, max(ts) as finish from (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as id from g) group by user_id, id),
q as (select event_id, user_id, ts as start, ts + interval 1 hour as finish from events where event_type = 'view')
select event_id, count(*) as sessions, min(s.start) as first from q join s on q.user_id = s.user_id and s.start < q.finish and q.start <= s.finish and (s.finish > q.start or s.start >= q.start) group by event_id""")
def sessions_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user (apart by six hours) that overlap the hour after a view; a session of one event is a moment."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    spans = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("finish"))
    hours = events.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 hour")).alias("finish"))
    met = ti.overlapping(hours, spans.select("user_id", "start", "finish"), "user_id", "start", "finish", 6 * 3600)
    return met.groupBy("event_id").agg(F.count("*").alias("sessions"), F.min("other_start").alias("first"))
