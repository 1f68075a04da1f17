"""Facts that a model drew from texts: field classification, and facts to records with chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.operators.chains import UNKNOWN, build_chains

FIRST_ID = 10000
KNOWN = "ord content person location time dynasty event_type chain_id chain_position chain_relation _source".split()


def _first_part(c: Column) -> Column:
    return F.get(F.split(c, ","), F.lit(0))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def terms_to_classify(facts: DataFrame) -> DataFrame:
    """(field, term): distinct places and times that are worth asking about."""
    places = facts.select(F.lit("location").alias("field"), F.col("location").alias("term"))
    times = facts.select(F.lit("time").alias("field"), F.col("time").alias("term"))
    return places.union(times).filter(F.coalesce("term", F.lit("")) != "").filter(F.col("term") != UNKNOWN).distinct()


def compound_times(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("time").rlike("[，,]"))


def latest(answers: DataFrame, key: str, value: str, batch: str) -> DataFrame:
    """The value of the last batch that answered each key."""
    return answers.groupBy(key).agg(F.max_by(value, batch).alias(value))


def classify(facts: DataFrame, places: DataFrame, times: DataFrame) -> DataFrame:
    """Facts with location replaced from places(term, place) and time, dynasty from times(term, time, dynasty); what has no answer stays.

    A second dynasty is added to the first with a comma; stray commas at the ends go.
    """
    both = facts.join(places.select(F.col("term").alias("_p"), "place"), F.col("location") == F.col("_p"), "left").join(times.select(F.col("term").alias("_t"), F.col("time").alias("_time"), F.col("dynasty").alias("_d")), facts["time"] == F.col("_t"), "left")
    joined = F.regexp_replace(F.concat_ws(",", F.nullif("dynasty", F.lit("")), F.nullif("_d", F.lit(""))), "^,+|,+$", "")
    return both.withColumns({"location": F.coalesce("place", "location"), "time": F.coalesce("_time", facts["time"]), "dynasty": joined}).drop("_p", "place", "_t", "_time", "_d")


def to_memories(facts: DataFrame) -> DataFrame:
    """Records of the facts in their order: three tellings each, chained by the model's chain ids, else by person."""
    f = facts.select("ord", *[_text(c).alias(c) for c in ("content", "person", "location", "time", "dynasty", "chain_id")], F.coalesce("event_type", F.lit("事件")).alias("event_type"))
    person = F.when(F.col("person") == "", UNKNOWN).otherwise(F.col("person"))
    f = f.withColumns({"who": person, "memory_id": F.format_string("MEM%06d", F.col("ord") + FIRST_ID)})
    era = F.when(F.col("dynasty") != "", F.concat(F.lit("("), "dynasty", F.lit(")"))).otherwise("")
    say = lambda *p: F.concat(*[F.lit(x) if not isinstance(x, Column) else x for x in p])
    tellings = [("v1", "标准叙述", F.col("content")), ("v2", "详细描述", say(F.col("time"), era, " ", F.col("who"), "在", F.col("location"), F.col("event_type"), "：", F.col("content"))), ("v3", "口语化", say("据记载，", F.col("who"), "：", F.col("time"), "，", F.col("content")))]
    chains = build_chains(f.select("ord", "memory_id", "chain_id", _first_part(F.col("who")).alias("person"), "time", F.col("content").alias("text"))).select("ord", "chain", "pos", "total", "relation", "chain_prev", "chain_next")
    return f.join(chains, "ord").select(
        "ord", "memory_id", F.lit("knowledge").alias("category"), F.lit("中等").alias("difficulty"), F.lit(0.7).alias("weight"),
        F.struct(F.col("time").alias("absolute"), F.lit("").alias("relative"), F.lit("").alias("fuzzy"), F.lit(None).cast("bigint").alias("timestamp"), F.col("dynasty").alias("era")).alias("time"),
        F.struct(_first_part(F.col("location")).alias("city"), F.lit("").alias("place"), F.lit("").alias("landmark")).alias("location"),
        F.struct(_first_part(F.col("who")).alias("name"), F.lit("").alias("identity"), F.lit("").alias("partner_name"), F.lit("").alias("partner_identity"), F.lit("").alias("relation")).alias("person"),
        F.struct(F.lit("event").alias("type"), F.substring("content", 1, 20).alias("action"), F.substring("event_type", 1, 30).alias("product"), F.lit(None).cast("bigint").alias("quantity"), F.lit(None).cast("bigint").alias("price")).alias("event"),
        F.array(*[F.struct(F.lit(i).alias("version_id"), F.lit(s).alias("style"), t.alias("content")) for i, s, t in tellings]).alias("versions"), F.lit(None).cast("string").alias("content"),
        F.when(F.col("event_type") != "", F.array(F.lit("knowledge"), F.col("event_type"))).otherwise(F.array(F.lit("knowledge"))).alias("tags"), F.lit(None).cast("string").alias("cluster_id"),
        F.coalesce("chain", F.lit("")).alias("reasoning_chain"), "chain_id", F.coalesce("pos", F.lit(0)).cast("int").alias("chain_position"), F.col("pos").alias("chain_hop"), F.col("total").alias("chain_total"), F.col("relation").alias("chain_relation"), "chain_prev", "chain_next",
        F.struct(F.lit(None).cast("string").alias("level"), F.lit(0).alias("access_count")).alias("decay"), F.lit(None).cast("map<string,string>").alias("attrs"),
    )
