"""Rule checks of a database: each check is a query, all of them one frame (check, status, subject, n, value).

status is PASS, WARN or ERROR; a database passes without ERROR.  ``detailed`` has the finer rules, with status 🔴 or 🟡.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.operators.chains import contiguity, gaps

NEGATIVE_SHARE, LENGTH, BALANCE, LEAST_CLUSTER, LEAST_KINDS, LEAST_CATEGORIES = (0.15, 0.25), (20, 120), 2, 3, 10, 6
#: Names and words that the detailed rules look for.
CHAIN_TYPES = ("时序推理链", "因果推理链", "对比推理链", "包含推理链", "推导推理链")
TIME_VERBS = ("之后", "然后", "接着", "随后")
BAD_GRAMMAR = ("之后了", "然后了", "接着了", "随后了")
LEAKED = ("event_type", "memory_id", "chain_id", "cluster_id", "location")
NEGATIVE_ACTIONS = ("游泳", "打篮球", "滑雪", "唱歌", "画画")
TEXTS = {
    "memory_ids": "记忆ID唯一性", "query_ids": "查询ID唯一性", "references": "查询指向有效记忆", "negatives_empty": "负样本标记正确", "positives_filled": "正样本标记正确", "negative_share": "负样本比例", "version_length": "版本长度",
    "categories": "类别分布", "category_balance": "类别均衡", "chains": "链式数据", "chain_positions": "链位置连续", "clusters": "聚类数据", "cluster_size": "聚类大小", "cities": "城市多样性", "names": "人名多样性", "products": "产品多样性", "query_texts": "查询文本重复",
}


def _row(df: DataFrame, check: str, bad: Column, status: str, n: Column, value: Column | None = None) -> DataFrame:
    """One row from a frame of one row: ``status`` if ``bad``, else PASS."""
    return df.select(F.lit(check).alias("check"), F.when(bad, status).otherwise("PASS").alias("status"), F.lit("").alias("subject"), n.cast("long").alias("n"), (n if value is None else value).cast("double").alias("value"))


def _each(df: DataFrame, check: str, status: str, subject: Column, n: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(status).alias("status"), subject.cast("string").alias("subject"), n.cast("long").alias("n"), n.cast("double").alias("value"))


def _repeats(df: DataFrame, key: str, check: str, status: str) -> DataFrame:
    one = df.agg((F.count("*") - F.countDistinct(F.coalesce(F.col(key), F.lit("")))).alias("d"))
    return _row(one, check, F.col("d") > 0, status, F.col("d"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def dangling(queries: DataFrame, mems: DataFrame) -> DataFrame:
    """(query_id, memory_id): each expected id that no record has."""
    each = queries.select("query_id", F.explode("expected_memory_ids").alias("memory_id")).filter(F.coalesce("memory_id", F.lit("")) != "")
    return each.join(mems.select("memory_id").distinct(), "memory_id", "left_anti").select("query_id", "memory_id")


def check(mems: DataFrame, queries: DataFrame) -> DataFrame:
    negative, named = F.coalesce("is_negative", F.lit(False)), F.size("expected_memory_ids") > 0
    marks = queries.agg(F.count(F.when(negative, 1)).alias("neg"), F.count(F.when(negative & named, 1)).alias("bad_neg"), F.count(F.when(~negative & ~named, 1)).alias("bad_pos"), F.count("*").alias("n"))
    share = F.coalesce(F.col("neg") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    lengths = mems.select(F.explode("versions").alias("v")).agg(F.count("*").alias("n"), F.avg(F.length(F.coalesce("v.content", F.lit("")))).alias("mean"))
    sizes = mems.groupBy("category").agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.coalesce(F.min("n"), F.lit(0)).alias("low"), F.coalesce(F.max("n"), F.lit(0)).alias("high"))
    chained = contiguity(mems.select("reasoning_chain", "chain_position"), "reasoning_chain", "chain_position")
    clusters = mems.filter(_filled("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("n"))
    kinds = mems.agg(*[F.countDistinct(c).alias(a) for c, a in (("location.city", "cities"), ("person.name", "names"), ("event.product", "products"))])
    parts = [
        _repeats(mems, "memory_id", "memory_ids", "ERROR"),
        _repeats(queries, "query_id", "query_ids", "ERROR"),
        _row(dangling(queries, mems).agg(F.count("*").alias("n")), "references", F.col("n") > 0, "ERROR", F.col("n")),
        _row(marks, "negatives_empty", F.col("bad_neg") > 0, "ERROR", F.col("bad_neg")),
        _row(marks, "positives_filled", F.col("bad_pos") > 0, "ERROR", F.col("bad_pos")),
        _row(marks, "negative_share", ~share.between(*NEGATIVE_SHARE), "WARN", F.col("neg"), share),
        _row(lengths, "version_length", ~F.col("mean").between(*LENGTH), "WARN", F.col("n"), F.col("mean")).filter("n > 0"),
        _row(sizes, "categories", F.col("kinds") < LEAST_CATEGORIES, "WARN", F.col("kinds")),
        _row(sizes, "category_balance", (F.col("low") > 0) & (F.col("high") > BALANCE * F.col("low")), "WARN", F.col("high"), F.coalesce(F.col("high") / F.nullif(F.col("low"), F.lit(0)), F.lit(0.0))),
        _row(chained.agg(F.count("*").alias("n")), "chains", F.col("n") == 0, "WARN", F.col("n")),
        _each(chained.filter("not contiguous"), "chain_positions", "WARN", F.col("reasoning_chain"), F.col("n")),
        _row(clusters.agg(F.count("*").alias("n")), "clusters", F.col("n") == 0, "WARN", F.col("n")),
        _each(clusters.filter(F.col("n") < LEAST_CLUSTER), "cluster_size", "WARN", F.col("cluster_id"), F.col("n")),
        *[_row(kinds, c, F.col(c) < LEAST_KINDS, "WARN", F.col(c)) for c in ("cities", "names", "products")],
        _repeats(queries, "query_text", "query_texts", "WARN"),
    ]
    return reduce(DataFrame.union, parts)


def passed(report: DataFrame) -> bool:
    return not report.filter("status = 'ERROR'").head(1)


def rendered(report: DataFrame) -> str:
    rows = report.collect()  # a row for each check and each broken chain or cluster
    lines = [f"[{r['status']}] {TEXTS.get(r['check'], r['check'])} {r['subject']} n={r['n']} value={r['value']:.3f}" for r in rows]
    return "\n".join([*lines, f"{sum(r['status'] == 'ERROR' for r in rows)} errors, {sum(r['status'] == 'WARN' for r in rows)} warnings"])


def negative_class(text: Column) -> Column:
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return F.when(any_of(("在火星", "在木星")), "地点不存在").when(any_of(NEGATIVE_ACTIONS), "动作不存在").when(any_of(("购买了",)), "产品不存在").when(any_of(("最近做了什么",)), "人物不存在").otherwise("其他")


def _issue(df: DataFrame, rule: str, status: str, subject: Column | str, detail: Column | str) -> DataFrame:
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(F.lit(rule).alias("rule"), F.lit(status).alias("status"), column(subject).alias("subject"), column(detail).alias("detail"))


def detailed(mems: DataFrame, queries: DataFrame) -> DataFrame:
    """(rule, status, subject, detail) of every issue found."""
    q = queries.withColumn("is_negative", F.coalesce("is_negative", F.lit(False)))
    text, answer = F.col("query_text"), F.coalesce("expected_answer_text", F.lit(""))
    known = mems.select("memory_id", F.col("person.name").alias("person"), F.col("event.action").alias("action"), F.col("event.product").alias("product"), F.col("location.city").alias("city"), F.coalesce("reasoning_chain", F.lit("")).alias("chain"), F.coalesce("cluster_id", F.lit("")).alias("cluster")).dropDuplicates(["memory_id"])
    each = q.select("query_id", "query_text", "query_type", answer.alias("answer"), F.posexplode("expected_memory_ids").alias("p", "memory_id")).join(known, "memory_id")
    is_chain, is_cluster = F.col("query_type").isin(*CHAIN_TYPES), F.col("query_type") == "聚类检索"
    several = F.size("expected_memory_ids") >= 2
    both = lambda kind, part: each.filter(kind).join(q.filter(several).select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.countDistinct(part).alias("n")).filter("n > 1")
    first = each.filter(is_chain).groupBy("query_id").agg(F.min_by("action", "p").alias("action"))
    person, place, premise = F.regexp_extract(text, r"^(.+?)做了什么", 1), F.regexp_extract(text, r"在(\S+)发生过", 1), F.trim(F.regexp_extract(text, r"从(.+?)出发", 1))
    told = F.concat("person", F.lit("在"), "city", "action", F.lit("了"), "product")
    any_of = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    negatives = q.filter("is_negative")
    parts = [
        _issue(q.groupBy("query_text").count().filter("count > 1"), "repeated_text", "🔴", "query_text", "count"),
        _issue(q.filter(F.col("is_negative") & (F.size("expected_memory_ids") > 0)), "negative_with_ids", "🔴", "query_id", F.array_join("expected_memory_ids", ",")),
        _issue(q.filter(is_chain & ~several), "chain_too_short", "🔴", "query_id", F.size("expected_memory_ids")),
        _issue(both(is_chain, "chain"), "several_chains", "🔴", "query_id", "n"),
        _issue(q.filter(is_chain & text.rlike("后续事件|导致了哪些事件") & ~text.rlike(r"在\S+了\S+")), "chain_start", "🟡", "query_id", "query_text"),
        _issue(first.filter(F.col("action").isin(*TIME_VERBS)), "chain_first_verb", "🔴", "query_id", "action"),
        _issue(q.filter(is_cluster & ~several), "cluster_too_small", "🟡", "query_id", F.size("expected_memory_ids")),
        _issue(both(is_cluster, "cluster"), "several_clusters", "🔴", "query_id", "n"),
        _issue(q.filter((F.col("query_type") == "人物检索") & (person != "") & ~F.contains(answer, person)), "answer_person", "🟡", "query_id", person),
        _issue(q.filter((F.col("query_type") == "地点检索") & (place != "") & ~F.contains(answer, place)), "answer_place", "🟡", "query_id", place),
        _issue(q.filter((F.col("query_type") == "跨版本") & (F.coalesce(F.size("acceptable_answers"), F.lit(0)) < 3)), "answer_versions", "🟡", "query_id", F.coalesce(F.size("acceptable_answers"), F.lit(0))),
        _issue(q.select("query_id", F.explode(any_of(BAD_GRAMMAR)).alias("w")), "grammar", "🔴", "query_id", "w"),
        _issue(q.select("query_id", F.explode(any_of(LEAKED)).alias("w")), "leaked_name", "🔴", "query_id", "w"),
        _issue(gaps(mems.filter(F.coalesce("reasoning_chain", F.lit("")) != "").filter("chain_relation = '时序'"), "reasoning_chain", "chain_position"), "chain_gap", "🟡", "reasoning_chain", "gaps"),
        _issue(each.filter(is_chain & ~F.contains(F.col("answer"), F.col("person"))), "answer_member", "🟡", "query_id", "person"),
        _issue(each.filter((F.col("query_type") == "推导推理链") & (F.col("p") == 0) & (premise != "") & (premise != told)), "premise", "🟡", "query_id", premise),
        _issue(negatives.groupBy(F.regexp_extract(text, r"^(\S+)", 1).alias("head")).count().filter("count > 3 and head <> ''"), "negative_person", "🟡", "head", "count"),
        _issue(negatives.agg(F.countDistinct(negative_class(text)).alias("n")).filter("n < 3"), "negative_kinds", "🟡", F.lit("*"), "n"),
    ]
    return reduce(DataFrame.union, parts)


def severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("status").agg(F.count("*").alias("n"))
