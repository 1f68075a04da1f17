"""Labelled questions over records: by test dimension, chain and cluster, with negatives; for generated and for corpus records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.operators.chains import UNKNOWN
from recollex.operators.clean import cap_questions, with_person
from recollex.operators.mining import keep_first
from recollex.session import indexed

#: Test dimensions and the share of questions that each gets.
RATIOS = {"精确检索": 0.20, "组合检索": 0.15, "时序推理": 0.12, "因果推理": 0.12, "对比推理": 0.08, "包含推理": 0.08, "推导推理": 0.08, "聚类检索": 0.07, "跨版本": 0.05, "负样本": 0.20}
BY_RELATION = {"时序": "时序推理", "因果": "因果推理", "对比": "对比推理", "包含": "包含推理", "推导": "推导推理"}
BY_CATEGORY = {"存储正确性测试集": "精确检索", "长期记忆深度检索测试集": "跨版本"}
DEFAULT = "组合检索"
#: Least number and share of records of the two kinds of questions over corpus records.
CORPUS_QUOTAS = {"精确检索": (3, 0.15), "组合检索": (3, 0.15)}
#: What does not exist, for negatives.
NO_PEOPLE = "赵钱孙李 周吴郑王 冯陈褚卫 蒋沈韩杨 朱秦尤许 何吕施张 孔曹严华 金魏陶姜".split()
NO_CITIES = "火星 月球 木星 土星 冥王星 水星 金星 海王星".split()
NO_EVENTS = "比特币购买 时光旅行 量子跃迁 黑洞探索 星际战争 外星殖民 维度穿越 时空折叠".split()
NO_ACTIONS = "打篮球 游泳 跳舞 画画 唱歌 下棋 钓鱼 滑雪".split()
TIME_VERBS = ("之后", "然后", "接着", "随后")
NEGATIVE_SHARE, SUBTLE, CONTRARY, PER_PERSON = 0.25, 200, 100, 8
CHAIN_SUFFIX = "链"


def _say(*parts: Column | str) -> Column:
    """Text from columns and literals (a literal begins with a non-ASCII character or a space); nulls are ''."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


NAME, CITY, PLACE, ACTION, PRODUCT, WHEN = (F.col, "person.name"), (F.col, "location.city"), (F.col, "location.place"), (F.col, "event.action"), (F.col, "event.product"), (F.col, "time.absolute")


def _c(x: tuple) -> Column:
    return x[0](x[1])


def dimensions(mems: DataFrame) -> Column:
    """The dimensions of a record: of its chain's relation, of its cluster, of its category; the default if none."""
    of = lambda column, names: reduce(lambda w, x: w.when(F.col(column) == x[0], x[1]), list(names.items())[1:], F.when(F.col(column) == next(iter(names)), next(iter(names.values()))))
    found = F.array_compact(F.array(of("chain_relation", BY_RELATION), F.when(F.coalesce("cluster_id", F.lit("")) != "", "聚类检索"), of("category", BY_CATEGORY)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT)))


def quotas(spark: SparkSession, count: int) -> DataFrame:
    """(dimension, quota): max(1, floor(count * ratio))."""
    return spark.createDataFrame([(d, max(1, int(count * r))) for d, r in RATIOS.items()], "dimension string, quota int")


def allocate(mems: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """Records of each dimension, as many as its quota, in hash order; a record may serve several dimensions."""
    each = mems.withColumn("dimension", F.explode(dimensions(mems))).join(F.broadcast(quotas(mems.sparkSession, count)), "dimension")
    order = W.partitionBy("dimension").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "dimension", F.lit(":"), "memory_id")), "memory_id")
    most = max(1, *(int(count * r) for r in RATIOS.values()))  # a number in the plan, by which tasks cut their rows before the shuffle
    return each.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).filter(F.col("turn") <= F.col("quota")).drop("quota")


def answer_json() -> Column:
    return F.to_json(F.struct(_c(NAME).alias("person"), _say(_c(CITY), _c(PLACE)).alias("location"), _c(ACTION).alias("action"), _c(PRODUCT).alias("product"), F.col("event.quantity").alias("quantity"), F.col("event.price").alias("price"), _c(WHEN).alias("time")))


def answer_text() -> Column:
    return _say("人物：", _c(NAME), "，地点：", _c(CITY), _c(PLACE), "，动作：", _c(ACTION), "，对象：", _c(PRODUCT), "，数量：", F.col("event.quantity").cast("string"), "，时间：", _c(WHEN))


def member_json() -> Column:
    return F.struct(_c(NAME).alias("person"), _c(CITY).alias("location"), _c(ACTION).alias("action"), _c(PRODUCT).alias("product"), _c(WHEN).alias("time"))


def told() -> Column:
    return _say(_c(NAME), "在", _c(CITY), _c(ACTION), "了", _c(PRODUCT))


_OUT = ["sort", "query_text", "query_type", "test_dimension", "expected_memory_ids", "expected_answer", "expected_answer_text", "acceptable_answers", "expected_time", "difficulty", "search_depth", "is_negative"]


def _single(chosen: DataFrame, seed: int) -> DataFrame:
    kinds = F.get(F.array(F.lit("人物检索"), F.lit("地点检索"), F.lit("事件检索")), F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:kind:"), "memory_id")), 1, 8), 16, 10).cast("bigint"), F.lit(3)).cast("int"))
    kind = F.when(F.col("dimension") == "精确检索", kinds).otherwise(F.col("dimension"))
    text = (
        F.when(kind == "人物检索", _say(_c(NAME), "做了什么")).when(kind == "地点检索", _say("在", _c(CITY), "发生过什么")).when(kind == "事件检索", _say("关于", _c(PRODUCT), "的事件有哪些"))
        .when(kind == "跨版本", _say("关于", _c(NAME), "在", _c(CITY), _c(ACTION), "的详情，多说点")).otherwise(_say(_c(NAME), "在", _c(CITY), "的", _c(ACTION), "记录"))
    )
    return chosen.filter(F.col("dimension").isin("精确检索", DEFAULT, "跨版本")).select(
        F.struct(F.col("dimension").alias("a"), F.col("turn").alias("b")).alias("sort"), text.alias("query_text"), kind.alias("query_type"), F.col("dimension").alias("test_dimension"), F.array("memory_id").alias("expected_memory_ids"),
        answer_json().alias("expected_answer"), answer_text().alias("expected_answer_text"), F.transform("versions", lambda v: v["content"]).alias("acceptable_answers"), _c(WHEN).alias("expected_time"), "difficulty",
        F.get(F.array(F.lit("浅层"), F.lit("中层"), F.lit("深层")), F.pmod(F.crc32(F.encode("memory_id", "UTF-8")), F.lit(3)).cast("int")).alias("search_depth"), F.lit(False).alias("is_negative"),
    )


def _collected(mems: DataFrame, by: str, order: str) -> DataFrame:
    """(by, members, ids, texts) in order, at most a chain's or cluster's rows."""
    one = F.struct(F.coalesce(order, F.lit(0)).alias("o"), F.col("ord").alias("r"), F.col("memory_id").alias("id"), told().alias("t"), member_json().alias("m"), _c(NAME).alias("name"), _c(CITY).alias("city"), _c(ACTION).alias("action"), _c(PRODUCT).alias("product"), _c(WHEN).alias("time"))
    return mems.filter(F.coalesce(by, F.lit("")) != "").groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("x"))


def _clustered(chosen: DataFrame, mems: DataFrame) -> DataFrame:
    picked = chosen.filter(F.col("dimension") == "聚类检索").join(_collected(mems, "cluster_id", "ord"), "cluster_id")
    kind, value = F.get("tags", F.lit(2)), F.get("tags", F.lit(3))
    themed = F.coalesce(kind.isin("person", "product", "location") & value.isNotNull(), F.lit(False))
    theme = F.when(themed, value).otherwise(_c(PRODUCT))
    text = F.when(themed & (kind == "person"), _say(theme, "的活动记录有哪些")).when(themed & (kind == "location"), _say("在", theme, "的记录有哪些")).otherwise(_say("关于", theme, "的记录有哪些"))
    summary = F.array_join(F.transform("x", lambda m: m["t"]), "；")
    return picked.select(
        F.struct(F.col("dimension").alias("a"), F.col("turn").alias("b")).alias("sort"), text.alias("query_text"), F.lit("聚类检索").alias("query_type"), F.lit("聚类检索").alias("test_dimension"), F.transform("x", lambda m: m["id"]).alias("expected_memory_ids"),
        F.to_json(F.struct("cluster_id", F.transform("x", lambda m: m["m"]).alias("members"))).alias("expected_answer"), _say("聚类", theme, "：", summary).alias("expected_answer_text"), F.array(summary).alias("acceptable_answers"),
        _c(WHEN).alias("expected_time"), "difficulty", F.lit("中层").alias("search_depth"), F.lit(False).alias("is_negative"),
    )


def _chained(chosen: DataFrame, mems: DataFrame) -> DataFrame:
    picked = keep_first(chosen.filter(F.col("dimension").isin(*BY_RELATION.values()) & (F.coalesce("reasoning_chain", F.lit("")) != "")), "reasoning_chain", "turn")
    both = picked.join(_collected(mems, "reasoning_chain", "chain_position"), "reasoning_chain").filter(F.size("x") >= 2)
    first, second, d = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.col("dimension")
    start = _say(first["name"], "在", first["city"], F.when(first["action"].isin(*TIME_VERBS), "进行").otherwise(first["action"]), "了", first["product"])
    text = (
        F.when(d == "因果推理", _say("因为", start, "，后续导致了哪些事件？")).when(d == "对比推理", _say(start, "，和", second["name"], "的做法有什么不同？")).when(d == "包含推理", _say(start, "，这件事包含了哪些子事件？"))
        .when(d == "推导推理", _say("从", start, "出发，能推导出什么？")).otherwise(_say(start, "，后续事件依次是什么？"))
    )
    summary = F.array_join(F.transform("x", lambda m: m["t"]), " → ")
    return both.select(
        F.struct(d.alias("a"), F.col("turn").alias("b")).alias("sort"), text.alias("query_text"), F.concat(d, F.lit(CHAIN_SUFFIX)).alias("query_type"), d.alias("test_dimension"), F.transform("x", lambda m: m["id"]).alias("expected_memory_ids"),
        F.to_json(F.struct(d.alias("chain_type"), F.transform("x", lambda m: m["m"]).alias("members"))).alias("expected_answer"), _say("链式", d, "：", summary).alias("expected_answer_text"), F.array(summary).alias("acceptable_answers"),
        first["time"].alias("expected_time"), "difficulty", F.lit("深层").alias("search_depth"), F.lit(False).alias("is_negative"),
    )


def _literal(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "query_text string")


def _values(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values in order; '' and null are none."""
    return df.select(F.col(col).alias(out)).filter(F.coalesce(out, F.lit("")) != "").distinct().orderBy(out)


def _combined(left: DataFrame, right: DataFrame, words: list[str], n: int, seed: int) -> DataFrame:
    """left(l) with right(r) and a word w: all of these if they are no more than 4 ``n``, else as many drawn by hash.

    Drawn are numbers of combinations, which name a place in each list, and these are joined; the product is never made.
    """
    spark, many = left.sparkSession, (left.count(), right.count())
    total = many[0] * many[1] * len(words)
    if total <= 4 * n:
        return left.crossJoin(right).withColumn("w", F.explode(F.array(*map(F.lit, words))))  # no more than 4 n rows
    k = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total))
    drawn = spark.range(4 * n).select(k.alias("k")).distinct()
    places = drawn.select(F.floor(F.col("k") / (many[1] * len(words))).alias("_i"), F.pmod(F.floor(F.col("k") / len(words)), F.lit(many[1])).alias("_j"), F.get(F.array(*map(F.lit, words)), (F.col("k") % len(words)).cast("int")).alias("w"))
    return places.join(indexed(left, ["l"], "_i"), "_i").join(indexed(right, ["r"], "_j"), "_j").select("l", "r", "w")


def negatives(mems: DataFrame, n: int, seed: int = 42, subtle: int | None = SUBTLE, contrary: int | None = CONTRARY, pairs: bool = False) -> DataFrame:
    """``n`` questions without an answer, in hash order from all candidates.

    Candidates name persons, places and events that do not exist; real persons in real cities with acts that no record
    has (the first ``subtle`` of them); real persons in places that do not exist buying real things (the first ``contrary``).
    None takes all of these two kinds, or where there are many more than are wanted a draw of them.
    """
    spark = mems.sparkSession
    fixed = [f"{p}最近做了什么" for p in NO_PEOPLE] + [f"在{c}发生了什么" for c in NO_CITIES] + [f"关于{e}的事件有哪些" for e in NO_EVENTS] + ([f"{p}在{c}做了什么" for p in NO_PEOPLE for c in NO_CITIES] if pairs else [])
    people, cities, products = (_values(mems, c, a) for c, a in (("person.name", "p"), ("location.city", "c"), ("event.product", "x")))
    if subtle is not None:  # the first combinations hold no more than so many of either
        people, cities = people.limit(subtle), cities.limit(subtle)
    some = people.filter(F.col("p") != UNKNOWN)
    if subtle is None:
        acts = _combined(some.select(F.col("p").alias("l")), cities.select(F.col("c").alias("r")), NO_ACTIONS, n, seed).select(F.col("l").alias("p"), F.col("r").alias("c"), F.col("w").alias("a"))
    else:
        acts = some.crossJoin(cities).withColumn("a", F.explode(F.array(*map(F.lit, NO_ACTIONS)))).orderBy("p", "c", "a").limit(subtle)
    if contrary is None:
        buys = _combined(some.select(F.col("p").alias("l")), products.select(F.col("x").alias("r")), NO_CITIES, n, seed + 1).select(F.col("l").alias("p"), F.col("w").alias("f"), F.col("r").alias("x"))
    else:
        buys = some.withColumn("f", F.explode(F.array(*map(F.lit, NO_CITIES)))).crossJoin(products.limit(contrary)).orderBy("p", "f", "x").limit(contrary)
    spare = spark.range(len(fixed), max(len(fixed), n)).select(_say("关于未知事件", F.col("id").cast("string"), "的记录"))
    every = _literal(spark, fixed).union(acts.select(_say(F.col("p"), "在", F.col("c"), F.col("a")))).union(buys.select(_say(F.col("p"), "在", F.col("f"), "购买了", F.col("x"))))
    full = every if every.limit(n).count() >= n else every.union(spare)
    order = F.md5(F.concat(F.lit(f"{seed}:"), "query_text"))
    chosen = full.select("query_text").distinct().orderBy(order, "query_text").limit(n)
    return chosen.select(
        F.struct(F.lit("负样本").alias("a"), F.conv(F.substring(order, 1, 13), 16, 10).cast("bigint").alias("b")).alias("sort"), "query_text", F.lit("负样本").alias("query_type"), F.lit("负样本").alias("test_dimension"), F.array().cast("array<string>").alias("expected_memory_ids"),
        F.lit('""').alias("expected_answer"), F.lit("").alias("expected_answer_text"), F.array().cast("array<string>").alias("acceptable_answers"), F.lit(None).cast("string").alias("expected_time"), F.lit("困难").alias("difficulty"), F.lit("浅层").alias("search_depth"), F.lit(True).alias("is_negative"),
    )


def _finished(df: DataFrame) -> DataFrame:
    """Adds query_id and ord in a total order, negatives after positives; the answer as VARIANT."""
    placed = indexed(df, ["is_negative", "sort"], "ord")
    positives = placed.agg(F.count(F.when(~F.col("is_negative"), 1)).alias("_positives"))  # one row
    turn = F.col("ord") + 1 - F.when(F.col("is_negative"), F.col("_positives")).otherwise(0)
    named = placed.crossJoin(positives).withColumn("query_id", F.when(F.col("is_negative"), F.format_string("NEG%04d", turn)).otherwise(F.format_string("Q%04d", turn)))
    return named.select("ord", "query_id", *[c for c in _OUT if c != "sort"]).withColumns(
        {"expected_answer": F.parse_json("expected_answer"), "target_entity": F.lit(None).cast("string"), "logic": F.lit(None).cast("string"), "dimensions": F.array("test_dimension")}
    )


def questions(mems: DataFrame, count: int = 100, seed: int = 42) -> DataFrame:
    """Questions over generated records: positives by dimension without repeated texts, then a quarter as many negatives."""
    chosen = allocate(mems, count, seed)
    positive = _single(chosen, seed).union(_clustered(chosen, mems)).union(_chained(chosen, mems))
    distinct = keep_first(positive, "query_text", "sort")
    return _finished(distinct.union(negatives(mems, max(1, int(distinct.count() * NEGATIVE_SHARE)), seed)))


def corpus_questions(mems: DataFrame, seed: int = 42, per_person: int = PER_PERSON) -> DataFrame:
    """Questions over corpus records: by time, place, person and event, combined, and one for each chain of three or more."""
    n = mems.count()
    quota = {k: max(least, int(n * r)) for k, (least, r) in CORPUS_QUOTAS.items()}
    named, placed, timed = F.col("person.name") != UNKNOWN, F.coalesce("location.city", F.lit("")) != "", F.coalesce("time.absolute", F.lit("")) != ""
    when = F.when(F.coalesce("time.relative", F.lit("")) != "", F.col("time.relative")).otherwise("那天")
    kinds = [
        ("时间检索", "精确检索", timed & named, _say(when, " ", _c(NAME), "做了什么")), ("地点检索", "精确检索", placed, _say("在", _c(CITY), "发生过什么")), ("人物检索", "精确检索", named, _say(_c(NAME), "做了什么")),
        ("事件检索", "精确检索", named, _say(_c(NAME), "关于", _c(PRODUCT), "有什么经历")), ("组合检索", "组合检索", timed & named & placed, _say(when, " ", _c(NAME), "在", _c(CITY), "发生了什么")),
    ]
    parts = []
    for kind, dimension, keep, text in kinds:
        order = F.md5(F.concat(F.lit(f"{seed}:{kind}:"), "memory_id"))
        top = mems.filter(keep).orderBy(order, "memory_id").limit(quota[dimension])
        parts.append(top.select(
            F.struct(F.lit(kind).alias("a"), F.col("ord").alias("b")).alias("sort"), text.alias("query_text"), F.lit(kind).alias("query_type"), F.lit(dimension).alias("test_dimension"), F.array("memory_id").alias("expected_memory_ids"),
            F.to_json(member_json()).alias("expected_answer"), answer_text().alias("expected_answer_text"), F.transform("versions", lambda v: v["content"]).alias("acceptable_answers"), _c(WHEN).alias("expected_time"),
            F.coalesce("difficulty", F.lit("中等")).alias("difficulty"), F.lit("浅层").alias("search_depth"), F.lit(False).alias("is_negative"),
        ))
    parts.append(_corpus_chains(mems))
    positive = indexed(reduce(DataFrame.union, parts), ["sort"], "ord")
    capped = cap_questions(with_person(positive, mems), per_person, varied=True).drop("ord", "person").select(*_OUT)
    return _finished(capped.union(negatives(mems, max(1, int(capped.count() * NEGATIVE_SHARE)), seed, None, None, True)))


def _corpus_chains(mems: DataFrame) -> DataFrame:
    relation = mems.filter(F.coalesce("reasoning_chain", F.lit("")) != "").groupBy("reasoning_chain").agg(F.min_by("chain_relation", F.struct("chain_position", "ord")).alias("relation"), F.min("ord").alias("first"))
    x = _collected(mems, "reasoning_chain", "chain_position").filter(F.size("x") >= 3).join(relation, "reasoning_chain")
    deed = lambda m: _say(m["name"], m["action"], "了", m["product"])
    a, b, mid = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.floor(F.size("x") / 2).cast("int")
    r, middle, previous = F.coalesce("relation", F.lit("关联")), F.get("x", mid), F.get("x", mid - 1)
    text = (
        F.when(r == "时序", _say("在", deed(previous), "之后，", middle["name"], "又做了什么？")).when(r == "因果", _say("因为", deed(a), "，后面导致", b["name"], "做了什么？")).when(r == "对比", _say(deed(a), "，而", b["name"], "做了什么不同的？"))
        .when(r == "包含", _say(deed(a), "，这件事里面包含了", b["name"], "的什么行为？")).when(r == "推导", _say("从", deed(a), "出发，能推导出", b["name"], "做了什么？")).otherwise(_say("请梳理", a["name"], "的完整经历脉络"))
    )
    dimension = reduce(lambda w, d: w.when(r == d[0], d[1]), list(BY_RELATION.items())[1:], F.when(r == "时序", "时序推理")).otherwise("组合推理")
    summary = F.array_join(F.transform("x", lambda m, i: _say((i + 1).cast("string"), ". ", deed(m), "（", m["time"], "）")), "；")
    return x.select(
        F.struct(F.lit("组合推理").alias("a"), F.col("first").alias("b")).alias("sort"), text.alias("query_text"), F.lit("组合推理").alias("query_type"), dimension.alias("test_dimension"), F.transform("x", lambda m: m["id"]).alias("expected_memory_ids"),
        F.to_json(F.struct(r.alias("chain_type"), F.transform("x", lambda m: m["m"]).alias("members"))).alias("expected_answer"), summary.alias("expected_answer_text"), F.array(summary).alias("acceptable_answers"), a["time"].alias("expected_time"),
        F.lit("中等").alias("difficulty"), F.lit("深层").alias("search_depth"), F.lit(False).alias("is_negative"),
    )
