"""Filter interaction audit: what each of several filters removes, in every order of them.

Which filters a document fails does not depend on their order, so documents are counted once by part, set of failed
filters (a mask) and labels; what a filter removes after others is the sum of the counts whose mask has its bit and none of theirs.

Equal texts are found by partition refinement.  One scan leaves a narrow row a document: its length in code points and the hashes of
successive blocks of its text.  Documents are split by length, then by one block hash after the other, and each
round drops those that stand alone.  Of the classes that are left the full texts are compared, by grouping on them, and
every document that does not have the smallest doc_id of its text is marked.  Copies meet as partial groups, one a
task, so a text that a third of all documents have is no burden; texts of documents that stand alone are never shuffled.

Cases: a null text is the empty text, a null source the part '', together with empty sources; a null doc_id is not
larger than any, so that row fails no duplicate filter and has no label; rows of one text that share the smallest doc_id are all
kept; a document labelled twice counts if any of its rows has 1; an empty table has no parts and gives no rows; very long texts
are cut into four blocks at most; other columns are not used, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.session import table, written

#: Where blocks begin, in code points; the last goes on to the end of the text.
BLOCKS = (0, 256, 4096, 65536)
#: Classes of equal hashes that are broadcast to the second scan of the texts, each some 80 bytes; more are joined by shuffle.
BROADCAST_CLASSES = 500_000
FILTERS = "ABCDE"


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white space characters."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D."""
    found = words(text)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [F.size(found) < 200, 100 * F.size(F.array_distinct(found)) < 50 * F.size(found), 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def _class_of(text: Column, digest: Callable[[Column], Column]) -> dict[str, Column]:
    """Length and block hashes of a text."""
    ends = [*BLOCKS[1:], 1 << 31]
    return {"n_chars": F.length(text)} | {f"h{k}": digest(F.substring(text, start + 1, end - start - 1)) for k, (start, end) in enumerate(zip(BLOCKS, ends, strict=True))}


def marked(docs: DataFrame, facts: dict[str, Column] | None = None, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs(doc_id, text): doc_id, ``facts`` (columns of text and others) and duplicate: a smaller doc_id has the same text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    facts = facts or {}
    keys = _class_of(body, digest)
    rows = written(docs.select("doc_id", *[c.alias(k) for k, c in facts.items()], *[c.alias(k) for k, c in keys.items()]), "audit-rows")
    alive, depth = rows.select(*keys), 0
    while depth < len(keys):
        depth += 1
        level = list(keys)[:depth]
        shared = written(alive.groupBy(*level).count().filter("count > 1").drop("count"), "audit-shared", few=True)
        alive = written(alive.join(shared, level, "left_semi"), "audit-alive", few=True)
    classes = written(alive.distinct(), "audit-classes", few=True)
    few = classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    texts = docs.select(F.col("doc_id"), body.alias("_text"), *[c.alias(k) for k, c in keys.items()]).join(F.broadcast(classes) if few else classes, list(keys), "left_semi")
    firsts = written(texts.groupBy(*keys, "_text").agg(F.min("doc_id").alias("_first")).withColumn("_n", F.lit(1)), "audit-firsts", few=True)
    by_class = written(firsts.groupBy(*keys).agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n")), "audit-by-class", few=True)
    clashes = by_class.filter("_n > 1").select(*keys)
    told = rows.join(by_class, list(keys), "left")
    out = told.filter("coalesce(_n, 1) = 1").select("doc_id", *facts, F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("duplicate"))
    if clashes.isEmpty():
        return out
    # different texts with the same hashes throughout: their documents are told apart by the texts themselves
    again = docs.select("doc_id", body.alias("_text"), *[c.alias(k) for k, c in facts.items()], *[c.alias(k) for k, c in keys.items()]).join(clashes, list(keys), "left_semi")
    exact = again.join(firsts, [*keys, "_text"]).select("doc_id", *facts, F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("duplicate"))
    return out.unionByName(exact)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters (A is bit 0), and how many of them are labelled so."""
    body = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(body))), F.lit(0))
    rows = marked(docs, {"part": F.coalesce(F.col("source"), F.lit("")), "mask": bits})
    told = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    whole = rows.withColumn("mask", F.col("mask") + F.when(F.col("duplicate"), 16).otherwise(0)).join(told, "doc_id", "left")
    return whole.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, letter): all steps of all orders; ``before`` is the mask of the filters applied already."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        for step, k in enumerate(order):
            rows.append(("".join(FILTERS[x] for x in order), step + 1, sum(1 << x for x in order[:step]), k))
    return spark.createDataFrame(rows, "filter_order string, step int, before int, letter int")


def audit(counts: DataFrame) -> DataFrame:
    """One row a part, order and step, from mask counts: five numbers a part and mask decide them all."""
    steps = orders(counts.sparkSession)
    pairs = [(before, k) for k in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> k & 1]
    wide = counts.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(k).alias("letter")) for b, k in pairs]))).select("*", "_p.*").drop("_p")
    mine, earlier = F.expr("mask & shiftleft(1, letter)") != 0, F.expr("mask & before") != 0
    removed = mine & ~earlier

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    cells = wide.groupBy("part", "before", "letter").agg(
        total("n", ~mine & ~earlier).alias("kept"), total("n", removed).alias("removed"), total("n", mine & earlier).alias("redundant"),
        total("n", F.col("mask") == F.expr("shiftleft(1, letter)")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    # so many orders put exactly these filters before this one; a window holds the 16 sets of one part and filter
    share = F.get(F.array(*[F.lit(x) for x in (24, 6, 4, 6, 24)]), F.bit_count("before"))
    cells = cells.withColumn("shapley", F.sum(F.col("removed") * share).over(W.partitionBy("part", "letter")))
    return cells.join(F.broadcast(steps), ["before", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(mask_counts(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


OP13_SQL = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
failed as (
  select doc_id, part,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from texts),
told as (select doc_id, bool_or(coalesce(quality, 0) = 1) as good, bool_or(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id),
counts as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed left join told using (doc_id) group by part, mask),
letter as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(l, bit)),
perms as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1 : s - 1]), 0)::int as before from perms, (select unnest(range(1, 6))::int as s)),
cells as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (bit | before) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost
  from counts, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from cells
"""
