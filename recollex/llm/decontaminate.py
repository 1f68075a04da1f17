"""Benchmark decontamination by a broadcast set of normalised word n-grams.  DataFrame functions only.

Every run of ``size`` words of a benchmark item is a window (an item of fewer words, but not none, is one whole
window).  Documents are cut into runs of the same lengths where they are read; the runs' hashes probe a
broadcast table of the windows' hashes (a shuffle join if there are more than BROADCAST_WINDOWS of them, so
that what is broadcast has a bound); what matches is verified word by word against the document's text, and
the words inside verified windows are hit.

Words are runs of digits, ASCII letters and everything beyond ASCII, with A-Z lower-cased.

Cases: a null or empty text has no words and is never hit; a null item text has no windows, a null item id hits
words but is not listed; repeated items list once; repeated documents repeat their row; documents may have a null
or repeated id; windows may overlap and repeat; an empty benchmark hits nothing, an empty table gives
no rows; other columns of the documents are kept, but for those that this adds, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import table

SIZE = 10
BROADCAST_WINDOWS = 1_000_000
#: The characters between words, before and after lower-casing.
BETWEEN, BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN + "+"), "")


def runs(w: Column, size: int | Column) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer words."""
    count = F.size(w) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, length, gram, items): distinct windows of all items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(F.array(words(F.col(text)))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    each = items.select("item", n.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    return each.groupBy(F.xxhash64("gram").alias("hash"), "length", F.array_join("gram", " ").alias("gram")).agg(F.collect_set("item").alias("items"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_k1 and _k2 tell rows apart that differ in id or text; rows equal in both share their result."""
    return docs.withColumns({"_k1": F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)), "_k2": F.xxhash64(F.col(text), F.col(doc_id).isNull())})


def _entry(length: int):
    return lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("length"), h.alias("hash"))


def _matches(docs: DataFrame, grams: DataFrame, size: int, text: str) -> DataFrame:
    """(_k1, _k2, found): for each document with a match its distinct (pos, length, gram, items), unverified."""
    lengths = sorted(x["length"] for x in grams.select("length").distinct().collect())  # at most ``size`` numbers
    if not lengths:
        lengths = [size]
    w = docs.select("_k1", "_k2", F.explode(F.array(words(F.col(text)))).alias("w"))
    if lengths == [size]:
        probe = w.select("_k1", "_k2", F.posexplode(runs(F.col("w"), size)).alias("pos", "hash")).withColumn("length", F.lit(size))
    else:
        each = [F.transform(runs(F.col("w"), n), _entry(n)) for n in lengths]
        probe = w.select("_k1", "_k2", F.inline(F.concat(*each)))
    side = F.broadcast(grams) if grams.count() <= BROADCAST_WINDOWS else grams
    met = probe.join(side, ["hash", "length"]).select("_k1", "_k2", "pos", "length", "gram", "items")
    # grouping twice: rows of repeated documents fold before one document's matches meet
    once = met.groupBy("_k1", "_k2", "pos", "length", "gram").agg(F.first("items").alias("items"))
    return once.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("pos", "length", "gram", "items"))).alias("found"))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_words, hits (verified, array of pos, length, items), n_hit, items (sorted ids) and contaminated."""
    added = ("n_words", "hits", "n_hit", "items", "contaminated")
    docs = _keyed(docs.select(*[c for c in docs.columns if c not in added]), doc_id, text)
    found = _matches(docs, windows(benchmark, size), size, text)
    both = docs.join(found.withColumnsRenamed({"_k1": "_f1", "_k2": "_f2"}), (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left").drop("_k1", "_k2", "_f1", "_f2")
    # generated, so that the words are made once a row and not once a match
    seen = both.select("*", F.explode(F.array(words(F.col(text)))).alias("_w"))
    right = F.filter(F.coalesce(F.col("found"), F.array()), lambda h: F.array_join(F.slice(F.col("_w"), h["pos"] + 1, h["length"]), " ") == h["gram"])
    hits = F.transform(right, lambda h: F.struct(h["pos"].alias("pos"), h["length"].alias("length"), h["items"].alias("items")))
    kept = seen.select(*[c for c in docs.columns if not c.startswith("_k")], F.size("_w").alias("n_words"), F.when(F.col("found").isNull(), F.array().cast("array<struct<pos:int,length:int,items:array<string>>>")).otherwise(hits).alias("hits"))
    covered = F.aggregate(
        F.col("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a["n"] + F.greatest(h["pos"] + h["length"] - F.greatest(a["end"], h["pos"]), F.lit(0))).alias("n"), F.greatest(a["end"], h["pos"] + h["length"]).alias("end")),
        lambda a: a["n"],
    )
    return kept.withColumns({"n_hit": covered, "items": F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))}).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every hit word and the characters after it cut out (``spans``), or without hit documents (``documents``)."""
    columns, marked = docs.columns, mark(docs, benchmark, size, doc_id, text)
    if remove == "documents":
        return marked.filter(~F.col("contaminated")).select(*columns)
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.regexp_extract_all(body, F.lit(f"([^{BETWEEN_ANY_CASE[1:]}+{BETWEEN_ANY_CASE}*)"), 1)
    lead = F.regexp_extract(body, f"^({BETWEEN_ANY_CASE}*)", 1)
    kept = F.filter(parts, lambda p, i: ~F.exists(F.col("hits"), lambda h: (i >= h["pos"]) & (i < h["pos"] + h["length"])))
    cut = F.when(F.col("contaminated"), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text))
    return marked.withColumn(text, cut).select(*columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP7_SQL = f"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w, row_number() over () as row from documents
), items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark
), grams as (
  select distinct item, least(len(w), {SIZE}) as n, array_to_string(w[i : i + least(len(w), {SIZE}) - 1], ' ') as gram
  from (select item, w, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) as i from items where len(w) > 0)
), spans as (
  select row, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from words cross join (select distinct n from grams) where len(w) >= n)
), met as (select row, i, spans.n, item from spans join grams using (n, gram)
), hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from met) group by row
), listed as (select row, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from met where item is not null group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (row) left join listed using (row)
"""
