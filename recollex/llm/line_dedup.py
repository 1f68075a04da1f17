"""Line dedup within one edit by a deletion-neighbourhood join.  DataFrame functions only.

A line goes if an earlier one, in order of (doc_id, line number) over all documents, equals it or is one inserted,
deleted or replaced character away.  Lines are compared without blanks at their ends; blank lines stay.

1.  Equal lines are one class, known by two 64-bit hashes and its earliest place.
2.  Two lines within one edit agree in the first or in the second half of the longer one: a class stays a
    candidate only if it shares the hash of a half with another class.  Texts of candidates are read again.
3.  The same again by pieces of PIECE characters: lines within one edit agree outside of one piece.
4.  For pieces that are met outside alike, all variants with one character deleted are emitted as hashed keys (and
    the piece itself, for the longer line's variants to meet).  Lines that differ in one replaced character share a
    variant and its place; a line that lacks a character of another is itself a variant of it.
5.  Each variant is joined with the earliest line that has it, the edit distance is verified, and the later line goes.

Nothing here makes pairs: classes meet the earliest member of their group, so a line that a third of all
documents have, or thousands of lines that differ in one character, cost one row a member and no more.

That is the rule of the SQL, and of ``dedup_lines`` without ``bounds``.  With ``bounds`` the edits allowed follow from the
length of the shorter of two lines.  Of two lines within k edits, one of the k + 1 segments of the shorter is found whole
in the longer, moved by no more than the edits allow; lines that share a segment so are paired and each pair is verified.
No pair is left out, so lines that share a segment cost the square of their number there.  A line then goes only for an
earlier one that stays itself, which takes a round for each link of the longest chain of near lines.

Cases: a null text has no lines and stays null; an empty text is one blank line; a text may lose all its lines and
is then empty; repeated doc_ids are ordered by a hash of their texts, rows equal in both are the same lines and
share their fate; null doc_ids come first; very long lines are compared piece by piece; an empty table gives no rows;
other columns are kept, but for those that this adds, which replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import table, written

PIECE = 32
#: Up to so many candidate classes (some 40 bytes each) are broadcast to find their texts; beyond, they are joined by shuffle.
BROADCAST_CLASSES = 1_000_000
BLANKS = " \t\r"
#: (length from which on, edits allowed), ascending; lines shorter than the first length go only for an equal one.
Bounds = tuple[tuple[int, int], ...]
BOUNDS: Bounds = ((8, 1), (24, 2), (60, 3), (120, 4))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"_id": F.col(doc_id), "_k": F.xxhash64(F.col(text))})


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of both halves, as a line of its own length and as one that lacks a character of a longer one."""
    keys = []
    for longer in (0, 1):
        full = n + longer
        half = F.floor(full / 2).cast("int")
        rest = (full - half).cast("int")
        keys += [F.xxhash64(F.lit(0), full, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), full, F.substring(line, n - rest + 1, rest))]
    return F.array(*keys)


def _classes(docs: DataFrame, text: str) -> DataFrame:
    """(h1, h2, at, keys): one row for each distinct line that is not blank."""
    each = docs.filter(F.col(text).isNotNull()).select("_id", "_k", F.posexplode(_lines(F.col(text))).alias("_no", "raw")).select("_id", "_k", "_no", _trimmed(F.col("raw")).alias("line"))
    each = each.filter(F.col("line") != "")
    marked = each.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), F.struct("_id", "_k", "_no").alias("at"), _half_keys(F.col("line"), F.length("line")).alias("keys"))
    return marked.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.min("keys").alias("keys"))


def _shared(rows: DataFrame) -> DataFrame:
    """The keys that several rows have; no class has a key twice, as a key holds the length and the part that it stands for."""
    return rows.groupBy("key").count().filter("count > 1").select("key")


def _candidates(docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """(h1, h2, at, line): classes that share a half with another, with their text."""
    # only keys are counted, and few of them are shared: the classes then meet those where they are read
    keys = written(_shared(classes.select(F.explode("keys").alias("key"))), "shared-halves", few=True)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_CLASSES else keys
    met = classes.select("h1", "h2", "at", F.explode("keys").alias("key")).join(keys, "key", "left_semi")
    chosen = written(met.drop("key").dropDuplicates(["h1", "h2"]), "near-lines", few=True)
    by_document = chosen.select(F.col("at._id").alias("_i"), F.col("at._k").alias("_j"), "h1", "h2", "at")
    wanted = by_document.groupBy("_i", "_j").agg(F.collect_list(F.struct("h1", "h2", "at")).alias("wanted"))  # at most a document's lines
    wanted = F.broadcast(wanted) if chosen.count() <= BROADCAST_CLASSES else wanted
    # repeated rows give the same lines: one is enough
    met = docs.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_j")))
    texts = met.select(F.explode(F.array(_lines(F.col(text)))).alias("lines"), "wanted")
    found = texts.select(F.explode(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["at"].alias("at"), F.get(F.col("lines"), w["at"]["_no"]).alias("raw")))).alias("x"))
    return found.select("x.h1", "x.h2", "x.at", _trimmed(F.col("x.raw")).alias("line")).dropDuplicates(["h1", "h2"])


def _pieces(lines: DataFrame) -> DataFrame:
    """(h1, h2, at, key, whole, piece): each line without each of its pieces (key: what is around it, and its place)."""
    n = F.length("line")
    sized = lines.select("h1", "h2", "at", "line", n.alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).withColumn("full", F.col("n") + F.col("longer"))
    count = F.ceil(F.col("full") / F.lit(PIECE)).cast("int")
    each = sized.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("j"))
    before = F.col("j") * PIECE
    after = F.greatest(F.col("full") - before - PIECE, F.lit(0))
    around = F.xxhash64("full", "j", F.substring("line", F.lit(1), before), F.substring("line", F.col("n") - after + 1, after))
    return each.select("h1", "h2", "at", around.alias("key"), (F.col("longer") == 1).alias("whole"), F.substring("line", before + 1, F.col("n") - before - after).alias("piece"))


def _near(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that have an earlier one within one edit."""
    pieces = written(_pieces(lines), "line-pieces")
    pieces = pieces.join(_shared(pieces), "key", "left_semi")
    size = F.length("piece")
    cut = lambda i: F.concat(F.substring("piece", F.lit(1), i), F.substring("piece", i + 2, size))
    variants = F.when(F.col("whole"), F.array(F.struct(F.lit(-1).alias("i"), F.col("piece").alias("v")))).when(
        size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), cut(i).alias("v")))
    )
    out = pieces.select("h1", "h2", "at", "whole", "piece", "key", F.explode(variants).alias("x")).select("h1", "h2", "at", "whole", "piece", F.col("x.i").alias("i"), F.xxhash64("key", "x.v").alias("variant"))
    # replaced: the same variant with the same place deleted; inserted or deleted: the one's variant is the other's piece
    mine = F.when(F.col("whole"), F.array(F.struct(F.lit(-2).alias("own"), F.lit(-1).alias("other")))).otherwise(
        F.array(F.struct(F.col("i").alias("own"), F.col("i").alias("other")), F.struct(F.lit(-1).alias("own"), F.lit(-2).alias("other")))
    )
    asked = out.select("*", F.explode(mine).alias("m")).select("h1", "h2", "at", "piece", "variant", F.col("m.own").alias("own"), F.col("m.other").alias("other"))
    earliest = asked.groupBy(F.col("variant").alias("v"), F.col("own").alias("o")).agg(F.min(F.struct("at", "piece")).alias("first"))
    met = asked.join(earliest, (F.col("variant") == F.col("v")) & (F.col("other") == F.col("o")))
    return met.filter((F.col("first.at") < F.col("at")) & (F.levenshtein("piece", "first.piece", 1) >= 0)).select("h1", "h2").distinct()


def _allowed(n: Column, bounds: Bounds) -> Column:
    """Edits allowed to a line of ``n`` characters."""
    return F.greatest(F.lit(0), *[F.when(n >= least, edits).otherwise(0) for least, edits in bounds])


def _distinct(docs: DataFrame, text: str) -> DataFrame:
    """(h1, h2, at, line): one row for each distinct line that is not blank."""
    each = docs.filter(F.col(text).isNotNull()).select("_id", "_k", F.posexplode(_lines(F.col(text))).alias("_no", "raw")).select("_id", "_k", "_no", _trimmed(F.col("raw")).alias("line"))
    marked = each.filter(F.col("line") != "").select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), F.struct("_id", "_k", "_no").alias("at"), "line")
    return marked.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("line").alias("line"))


def _segments(lines: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(key, h1, h2) twice: of each line as the shorter of two, and where a longer line would have these segments."""
    most = max(edits for _, edits in bounds)
    start = F.floor(F.col("i") * F.col("n") / (F.col("k") + 1)).cast("int")
    size = (F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1)) - start).cast("int")
    sized = lines.select("h1", "h2", "line", F.length("line").alias("full"))
    own = sized.select("*", F.col("full").alias("n"), _allowed(F.col("full"), bounds).alias("k")).filter("k > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    own = own.select(F.xxhash64("n", "i", F.substring("line", start + 1, size)).alias("key"), "h1", "h2")
    places = [(k, over, i, d) for k in range(1, most + 1) for over in range(k + 1) for i in range(k + 1) for d in range(-k, k + 1) if abs(d) + abs(over - d) <= k]
    asks = lines.sparkSession.createDataFrame(places, "k int, over int, i int, d int")  # some hundreds of rows
    longer = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("over")).withColumn("n", F.col("full") - F.col("over"))
    longer = longer.withColumn("k", _allowed(F.col("n"), bounds)).filter("k >= over").join(F.broadcast(asks), ["k", "over"])
    longer = longer.filter((start + F.col("d") >= 0) & (start + F.col("d") + size <= F.col("full")))
    return own, longer.select(F.xxhash64("n", "i", F.substring("line", start + F.col("d") + 1, size)).alias("key"), "h1", "h2")


def _pairs(lines: DataFrame, bounds: Bounds) -> DataFrame:
    """(h1, h2, g1, g2): each line h with each earlier line g within the edits that the shorter one allows."""
    own, longer = _segments(lines, bounds)
    met = longer.join(own.select("key", F.col("h1").alias("g1"), F.col("h2").alias("g2")), "key").filter("h1 <> g1 or h2 <> g2").select("h1", "h2", "g1", "g2").distinct()
    named = lines.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("at").alias("g_at"), F.col("line").alias("other"))
    both = met.join(lines, ["h1", "h2"]).join(named, ["g1", "g2"])
    most = max(edits for _, edits in bounds)
    distance = F.levenshtein("line", "other", most)
    near = both.filter((distance >= 0) & (distance <= _allowed(F.least(F.length("line"), F.length("other")), bounds)))
    later = F.col("at") > F.col("g_at")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    return near.select(pick("h1", "g1").alias("h1"), pick("h2", "g2").alias("h2"), pick("g1", "h1").alias("g1"), pick("g2", "h2").alias("g2")).distinct()


def _gone(pairs: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that have an earlier one that stays, of all pairs of a later line h with an earlier g."""
    left, gone = written(pairs, "line-pairs"), []
    while not left.isEmpty():
        # an earlier line that waits for none itself stays, and what is near it goes; the first of all is such a one
        staying = left.select(F.col("g1").alias("s1"), F.col("g2").alias("s2")).distinct().join(left.select(F.col("h1").alias("s1"), F.col("h2").alias("s2")), ["s1", "s2"], "left_anti")
        now = written(left.join(staying, (F.col("g1") == F.col("s1")) & (F.col("g2") == F.col("s2")), "left_semi").select("h1", "h2").distinct(), "lines-gone")
        gone.append(now)
        left = left.join(now, ["h1", "h2"], "left_anti").select("h1", "h2", "g1", "g2")
        left = written(left.join(now.select(F.col("h1").alias("g1"), F.col("h2").alias("g2")), ["g1", "g2"], "left_anti").select("h1", "h2", "g1", "g2"), "line-pairs")
    return reduce(DataFrame.union, gone) if gone else left.select("h1", "h2")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bounds: Bounds | None = None) -> DataFrame:
    """The documents with only the lines that stay; adds n_lines and n_removed.  Without ``bounds`` by the rule of the SQL."""
    if bounds is not None and (not bounds or list(bounds) != sorted(bounds) or any(not 0 < edits <= least for least, edits in bounds)):
        raise ValueError("bounds are (length, edits) in ascending order, with at least one edit and at most as many as the length")
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")])
    columns, keyed = docs.columns, _keyed(docs, doc_id, text)
    slim = keyed.select("_id", "_k", text)
    classes = written(_classes(slim, text) if bounds is None else _distinct(slim, text), "lines")
    near = _near(_candidates(slim, classes, text)) if bounds is None else _gone(_pairs(classes, bounds))
    staying = classes.select("h1", "h2", "at").join(near, ["h1", "h2"], "left_anti")
    kept = staying.groupBy(F.col("at._id").alias("_i"), F.col("at._k").alias("_j")).agg(F.collect_list("at._no").alias("_kept"))
    both = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_j")), "left")
    # generated, so that the lines are made once a row
    made = both.select("*", F.explode(F.array(_lines(F.coalesce(F.col(text), F.lit(""))))).alias("_all"))
    every = F.sequence(F.lit(0), F.size("_all") - 1)
    blank = F.filter(every, lambda i: _trimmed(F.get(F.col("_all"), i)) == "")
    placed = made.select(*[F.col(c) for c in columns], "_all", F.array_sort(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), blank)).alias("_stay"))
    clean = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_all"), i)), "\n")
    absent = F.col(text).isNull()
    return placed.select(
        *[F.when(absent, F.lit(None)).otherwise(clean).alias(text) if c == text else F.col(c) for c in columns],
        F.when(absent, 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
        F.when(absent, 0).otherwise(F.size("_all") - F.size("_stay")).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
with lines as (
  select doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13)) as line
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as no from documents where text is not null)
), classes as (select line, length(line) as n, min((doc_id, no)) as place from lines where line <> '' group by line
), halves as (
  select line, n, place, n + longer as full_n, left(line, cast(floor((n + longer) / 2) as bigint)) as head, right(line, n + longer - cast(floor((n + longer) / 2) as bigint)) as tail
  from classes, (values (0), (1)) as t(longer)
), pairs as (
  select a.line, a.n, b.line as other, b.n as m from halves a join halves b on a.full_n = b.full_n and a.head = b.head and a.place > b.place where greatest(a.n, b.n) = a.full_n
  union
  select a.line, a.n, b.line as other, b.n as m from halves a join halves b on a.full_n = b.full_n and a.tail = b.tail and a.place > b.place where greatest(a.n, b.n) = a.full_n
), near as (
  select distinct line from pairs
  where (n = m and len(list_filter(range(n), lambda i: left(line, i) = left(other, i) and substr(line, i + 2) = substr(other, i + 2))) > 0)
     or (n = m + 1 and len(list_filter(range(n), lambda i: left(line, i) || substr(line, i + 2) = other)) > 0)
     or (m = n + 1 and len(list_filter(range(m), lambda i: left(other, i) || substr(other, i + 2) = line)) > 0)
), stay as (
  select l.doc_id, l.no, l.raw from lines l left join classes c using (line)
  where l.line = '' or ((l.doc_id, l.no) = c.place and l.line not in (select line from near))
), made as (select doc_id, count(*) as n, string_agg(raw, chr(10) order by no) as text from stay group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(m.n, 0) as n_removed,
  case when d.text is null then null else coalesce(m.text, '') end as text
from documents d left join made m using (doc_id)
"""
