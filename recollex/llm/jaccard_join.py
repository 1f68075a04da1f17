"""Set-similarity join on word shingles by grouped prefixes, exact, to connected components.

1.  Each text becomes the set of its shingle hashes.  Documents with equal sets are one *set*, named by its
    smallest doc_id, and go no further than this.
2.  All sets order their tokens alike: first the hashes below a fixed part of the hash space (the sample), rarest
    first, then the others by hash.  Two sets that reach the threshold share a token among the first
    ``n - ceil(t n) + 1`` of either (the prefix).  Counting only the sample makes the count of tokens cheap, and
    as unique tokens come first, a set with as many unique sampled tokens as its prefix is long has no partner.
3.  Sets of one size and one prefix are a *group*.  Groups are posted under each token of their prefix and their band of
    sizes; what shares a posting may be linked.
4.  Rounds of stars: the groups of a posting are compared with one of them, members with the first of their group, and
    verified links join sets to components.  A posting all in one component needs no more; so thousands of near copies of
    one text cost some pairs each and never all pairs among them.
5.  What is left open is joined exactly: pairs of groups under one posting and of different components, filtered by size
    and by the places of the token in both prefixes, are expanded to their members.  A bitmap of each set (a bit for about
    every token, turned over by each token that falls on it) differs in no more bits than the sets differ in tokens, which
    rules out nearly all pairs of members that are not linked; every other pair is verified.
6.  Links become components.

A pair is verified by the common tokens of both whole sets, read again from their documents.  Nothing chains groups
together before their links are verified, so the work grows with the pairs that pass the filters.

Words are runs of other than ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has one
shingle of all its words.

Cases: a null, empty or blank text has the empty set and is linked with nothing; a null doc_id is linked with
nothing and has no component; repeated doc_ids are one document in two states, both of the same component if
linked; very long texts are sets like others; an empty table gives no rows; other columns of the
documents are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from recollex.llm._shingles import shingle_hashes
from recollex.operators.components import connected_components
from recollex.session import small_batches, table, written

#: Rounds of stars go on, at most MOST_ROUNDS of them, while the pairs left open are more than so many for each posted group
#: and each round takes a tenth of them or more.
OPEN_PAIRS, MOST_ROUNDS, HELPFUL = 4, 12, 0.9
#: Postings of a unit that are known to its later ones; a pair whose first common posting is not among them is made more than once.
KNOWN = 64
#: The sample is so large that a set of SURE_FROM tokens has, but for three standard deviations, as many tokens in
#: it as its prefix is long: sets without partners then fill their prefix with unique tokens and drop out.
SURE_FROM = 100
#: Up to so many sets (16 bytes each) the list of those to verify is broadcast; beyond, it is joined by shuffle.
BROADCAST_SETS = 1_000_000

SETS = "doc_id long, s1 long, s2 long, n int, tokens array<long>"
_SIGN = np.uint64(1 << 63)


def least_overlap(n: int | np.ndarray, num: int, den: int):
    """Least overlap with any set that a set of ``n`` tokens needs to reach num/den."""
    return -(-n * num // den)


def token_set(text: str | None, size: int) -> np.ndarray:
    return shingle_hashes((text or "").encode("utf-8").lower().split(), size)


def signed(tokens: np.ndarray) -> np.ndarray:
    """The same order in signed numbers."""
    return (tokens ^ _SIGN).view(np.int64)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _limit(num: int, den: int) -> int:
    """The end of the sample in the space of hashes: f with ``f - 3 * sqrt(f / SURE_FROM) = 1 - num/den``."""
    side = 3 / SURE_FROM**0.5
    f = ((side + (side * side + 4 * (den - num) / den) ** 0.5) / 2) ** 2
    return min((1 << 64) - 1, int((1 << 64) * f))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sets_of(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, s1, s2, n, tokens): signature, size and sample (at least the prefix) of each document's set."""
    limit = np.uint64(_limit(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sizes, lists = [], [], []
            for v in batch.column("text"):
                s = token_set(v.as_py(), size)
                prefix = len(s) - least_overlap(len(s), num, den) + 1 if len(s) else 0
                marks.append(signature(s))
                sizes.append(len(s))
                lists.append(signed(s[: max(int(np.searchsorted(s, limit)), prefix)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(sizes, pa.int32()), _lists(lists)], names=["doc_id", "s1", "s2", "n", "tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def _prefixes(distinct: DataFrame, num: int, den: int) -> DataFrame:
    """(name, n, prefix, unique, before): the shared tokens in the prefix of each set that may have a partner, how many tokens
    of the prefix are unique, and how many tokens precede the first shared one at least."""
    limit = int(signed(np.array([_limit(num, den)], dtype=np.uint64))[0])
    each = distinct.select("name", F.explode("tokens").alias("token"))
    shared = each.withColumn("df", F.count("*").over(W.partitionBy("token"))).filter("df > 1")
    token = F.struct((F.col("token") >= limit).alias("late"), F.when(F.col("token") < limit, F.col("df")).otherwise(0).alias("df"), "token")
    lists = shared.groupBy("name").agg(F.sort_array(F.collect_list(token)).alias("shared"))  # at most a set's sample
    p = F.expr(f"cast(n - (cast(n as bigint) * {num} + {den - 1}) div {den} + 1 as int)")
    sizes = distinct.select("name", "n", p.alias("p"), F.size(F.filter("tokens", lambda t: t < limit)).alias("sampled"))
    early = F.size(F.filter("shared", lambda t: ~t["late"]))
    # unique sampled tokens fill the prefix first, then shared sampled ones, then (if there is room) the later ones
    room = F.col("p") - (F.col("sampled") - early)
    chosen = F.when(F.col("sampled") >= F.col("p"), F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)))).otherwise(F.col("shared"))
    met = lists.join(sizes, "name").select("name", "n", F.transform(chosen, lambda t: t["token"]).alias("prefix"), (F.col("p") - F.size(chosen)).alias("unique"), (F.col("sampled") - early).alias("before"))
    return met.filter(F.size("prefix") > 0)


def _posted(prefixes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """members(name, group) and posted(key, group, n, at): each group under the tokens of its prefix, where others are too."""
    whole = F.col("unique") == 0  # a unique token makes a prefix that no other set has
    keyed = prefixes.select("name", "n", "prefix", "before", F.when(whole, F.xxhash64("prefix")).otherwise(F.col("name")).alias("key"), whole.alias("whole"))
    groups = keyed.groupBy("n", "key", "whole").agg(F.min("name").alias("group"), F.max("name").alias("last"), F.first("prefix").alias("prefix"), F.min("before").alias("before"))
    band = F.col("n").cast("long") if num == den else F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9)
    each = groups.select("group", "last", F.col("n").cast("long").alias("n"), band.alias("b"), "before", F.posexplode("prefix").alias("j", "token"))
    each = each.select("group", "last", "n", (F.col("before") + F.col("j")).alias("at"), "token", F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("band"))
    each = written(each.select(F.xxhash64("token", "band").alias("token"), "group", "last", "n", "at"), "posted")
    # tokens that the same groups have are one posting, in which a group stands at its earliest place
    mark = F.xxhash64("group")
    alike = each.groupBy("token").agg(F.min("group").alias("_low"), F.max("last").alias("_high"), F.bit_xor(mark).alias("_x"), F.sum(F.shiftright(mark, 20)).alias("_s")).filter("_low < _high")
    keyed_tokens = each.join(alike.select("token", F.xxhash64("_low", "_high", "_x", "_s").alias("key")), "token")
    posted = written(keyed_tokens.groupBy("key", "group").agg(F.min("n").alias("n"), F.min("at").alias("at")), "posted-together")
    members = keyed.join(groups.select("n", "key", "whole", "group"), ["n", "key", "whole"]).select("name", "group")
    return written(members.join(posted.select("group").distinct(), "group", "left_semi").select("name", "group"), "members"), posted


def _bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bits turned over by the tokens that fall on them, in ``words`` (a power of two) 64-bit numbers; halves folded by exclusive or are the bitmap of half as many."""
    odd = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _token_sets(docs: DataFrame, named: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(name, tokens, n, own, wide): the whole sets of the members, read again from their documents, with their bitmaps.

    own has the least power of two of 64-bit words that gives each token a bit, wide twice as many: sets of a similar size
    have bitmaps of one length in common.
    """
    todo = written(named.select("rep", "name", "s1", "s2").join(members.select("name"), "name", "left_semi"), "to-verify", few=True)
    todo = F.broadcast(todo) if todo.count() <= BROADCAST_SETS else todo
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(todo, "rep").select("name", "s1", "s2", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lists, own, wide = [], [], [], []
            for i, (a, b, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                s = token_set(v.as_py(), size)
                if signature(s) == (a, b):  # else another row with this doc_id
                    keep.append(i)
                    lists.append(signed(s))
                    wide.append(_bitmap(s, 2 << max(0, (len(s) - 1).bit_length() - 6)))
                    own.append(wide[-1][: len(wide[-1]) // 2] ^ wide[-1][len(wide[-1]) // 2 :])
            names = batch.column(0).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([names, _lists(lists), pa.array(map(len, lists), pa.int64()), _lists(own), _lists(wide)], names=["name", "tokens", "n", "own", "wide"])

    # rows with the same doc_id and text are read more than once
    return written(texts.mapInArrow(read, "name long, tokens array<long>, n long, own array<long>, wide array<long>").dropDuplicates(["name"]), "token-sets")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): the pairs(a, b) whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("name").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.filter(common * (num + den) >= (F.size("ta").cast("long") + F.size("tb")) * num).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _units(members: DataFrame, links: DataFrame) -> DataFrame:
    """(name, group, comp, unit): the component of each member by the links so far; the members of a group in one component are a unit, named by its first."""
    found = connected_components(links, "src", "dst")
    placed = members.join(found, F.col("name") == F.col("node"), "left").select("name", "group", F.coalesce("component", "name").alias("comp"))
    first = placed.groupBy("group", "comp").agg(F.min("name").alias("unit"), F.count("*").alias("size"))
    return written(placed.join(first, ["group", "comp"]).select("name", "group", "comp", "unit", "size"), "units", few=True)


def _open(posted: DataFrame, units: DataFrame) -> tuple[DataFrame, int]:
    """(key, unit, comp, size, n, at) of the postings with more than one component, and how many pairs of units they leave open."""
    heads = units.filter("name = unit").select("group", "unit", "comp", "size")
    lists = posted.join(heads, "group").select("key", "unit", "comp", "size", "n", "at")
    counts = lists.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"), F.count("*").alias("comps"))
    left = written(counts.filter("comps > 1").select("key", "m", "own"), "open-keys", few=True)
    total = left.agg(F.sum((F.col("m").cast("double") * F.col("m") - F.col("own")) / 2)).first()[0] or 0
    return written(lists.join(left.select("key"), "key", "left_semi"), "open-postings", few=True), int(total)


def _star(lists: DataFrame, units: DataFrame, turn: int) -> DataFrame:
    """(a, b): each unit with the first of its posting, another one each turn, if they differ in component."""
    mixed = F.lit((0x9E3779B97F4A7C15 * turn) % (1 << 63))
    first = lists.groupBy("key").agg(F.min(F.col("unit").bitwiseXOR(mixed)).alias("h"))
    met = lists.join(first, "key").select("unit", "comp", F.col("h").bitwiseXOR(mixed).alias("c")).filter("unit <> c").distinct()
    centres = units.filter("name = unit").select(F.col("unit").alias("c"), F.col("comp").alias("other"))
    return met.join(centres, "c").filter("comp <> other").select(*_pair("unit", "c")).distinct()


def _alike(num: int, den: int) -> Column:
    """Whether the bitmaps of a and b differ in no more bits than linked sets of their sizes n do in tokens; so if they have no length in common."""
    same, longer = F.size("own_a") == F.size("own_b"), F.size("own_a") > F.size("own_b")
    left, right = F.when(same | longer, F.col("own_a")).otherwise(F.col("wide_a")), F.when(same | ~longer, F.col("own_b")).otherwise(F.col("wide_b"))
    differ = F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, z: t + z)
    return F.coalesce(differ, F.lit(0)).cast("long") * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)


def _side(df: DataFrame, side: str, *same: str) -> DataFrame:
    return df.select(*same, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in same])


def _across(lists: DataFrame, units: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of members of units that share a posting and differ in component, but for those that sizes, places and bitmaps rule out."""
    maps = sets.select("name", "n", "own", "wide")
    # a pair is made at its first common posting: each posting of a unit has those before it (the first KNOWN of them)
    postings = lists.groupBy("unit", "comp", "size", "n").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("p"))  # at most a prefix
    each = postings.select("*", F.explode("p").alias("x")).withColumn("before", F.transform(F.filter(F.slice("p", 1, KNOWN), lambda y: y["at"] < F.col("x.at")), lambda y: y["key"]))
    lists = each.select("unit", "comp", "size", "n", "x.at", "x.key", "before").join(maps.select(F.col("name").alias("unit"), "own", "wide"), "unit")
    # the first common token of linked sets leaves room for what they must have in common
    fits = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (F.least(F.expr("n_a - at_a"), F.expr("n_b - at_b")).cast("long") * (num + den) >= F.expr("n_a + n_b") * num)
    met = _side(lists, "a", "key").join(_side(lists, "b", "key"), "key").filter((F.col("comp_a") < F.col("comp_b")) & fits & ~F.arrays_overlap("before_a", "before_b") & ((F.col("size_a") > 1) | (F.col("size_b") > 1) | _alike(num, den)))
    fewer = F.col("size_a") <= F.col("size_b")
    pairs = met.select(F.when(fewer, F.col("unit_a")).otherwise(F.col("unit_b")).alias("unit_a"), F.when(fewer, F.col("unit_b")).otherwise(F.col("unit_a")).alias("unit_b")).distinct()
    # the smaller unit is expanded first, so that the members of the larger meet the bitmaps where they are joined
    members = units.select("unit", "name").join(maps, "name")
    both = pairs.join(_side(members, "a"), "unit_a").join(_side(members, "b"), "unit_b").filter(_alike(num, den))
    return both.select(*_pair("name_a", "name_b"))


def _links(docs: DataFrame, named: DataFrame, prefixes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(src, dst): links between sets, by name, that connect all linked ones."""
    members, posted = _posted(prefixes, num, den)
    sets = _token_sets(docs, named, members, size)
    postings = posted.count()
    inside = members.filter("name <> group").select(*_pair("name", "group"))
    lone = members.select("name", "group", F.col("group").alias("comp"), F.col("group").alias("unit"))  # before any link: groups
    first = _star(posted.select("key", F.col("group").alias("unit"), F.col("group").alias("comp")), lone, 0)
    links = written(_linked(inside.union(first), sets, num, den), "links", few=True)
    before = math.inf
    for turn in range(1, MOST_ROUNDS + 1):
        units = _units(members, links)
        lists, left = _open(posted, units)
        if left == 0:
            return links
        if left <= OPEN_PAIRS * postings or left > HELPFUL * before or turn == MOST_ROUNDS:
            break
        before = left
        links = links.union(written(_linked(_star(lists, units, turn), sets, num, den), "links", few=True))
    return links.union(written(_linked(_across(lists, units, sets, num, den), sets, num, den), "links", few=True))


def _named(distinct: DataFrame) -> DataFrame:
    """Adds name: rep, but if a doc_id occurs with several texts, and so is rep of several sets, a negative number of their own for all but one."""
    slim = distinct.select("rep", "s1", "s2")
    if not slim.groupBy("rep").count().filter("count > 1").head(1):
        return distinct.withColumn("name", F.col("rep"))
    first = F.row_number().over(W.partitionBy("rep").orderBy("s1", "s2")) == 1
    other = -F.lit(1 << 62) - F.pmod(F.xxhash64("s1", "s2"), F.lit(1 << 61))
    return distinct.withColumn("name", F.when(first, F.col("rep")).otherwise(other))


def components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n, s1, s2, component) for each row of ``docs``; sets are linked from a Jaccard similarity of num/den.

    component is the smallest doc_id that links reach, the row's own included.
    """
    sets = written(sets_of(docs, size, num, den), "sets")
    counted = sets.filter("n > 0 and doc_id is not null")
    one = counted.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    distinct = written(one, "distinct-sets")
    named = _named(distinct)
    prefixes = written(_prefixes(named, num, den), "prefixes")
    found = connected_components(_links(docs, named, prefixes, size, num, den))
    linked = found.join(named.select("name", "rep", "s1", "s2"), F.col("node") == F.col("name"))
    lowest = linked.groupBy("component").agg(F.min("rep").alias("_low"))  # names are not doc_ids if a doc_id is repeated
    sides = linked.join(lowest, "component").select("s1", "s2", "_low")
    every = named.select("s1", "s2", "rep").join(sides, ["s1", "s2"], "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("_low", "rep").alias("_c"))
    slim = sets.select("doc_id", "n", "s1", "s2")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return slim.join(every, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") > 0), "left").select("doc_id", "n", "s1", "s2", component.alias("component"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows without a doc_id stay.

    Of rows that share that doc_id the one whose text has the smallest hash stays.
    """
    found = components(docs, size, num, den)
    chosen = written(found.filter("doc_id = component").select(F.col("doc_id").alias("_keep")).distinct(), "kept")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_SETS else chosen
    kept = docs.join(chosen, F.col("doc_id") == F.col("_keep"), "left_semi")
    repeated = found.filter("doc_id = component").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice"))
    if repeated.head(1):
        order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        single = kept.join(repeated, F.col("doc_id") == F.col("_twice"), "left_anti")
        several = kept.join(repeated, F.col("doc_id") == F.col("_twice"), "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        kept = single.union(several)
    return kept.union(docs.filter("doc_id is null"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = components(table(spark, sf_dir, "documents"), 3, 9, 10)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


OP9_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, x from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
lowest as (select x as doc_id, min(y) as low from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(low, d.doc_id) as component_id from documents d left join sizes using (doc_id) left join lowest using (doc_id)
"""
