"""Hierarchical weighted hash tree: descend region, rack and shard by weighted hash draws.

At each level every child of the chosen node draws ``-ln(u) / weight`` with ``u`` a hash of the key and
the child's name, and the smallest draw wins.  A draw depends on nothing but key, child and that child's
weight, so a changed weight moves rows only to or from that child and only below the parent it hangs
from.  ``grown`` adds shards as subtrees of their own at the root: a larger tree takes rows only into
the new shard and moves none among the old ones.

Cases: a null key is a key like any other (all its rows share a shard); equal keys share a shard whatever
their texts; a very long text counts all its bytes and stays out of the shuffle; a null text counts 0 bytes and has the crc32 of nothing, 0; an empty table gives no rows; other
columns of the input are kept, but for those that this adds, which replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recollex.session import table

#: Slots are counted by shard and this many key buckets, so that no task orders a whole shard.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has a shard number.  The weight is what its parent's draw sees."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())


def tree(regions: int, racks: int, shards: int) -> Node:
    """An even tree; shards are numbered from 0 in order."""
    made, n = [], 0
    for g in range(regions):
        rows = []
        for r in range(racks):
            leaves = tuple(Node(f"g{g}.r{r}.s{s}", 1.0, n + s) for s in range(shards))
            n += shards
            rows.append(Node(f"g{g}.r{r}", float(shards), None, leaves))
        made.append(Node(f"g{g}", float(racks * shards), None, tuple(rows)))
    return Node("root", float(n), None, tuple(made))


def leaves(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, alone in a region of its own."""
    n = max(leaves(root)) + 1
    leaf = Node(f"g+{n}.r0.s0", weight, n)
    region = Node(f"g+{n}", weight, None, (Node(f"g+{n}.r0", weight, None, (leaf,)),))
    return Node(root.name, root.weight + weight, None, (*root.children, region))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """``-ln(u) / weight``, u from the first 52 bits of an md5 that any engine can repeat; null for no name."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("@"), name))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def node_draw(key: Column, node: Node) -> Column:
    return draw(key, F.lit(node.name), F.lit(node.weight))


def descend(df: DataFrame, key: str, root: Node, out: str = "shard") -> DataFrame:
    """Adds the shard of each row: one step a level, and in a step draws only for the children of the node that the row is at."""
    level, df = [root], df.withColumn("_at", F.lit(0))
    while any(n.children for n in level):
        below = [list(n.children) or [n] for n in level]
        width, start = max(map(len, below)), 0
        rows = []
        for children in below:
            rows.append([(c.name, c.weight, start + k) for k, c in enumerate(children)] + [(None, None, None)] * (width - len(children)))
            start += len(children)

        def column(part: int, kind: str, k: int, rows: list = rows) -> Column:
            return F.get(F.get(F.array(*[F.array(*[F.lit(x[part]).cast(kind) for x in r]) for r in rows]), F.col("_at")), F.lit(k))

        won = column(2, "int", 0)
        if width > 1:
            drawn = [F.coalesce(draw(F.col(key), column(0, "string", k), column(1, "double", k)), F.lit(float("inf"))) for k in range(width)]
            won = F.least(*[F.struct(d.alias("d"), F.lit(k).alias("k"), column(2, "int", k).alias("n")) for k, d in enumerate(drawn)])["n"]
        df = df.withColumn("_at", won)
        level = [c for children in below for c in children]
    # never null, which spares joins on it a filter that would compute it twice
    return df.withColumn(out, F.coalesce(F.get(F.array(*[F.lit(n.shard) for n in level]), F.col("_at")), F.lit(-1)).cast("int")).drop("_at")


def assign(df: DataFrame, root: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size, text_crc32, shard, grown_shard (the shard in the tree with one more)."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = df.withColumns({"size": F.octet_length(body).cast("long") + 8, "text_crc32": F.crc32(F.encode(body, "UTF-8"))})
    return descend(sized, key, root).withColumn("grown_shard", _grown_shard(F.col(key), root))


def _grown_shard(key: Column, root: Node) -> Column:
    """The new region's draw against the least of the old regions'; else the old shard."""
    new = grown(root).children[-1]
    old = [node_draw(key, c) for c in root.children]
    return F.when(node_draw(key, new) < (F.least(*old) if len(old) > 1 else old[0]), F.lit(leaves(new)[0])).otherwise(F.col("shard")).cast("int")


def slots(df: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Adds slot: gapless from 0 within each shard, by key bucket and then ``order``.

    Offsets come from counts of shard and bucket (at most SLOT_BUCKETS rows a shard), so that the rows
    themselves are only ever ordered within a bucket.  Rows equal in every ordering column are alike and
    take their slots in any order.
    """
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    bucketed = df.withColumn("_bucket", F.coalesce(F.pmod(F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint"), F.lit(SLOT_BUCKETS)), F.lit(0)).cast("int"))
    counts = bucketed.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    ranked = bucketed.withColumn("_rank", rank)
    joined = ranked.join(offsets, (ranked[shard] == offsets["_s"]) & (ranked["_bucket"] == offsets["_b"]))
    return joined.withColumn("slot", F.col("_before") + F.col("_rank")).drop("_bucket", "_s", "_b", "_before", "_rank")


#: 2 regions of 3 racks of 4 shards.
PRODUCTION = tree(2, 3, 4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents").select("doc_id", "text"), PRODUCTION).drop("text")
    placed = slots(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(node: Node) -> str:
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '@{node.name}'), 1, 13))::bigint + 0.5) / {1 << 52}) / {node.weight}"


def _shard_sql(node: Node) -> str:
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _shard_sql(node.children[0])
    draws = ", ".join(_draw_sql(c) for c in node.children)
    return f"case list_position([{draws}], list_min([{draws}])) " + " ".join(f"when {i + 1} then {_shard_sql(c)}" for i, c in enumerate(node.children)) + " end"


_NEW = grown(PRODUCTION).children[-1]
OP2_SQL = f"""
with crc_table as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]), lambda a, x: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as t),
bytes as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as b from documents),
sized as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from bytes, crc_table),
placed as (select *, {_shard_sql(PRODUCTION)} as shard, {_draw_sql(_NEW)} < least({", ".join(_draw_sql(c) for c in PRODUCTION.children)}) as moves, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, 'null'), text_crc32, size)), 1, 8))::bigint % {SLOT_BUCKETS} as bucket from sized)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by bucket, doc_id, text_crc32, size) - 1 as slot, case when moves then {leaves(_NEW)[0]} else shard end as grown_shard from placed
"""
