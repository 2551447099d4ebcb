"""Sharding by a hierarchical weighted hash tree.

The leaves of a tree of regions, racks and shards have weights. A leaf's draw
for a key is an exponential variable of its weight's rate, taken from a hash
of key and leaf alone. A rack's draw is the least of its shards' and a
region's the least of its racks', which is an exponential variable of the
rate of all the weight below it. A key descends to the region, rack and shard
of least draw. Draws of leaves don't depend on each other, so a change of
weights moves keys only into, or out of, the subtrees whose weights changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import table, text_bytes


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 3, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards 0, 1, ... in racks and regions filled in turn; weight 1 unless given. A weight of 0 closes a shard."""
    rack = lambda s: s // shards_per_rack
    return [Leaf(rack(s) // racks_per_region, rack(s), s, (weights or {}).get(s, 1.0)) for s in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """-ln(u) / weight, u in (0, 1] from 48 bits of md5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{leaf.shard}"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(float(1 << 48))) / F.lit(leaf.weight)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _descend(leaves: list[Leaf], draws: Column) -> Column:
    """region, rack and shard of the least draw at each level; of equal ones the first."""
    racks: dict[int, list[int]] = {}
    regions: dict[int, list[int]] = {}
    for i, x in enumerate(leaves):
        racks.setdefault(x.rack, []).append(i)
        if x.rack not in regions.setdefault(x.region, []):
            regions[x.region].append(x.rack)
    rack_names, region_names = list(racks), list(regions)
    ints = lambda values: F.array(*(F.lit(v) for v in values))
    below = lambda low, groups: F.array(*(F.array_min(F.array(*(low[i] for i in g))) for g in groups))
    least = lambda low, names, members: F.reduce(members, F.struct(F.lit(float("inf")).alias("low"), F.lit(-1).alias("child")), lambda best, i: F.when(low[i] < best["low"], F.struct(low[i].alias("low"), i.alias("child"))).otherwise(best))["child"]

    def of_racks(rack_low: Column) -> Column:
        def of_regions(region_low: Column) -> Column:
            region = least(region_low, region_names, ints(range(len(region_names))))
            in_region = F.array(*(ints(rack_names.index(r) for r in regions[g]) for g in region_names))
            return _let(region, lambda g: _let(least(rack_low, rack_names, in_region[g]), lambda r: F.struct(ints(region_names)[g].alias("region"), ints(rack_names)[r].alias("rack"), ints([x.shard for x in leaves])[least(draws, leaves, F.array(*(ints(racks[k]) for k in rack_names))[r])].alias("shard"))))

        return _let(below(rack_low, [[rack_names.index(r) for r in regions[g]] for g in region_names]), of_regions)

    return _let(below(draws, [racks[k] for k in rack_names]), of_racks)


def assign(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard", parents: bool = False, grown: list[Leaf] | None = None) -> DataFrame:
    """``df`` with the shard of each row's key, an int, with ``parents`` also region and rack, and with ``grown`` also that in another tree, ``grown_shard``.

    A null key counts as the empty text. Equal keys go together. Nothing is
    shuffled and the work for a row is one hash for each leaf; leaves that both
    trees have with the same weight are hashed once. An inner node's draw is
    the least of its leaves', so a descent ends at the least draw of all
    whatever the levels between: that is what confines a change of weight to
    moves into or out of its own subtree.
    """
    trees = [[x for x in t if x.weight > 0] for t in ((leaves, grown) if grown else (leaves,))]
    if not all(trees):
        raise ValueError("no shard has any weight")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    drawn = {(x.shard, x.weight): x for t in trees for x in t}
    at = {k: i for i, k in enumerate(drawn)}
    descend = lambda t, draws: _let(F.array(*(draws[at[x.shard, x.weight]] for x in t)), lambda own: _descend(t, own))
    found = _let(F.array(*(_draw(text, x) for x in drawn.values())), lambda draws: F.struct(*(descend(t, draws).alias(name) for t, name in zip(trees, ("own", "grown"), strict=False))))
    df = df.withColumn("__found", found)
    names = {out: "own.shard"} | ({"region": "own.region", "rack": "own.rack"} if parents else {}) | ({"grown_shard": "grown.shard"} if grown else {})
    return df.withColumns({name: F.col(f"__found.{field}") for name, field in names.items()}).drop("__found")


def slots(df: DataFrame, shard: str, order: list[str], cells: int = 256) -> DataFrame:
    """``df`` with ``slot``, gapless from 0 in each shard.

    A shard may hold any share of all rows, so it is cut into ``cells`` by a
    hash of the first order column. Rows are numbered inside a cell, and the
    cell's start comes from the table of counts, which has at most shards
    times cells rows.
    """
    key = F.coalesce(F.col(order[0]).cast("string"), F.lit(""))
    df = df.withColumn("__cell", (F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % cells).cast("int"))
    counts = df.groupBy(shard, "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(*order))
    return df.withColumn("__in", inside).join(F.broadcast(starts), [shard, "__cell"]).withColumn("slot", (F.col("__start") + F.col("__in") - 1).cast("long")).drop("__cell", "__in", "__start")


def shard_documents(docs: DataFrame, shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs(doc_id, text)``.

    The law is ``key``: doc_id and the tree decide. grown_shard is the shard
    with one more in the tree. A null text has no bytes, size 8 and crc 0, like
    an empty one; texts of any length are measured whole. Rows with the same
    doc_id, or without one, go to the same shard and each has its own slot,
    ordered by crc and size. Other columns are left out; an empty table gives
    no row.
    """
    rows = docs.select("doc_id", (text_bytes() + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(rows, "doc_id", tree(shards, weights=weights), grown=tree(shards + 1, weights=weights))
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql_shard(shards: int) -> str:
    """The leaf of least draw: a tree's descent ends there, whatever its levels."""
    draws = ", ".join(f"-ln((('0x' || substr(md5(k || '|{s}'), 1, 12))::BIGINT + 1) / {float(1 << 48)})" for s in range(shards))
    return f"(list_position([{draws}], list_min([{draws}])) - 1)::INTEGER"


#: The SQL engine has no crc32: it is worked out byte by byte from the table of 256 remainders.
OP7_SQL = f"""
WITH t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, coalesce(doc_id::VARCHAR, '') AS k, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, size, k, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM d, t),
s AS (SELECT *, {_sql_shard(24)} AS shard, {_sql_shard(25)} AS grown_shard FROM c)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 4))::INTEGER % 256, doc_id, crc, size) - 1 AS slot, grown_shard FROM s
"""
