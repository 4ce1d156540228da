"""Operator 7, sharding: a hierarchical weighted hash tree of regions, racks and shards.

A key descends from the root through region and rack to a shard. At each level every child has an exponential clock for
the key, -ln(u) / weight, with u drawn by hashing (key, the child's own path) and the weight summed over the child's
subtree; the child whose clock is earliest is taken, so each is taken with probability proportional to its weight. Only the
children of the nodes on the way are drawn, region, rack and shard one after the other.

A clock depends on nothing but the key, the child and its weight. So a change of a shard's weight changes the clocks of its
own region, rack and shard alone: rows move only into or out of these, and rows of other regions that stay there keep their
racks and shards. A weight change inside a region that leaves the region's sum as it was moves rows within it only.

One more shard (`grown`) opens a region of its own. No other clock changes then, so it takes rows only into itself (law
`key`) at any number of shards. To put it into a rack of another region later is a change of two weights and moves rows
into and out of these two regions.

Slots are gapless in each shard: rows are numbered in (part of the written table, shard) groups, after the counts of the
parts before. So a repeated row, whatever its share, is numbered by as many tasks as there are parts that hold it. Slots follow the written
table's order; shards don't depend on it.

Nulls: a null id is a key of its own; a null text has no bytes, so size 8 and the CRC of the empty string. Rows with
equal ids go to one shard by the law, in slots of their own, in any order. Only the length and the CRC of a text are kept, so a very long one
is nothing special. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm._spark import fresh, staged

SHARDS = 24
RACK_SHARDS, REGION_RACKS = 4, 3


Tree = list[list[list[int]]]


def tree(shards: int) -> Tree:
    """Regions of racks of shard numbers, filled in order."""
    racks = [list(range(i, min(i + RACK_SHARDS, shards))) for i in range(0, shards, RACK_SHARDS)]
    return [racks[i : i + REGION_RACKS] for i in range(0, len(racks), REGION_RACKS)]


def grown(regions: Tree, shard: int) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*regions, [[shard]]]


def descend(key: Column, regions: Tree, weights: dict[int, float] | None = None) -> dict[str, Column]:
    """Region, rack (in its region) and shard that a key descends to; subtrees of weight 0 get nothing."""
    weights = weights or {}

    def weight(node) -> float:
        return float(weights.get(node, 1.0)) if isinstance(node, int) else sum(map(weight, node))

    def draw(level: str, path: tuple[int, ...], children: list[tuple[int, float]]) -> Column:
        """The number of the child with the earliest clock."""

        def clock(number: int, size: float) -> Column:
            # 52 bits, so that u is exact, in (0, 1)
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *map(F.lit, path), F.lit(number)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
            return F.struct((-F.log(u) / F.lit(size)).alias("clock"), F.lit(number).alias("number"))

        some = [clock(number, size) for number, size in children if size > 0]
        return (F.least(*some) if len(some) > 1 else some[0])["number"]

    def chosen(at: Column, branches: list[tuple[int, Column]]) -> Column:
        """The branch of the node that was taken; the others aren't evaluated."""
        out = F
        for number, branch in branches:
            out = out.when(at == number, branch)
        return out

    if not weight(regions) > 0:
        raise ValueError("no shard has a weight")
    region = draw("region", (), [(r, weight(racks)) for r, racks in enumerate(regions)])
    rack = lambda at: chosen(at, [(r, draw("rack", (r,), [(k, weight(rack)) for k, rack in enumerate(racks)])) for r, racks in enumerate(regions) if weight(racks) > 0])
    leaf = lambda at, below: chosen(
        at,
        [(r, chosen(below, [(k, draw("shard", (r, k), [(s, weight(s)) for s in shards])) for k, shards in enumerate(racks) if weight(shards) > 0])) for r, racks in enumerate(regions) if weight(racks) > 0],
    )
    return {"region": region, "rack": rack, "shard": leaf}


def with_shard(rows: DataFrame, key: str, regions: Tree, weights: dict[int, float] | None, output: str) -> DataFrame:
    """The rows with `output`; a level is a projection of its own, so each draw is evaluated once."""
    region, rack = fresh(rows, "_region", "_rack")
    step = descend(F.col(key), regions, weights)
    rows = rows.withColumn(region, step["region"])
    rows = rows.withColumn(rack, step["rack"](F.col(region)))
    return rows.withColumn(output, step["shard"](F.col(region), F.col(rack))).drop(region, rack)


def shard(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight 1)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = with_shard(rows, "doc_id", tree(shards), weights, "shard")
    rows = with_shard(rows, "doc_id", grown(tree(shards), shards), weights, "grown_shard")
    placed = staged(rows.withColumn("at", F.monotonically_increasing_id()), "shards").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    bases = sizes.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at"))
    numbered = placed.withColumn("nth", nth).join(bases, ["part", "shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), "grown_shard")
