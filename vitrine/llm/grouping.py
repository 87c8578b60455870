"""Connected components, and comparing the members of groups of any size in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import durable
from vitrine.operators.ordered import numbered


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) of every node of an edge.

    Alternating large-star and small-star steps: each node links its larger neighbours, then its smaller ones, to the smallest of all.
    A step joins edges with one line per node, so a node with many edges is a skewed join side, never a collected group; every round is
    written durably. The number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, seen = durable(pairs), None
    while True:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == seen:
            break
        seen = check
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(lower.select("u", F.col("m").alias("v")).unionAll(moved).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def in_blocks(members: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``block``: members numbered along ``order``, ``size`` to a block, so that neighbours in the order share one."""
    placed = numbered(members, [F.col(c).asc() for c in order], as_name="_no")
    return placed.withColumn("block", F.floor((F.col("_no") - 1) / size).cast("long")).drop("_no")


def tiles_of(spans: DataFrame) -> DataFrame:
    """``block`` and its ``tiles`` (pairs of blocks, the smaller first) from ``key`` and ``block``: two blocks share a tile if they share a key.

    A key that spans s blocks gives s * (s + 1) / 2 tiles; most keys span one.
    """
    spans = spans.select("key", "block").distinct()
    other = spans.select("key", F.col("block").alias("second"))
    pairs = spans.join(other, "key").filter("block <= second").select(F.struct(F.col("block").alias("x"), F.col("second").alias("y")).alias("tile")).distinct()
    ends = pairs.select(F.explode(F.array_distinct(F.array("tile.x", "tile.y"))).alias("block"), "tile")
    return ends.groupBy("block").agg(F.collect_list("tile").alias("tiles"))
