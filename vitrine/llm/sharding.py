"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
#: Rows of a shard are numbered in so many parts. The totals are one line per shard and part.
PARTS = 2048


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """Shards 0 to ``shards - 1`` of weight 1, filled rack by rack and region by region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def _weight(node: Mapping | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, path: str, weight: float) -> Column:
    """A node's own draw, exponentially distributed at the rate of its weight, so the smallest of its siblings' wins in proportion.

    ``u`` is hashed from key and path alone, so a node's draw changes with its own weight and nothing else: a node that grows only pulls
    keys to itself, one that shrinks only gives keys up.
    """
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _descend(key: Column, node: Mapping | float, path: str, shard: int | None = None) -> Column:
    """The shard reached by choosing the child with the smallest draw, level by level; equal draws go to the child named first.

    A level draws for the children of the chosen node only.
    """
    if not isinstance(node, Mapping):
        return F.lit(shard)
    children = [(name, child) for name, child in node.items() if _weight(child) > 0]
    if not children:
        raise ValueError("a tree needs a shard with a positive weight")
    below = [_descend(key, child, f"{path}/{name}", name if not isinstance(child, Mapping) else None) for name, child in children]
    if len(children) == 1:
        return below[0]
    draws = F.array(*[_draw(key, f"{path}/{name}", _weight(child)) for name, child in children])
    # the draws of a level are worked out once and searched for the least
    chosen = F.get(F.transform(F.array(draws), lambda d: F.array_position(d, F.array_min(d))), F.lit(0))
    out = below[-1]
    for at in reversed(range(len(children) - 1)):
        out = F.when(chosen == at + 1, below[at]).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) of a key. Only the key and the tree decide; a null key counts as empty text."""
    return _descend(F.coalesce(key.cast("string"), F.lit("")), tree, "").cast("int")


def place(docs: DataFrame, tree: Tree, key: str = "doc_id", grown: Tree | None = None, parts: int = PARTS) -> DataFrame:
    """Add ``shard``, ``slot`` (its place in the shard, gapless from 0) and ``grown_shard`` (the shard in ``grown``, else null).

    Slots run by part, then key, so no task numbers a whole shard: a part's rows are numbered together, and one line of totals per shard
    and part tells how many rows come before. The part is a hash of the key and the row's other numbers and texts, so that rows which share
    a key are spread; rows equal in all of them stay together. Repeated rows get slots of their own, a null key counts as empty text.
    Columns of the three names are replaced, all others pass whatever their names; an empty table gives an empty result.
    """
    rest = docs.drop("shard", "slot", "grown_shard")
    plain = [F.col(c) for c, t in rest.dtypes if t in ("bigint", "int", "smallint", "tinyint", "string", "boolean", "date", "timestamp")]
    grown_shard = shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")
    rows = rest.select(F.struct(*rest.columns).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("known"), F.struct(F.lit(0), *plain).alias("order"),
                       shard_of(F.col(key), tree).alias("shard"), grown_shard.alias("grown_shard"),
                       F.pmod(F.xxhash64(F.lit("part"), F.col(key), *plain), F.lit(parts)).cast("int").alias("part"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("known", "order")) - 1
    joined = rows.withColumn("at", inside).join(totals, ["shard", "part"])
    return joined.select("row.*", "shard", "grown_shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))
