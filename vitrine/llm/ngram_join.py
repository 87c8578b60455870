"""Jaccard similarity join on word n-grams: a MinHash LSH forest proposes, shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import durable
from vitrine.llm.features import WordKeys, gram_keys
from vitrine.llm.grouping import components, in_blocks, tiles_of

WORDS, LEAST = 5, 0.8
TREES, LONGEST, RECALL = 16, 8, 0.999
BLOCK = 256
_AT_ONCE = 1 << 15


def prefix_length(least: float = LEAST, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """How far prefixes are shortened: the longest with which a pair of similarity ``least`` shares one in some tree with the target recall.

    Similar pairs meet with a higher chance, so ``recall`` is a bound for every pair that has to be found.
    """
    for length in range(longest, 0, -1):
        if 1 - (1 - least ** length) ** trees >= recall:
            return length
    raise ValueError("more trees are needed for this recall")


def shingles(text: str | None, known: WordKeys, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit keys of the runs of ``words`` blank-separated words; a shorter text is one run; no word, no run."""
    keys = known((text or "").split())
    return np.unique(gram_keys(keys, min(words, max(1, len(keys)))))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(1, 1 << 63, count, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def signature(keys: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over all keys."""
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(keys), _AT_ONCE):
        mixed = (keys[at:at + _AT_ONCE, None] ^ shifts) * factors
        np.minimum(out, (mixed >> np.uint64(32)).astype(np.uint32).min(0), out=out)
    return out


def with_prefixes(docs: DataFrame, text: str, trees: int, length: int, words: int) -> DataFrame:
    """Add ``_set`` (128 bits that stand for the shingle set, null if empty) and ``_prefixes``, one 64-bit key of tree and prefix a tree."""

    @F.arrow_udf("struct<_set:binary,_prefixes:array<long>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, (factors, shifts) = WordKeys(), _permutations(trees * length)
        for texts in batches:
            sets, prefixes = [], []
            for t in texts:
                keys = shingles(t.as_py(), known, words)
                sets.append(xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None)
                levels = signature(keys, factors, shifts).reshape(trees, length) if len(keys) else np.empty((0, length), np.uint32)
                prefixes.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=tree) - (1 << 63) for tree, row in enumerate(levels)])
            yield pa.StructArray.from_arrays([pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["_set", "_prefixes"])

    signed = docs.withColumn("_signed", sign(F.col(text)))
    return signed.withColumns({"_set": F.col("_signed._set"), "_prefixes": F.col("_signed._prefixes")}).drop("_signed")


def _clusters(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest row that it reaches."""
    root = np.arange(len(near))
    while True:
        new = np.where(near, root[None, :], len(near)).min(1)
        new = np.minimum(root, new)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the incidence matrix of the keys that two sets or more have, a few columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    wide = 4096
    for at in range(0, int(common.sum()), wide):
        a, b = np.searchsorted(column, [at, at + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def linked(sets: list[np.ndarray], prefixes: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """Which rows are similar enough by their whole sets, among those that shared prefixes lead to from one another.

    If there are rows of two sides, only pairs across count: those within a side have a tile of their own.
    """
    n = len(sets)
    proposed = np.zeros((n, n), bool)
    for column in prefixes.T:
        proposed |= column[:, None] == column[None, :]
    np.fill_diagonal(proposed, False)
    sizes, out = np.array([len(s) for s in sets], float), np.zeros((n, n), bool)
    root = _clusters(proposed)
    for r in np.unique(root[proposed.any(1)]):
        rows = np.flatnonzero(root == r)
        shared = _shared([sets[i] for i in rows])
        both = sizes[rows, None] + sizes[None, rows] - shared
        out[np.ix_(rows, rows)] = shared >= least * both - 1e-9
    np.fill_diagonal(out, False)
    return out & (side[:, None] != side[None, :]) if side.min() != side.max() else out


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, words: int = WORDS,
                      trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_links`` (other rows of similarity ``least`` or more), ``class_id`` (the smallest key that
    links lead to, itself included) and ``kept`` (it is that one).

    Rows with the same shingle set are one member. Members that share a prefix in a tree of the forest are candidates; prefixes are as
    long as the target recall allows. Members are laid out in blocks by group and prefix, blocks that share a prefix meet in a tile, and
    a tile compares what candidates link there by whole shingle sets, so a group of any size is spread over many tasks and no pair is
    compared twice. Tiles return counts and one link per member, never pairs.

    A null text, or one without a word, has no links and is a class of its own. Rows with the same key are one document to ``kept``; rows
    with a null key have links, and the class null if all its keys are. Other columns are ignored.
    """
    length = prefix_length(least, trees, recall=recall)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    place = F.xxhash64("_text")
    signed = durable(with_prefixes(rows, "_text", trees, length, words).select("_key", place.alias("_place"), "_set", "_prefixes"))
    whole = signed.filter("_set is not null")
    one = F.min(F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("at"), F.col("_place").alias("place")))
    members = durable(whole.groupBy("_set").agg(F.count(F.lit(1)).alias("copies"), one.alias("one"), F.first("_prefixes").alias("prefixes")))
    tries = members.select("_set", F.explode("prefixes").alias("key"))
    shared = tries.groupBy("key").agg(F.min("_set").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    met = durable(tries.join(shared, "key").select("key", "_set", "first"))
    groups = components(met, "_set", "first")
    # sorted by group, then by the keys of the first trees: what is alike lies side by side
    order = members.join(groups, F.col("_set") == F.col("node")).select("_set", "root", *[F.col("prefixes")[i].alias(f"p{i}") for i in range(min(3, trees))])
    blocks = durable(in_blocks(order, ["root", *[f"p{i}" for i in range(min(3, trees))], "_set"], block).select("_set", "block"))
    tiles = tiles_of(met.join(blocks, "_set").select("key", "block"))
    wanted = blocks.join(tiles, "block").join(members, "_set").select("_set", "block", "tiles", "copies", "prefixes", "one")
    placed = rows.withColumn("_place", place).join(wanted, F.col("_key").eqNullSafe(F.col("one.at")) & (F.col("_place") == F.col("one.place")))
    dealt = placed.select(F.explode("tiles").alias("tile"), "_set", "block", "copies", "prefixes", F.col("_text").alias("text"))
    dealt = dealt.select("tile.x", "tile.y", "_set", "block", "copies", "prefixes", "text")

    def compare(table: pa.Table) -> pa.Table:
        known, sets, seen, take = WordKeys(), [], set(), []
        for i, (name, t) in enumerate(zip(table.column("_set").to_pylist(), table.column("text"), strict=True)):
            if name not in seen:  # a row that is there twice
                seen.add(name)
                take.append(i)
                sets.append(shingles(t.as_py(), known, words))
        table = table.take(take)
        near = linked(sets, np.array(table.column("prefixes").to_pylist(), np.int64), np.array(table.column("block")), least)
        links = near @ np.array(table.column("copies"), np.int64)
        root, some = _clusters(near), np.flatnonzero(near.any(1))
        return pa.table({"_set": table.column("_set").take(some), "links": pa.array(links[some], pa.int64()), "root": table.column("_set").take(root[some])})

    found = durable(dealt.groupBy("x", "y").applyInArrow(compare, "_set binary, links long, root binary"))
    links = found.groupBy("_set").agg(F.sum("links").alias("links"))
    classes = components(found, "_set", "root")
    least_key = members.select("_set", F.col("one.at").alias("at")).join(classes, F.col("_set") == F.col("node"))
    least_key = classes.join(least_key.groupBy("root").agg(F.min("at").alias("least")), "root").select(F.col("node").alias("_set"), "least")
    judged = members.select("_set", "copies", "one.at").join(links, "_set", "left").join(least_key, "_set", "left")
    judged = judged.select("_set", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "at").alias("class_id"))
    out = signed.select("_key", "_set").join(judged, "_set", "left")
    out = out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_set").isNull(), F.col("_key")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("class_id")))
