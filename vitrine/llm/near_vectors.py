"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vitrine.llm.common import bounded_sample, durable
from vitrine.llm.grouping import components, in_blocks, tiles_of

LEAST = 0.93
#: Length of neighbour lists, least trees of a starting forest (see ``trees_for``), and how many neighbours in the order of a tree a vector is compared with.
LIST, TREES, SPAN = 8, 12, 6
#: Vectors less alike than this lead nowhere and are not listed.
FLOOR = 0.5
#: Rounds after a forest or a join of components; forests at most, after which a recall below the target is warned of.
ROUNDS, TRIES = 3, 12
#: Vectors of each class of component size that an audit compares with all others, and the share of its links that a node must have found.
AUDIT, RECALL = 512, 0.999
BLOCK = 1024
_EDGE = "a long, b long, near double"


def _unit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Vectors of length 1 as bytes; null for a null, empty or zero vector, or one with a null or non-finite component."""
    for vectors in batches:
        out = []
        for v in vectors:
            x = np.array([np.nan if c is None else c for c in v.as_py()], float) if v.is_valid and len(v) else np.zeros(0)
            largest = np.abs(x).max(initial=0.0)
            if len(x) and np.isfinite(largest) and largest > 0:
                x = x / largest  # so that no square overflows or vanishes
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            else:
                out.append(None)
        yield pa.array(out, pa.binary())


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), float).reshape(len(raw), -1)


def _edges(a: list, b: list, near: list) -> pa.RecordBatch:
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
    return pa.RecordBatch.from_arrays([join(a, pa.int64()), join(b, pa.int64()), join(near, pa.float64())], ["a", "b", "near"])


def trees_for(bits: int, least: float = LEAST, recall: float = RECALL) -> int:
    """Trees in which a pair of exactly ``least`` without other neighbours meets with probability ``recall``.

    It lies on one side of each of ``bits`` planes with probability 1 - angle / pi, and then within the span in about nine of ten trees.
    """
    met = 0.9 * (1 - math.acos(least) / math.pi) ** bits
    return max(TREES, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def forest(nodes: DataFrame, seed: int, bits: int, trees: int = TREES, span: int = SPAN, floor: float = FLOOR) -> DataFrame:
    """Starting edges: every tree sorts the vectors of a group by the sides of random planes on which they lie, then along a random line;
    each vector is compared with the ``span`` next in that order. A range-partitioned sort, so a dense place is spread over tasks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column("v"))
            for wide in pa.compute.unique(size).to_pylist():
                part = batch.filter(pa.compute.equal(size, wide))
                x, rng = _matrix(part.column("v")), np.random.default_rng([seed, wide])
                for tree in range(trees):
                    planes, line = rng.normal(size=(wide // 8, bits)), rng.normal(size=wide // 8)
                    leaf = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    columns = [pa.array(np.full(len(x), tree, np.int32)), part.column("kin"), pa.array(leaf, pa.int64()), pa.array(x @ line), part.column("node"), part.column("v")]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "kin", "leaf", "line", "node", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in batches:
            a, b, near = [], [], []
            if batch.num_rows:
                tree, kin = np.array(batch.column("tree")), np.array(batch.column("kin").to_pylist(), object)
                ends = np.flatnonzero((tree[1:] != tree[:-1]) | (kin[1:] != kin[:-1])) + 1
                for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
                    ids, x = np.array(batch.column("node")[begin:end]), _matrix(batch.column("v").slice(begin, end - begin))
                    if last and last[0] == (tree[begin], kin[begin]):
                        ids, x = np.concatenate([last[1], ids]), np.concatenate([last[2], x])
                    for step in range(1, min(span, len(ids) - 1) + 1):
                        alike = np.einsum("ij,ij->i", x[step:], x[:-step])
                        good = np.flatnonzero(alike >= floor)
                        a.append(ids[step:][good])
                        b.append(ids[:-step][good])
                        near.append(alike[good])
                    last = ((tree[begin], kin[begin]), ids[-span:], x[-span:])
            yield _edges(a, b, near)

    order = ["tree", "kin", "leaf", "line", "node"]
    placed = nodes.select("kin", "node", "v").mapInArrow(place, "tree int, kin string, leaf long, line double, node long, v binary")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, _EDGE).filter("a != b")


def lists(edges: DataFrame, size: int = LIST, roots: DataFrame | None = None) -> DataFrame:
    """The ``size`` nearest of the listed neighbours of each node, in both directions: ``a``, ``b``, ``near``, ``fresh``.

    With ``roots`` (``node``, ``root``) each node has two lists, one inside its component and one (column ``out``) of other components, so
    that a crowd of near members never pushes a neighbour in another component off.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # not a union, which would work out ``edges`` twice
    both = edges.select(F.explode(ways).alias("way"), "near", "fresh").select("way.a", "way.b", "near", "fresh")
    once = both.groupBy("a", "b").agg(F.max("near").alias("near"), F.every("fresh").alias("fresh"))
    if roots is not None:
        for end in ("a", "b"):
            once = once.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        out = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        once = once.select("a", "b", "near", "fresh", out.alias("out"))
    rank = F.row_number().over(Window.partitionBy("a", *["out"] * (roots is not None)).orderBy(F.col("near").desc(), "b"))
    return durable(once.withColumn("rank", rank).filter(F.col("rank") <= size).drop("rank"))


def _joining(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The ``pairs`` (places in ``root``) that join what earlier ones have not: all of them join no more than these do."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y:
            up[x] = y
            kept.append((i, j))
    return np.array(kept, np.int64).reshape(-1, 2)


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after ``edges`` join them."""
    return components(edges.select("a", "b").unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def descend(now: DataFrame, nodes: DataFrame, tasks: int, size: int = LIST, floor: float = FLOOR, roots: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One round: around each node, its neighbours and those that list it are compared with each other, if one of the two is fresh.

    Nodes that many list are met in parts of about twice ``size``, dealt by hash, so nobody is left out and no part is large. A pair is
    proposed to a node only if it is nearer than the last of its list, the ``size`` best of a part and list at most. Pairs of ``least``
    or more that join components are proposed whatever the lists hold, except those that join what pairs of the same part joined.
    """
    listed_by = now.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).alias("parts"))
    ahead = now.select(F.col("a").alias("at"), F.lit(0).alias("part"), F.col("b").alias("node"), "fresh")
    back = now.join(listed_by, "b").select(F.col("b").alias("at"), F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"), "fresh")
    now = now if roots is not None else now.withColumn("out", F.lit(False))
    bar = lambda own: F.when(F.count_if(own) >= size, F.min(F.when(own, F.col("near")))).otherwise(F.lit(floor))
    bars = now.groupBy(F.col("a").alias("node")).agg(bar(~F.col("out")).alias("bar"), bar(F.col("out")).alias("out_bar"))
    placed = nodes.select("node", "v", F.lit(0).cast("long").alias("root"))
    if roots is not None:
        placed = nodes.select("node", "v").join(roots, "node", "left").select("node", "v", F.coalesce("root", "node").alias("root"))
    met = ahead.unionAll(back).groupBy("at", "part", "node").agg(F.max("fresh").alias("fresh"))
    met = met.join(bars, "node").join(placed, "node").withColumn("task", F.pmod(F.xxhash64("at", "part"), F.lit(tasks)))

    def around(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("part", "ascending")])
        at, part = np.array(table.column("at")), np.array(table.column("part"))
        ids, bar, out_bar, fresh, root = (np.array(table.column(c)) for c in ("node", "bar", "out_bar", "fresh", "root"))
        raw = table.column("v").to_pylist()
        ends = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1])) + 1
        a, b, near = [], [], []
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(at)], strict=True):
            if end - begin < 2 or not fresh[begin:end].any():
                continue
            x = np.frombuffer(b"".join(raw[begin:end]), float).reshape(end - begin, -1)
            alike = x @ x.T
            alike[~(fresh[begin:end, None] | fresh[None, begin:end])] = -2
            np.fill_diagonal(alike, -2)
            out, here = root[begin:end, None] != root[None, begin:end], ids[begin:end]
            picks = [_joining(np.argwhere(np.triu(out & (alike >= least))), root[begin:end])]
            for own, least_near in ((~out, bar), (out, out_bar)):
                some = np.where(own & (alike > least_near[begin:end, None]), alike, -2)
                best = np.argsort(-some, axis=1, kind="stable")[:, :size]
                row, rank = np.nonzero(np.take_along_axis(some, best, 1) > -2)
                picks.append(np.column_stack([row, best[row, rank]]))
            i, j = np.concatenate(picks).T
            a.append(here[i])
            b.append(here[j])
            near.append(alike[i, j])
        return pa.Table.from_batches([_edges(a, b, near)])

    return met.groupBy("task").applyInArrow(around, _EDGE)


def audit(nodes: DataFrame, roots: DataFrame, total: int, least: float, most: int = AUDIT, seed: int = 0) -> DataFrame:
    """Links of picked nodes, compared with all nodes: ``a``, ``b`` of each link not found, and one row per picked node, batch of others
    and ``stratum`` (``a``, ``b`` null) with the number found; ``node`` is the picked one.

    About ``most`` nodes of each stratum are picked, other ones for every ``seed``: components of at most 2 nodes, larger ones, and those
    of more than a hundredth of all ``total``. Only the picked vectors, at most twice ``most`` a stratum, go to every task.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    known = nodes.join(roots, "node", "left").select("node", "kin", "v", F.coalesce("root", "node").alias("root")).join(sizes, "root", "left")
    size = F.coalesce("size", F.lit(1))
    known = durable(known.select("node", "kin", "v", "root", F.when(size <= 2, 0).when(size <= max(2, total // 100), 1).otherwise(2).alias("stratum")))
    picked = bounded_sample(known.withColumn("pick", F.xxhash64("node", F.lit(seed))), "pick", "stratum", most).collect()
    by_kin: dict[str, tuple] = {}
    for kin in {r.kin for r in picked}:
        own = [r for r in picked if r.kin == kin]
        x = np.frombuffer(b"".join(bytes(r.v) for r in own), float).reshape(len(own), -1)
        by_kin[kin] = (*(np.array([r[c] for r in own]) for c in ("node", "root", "stratum")), x)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kin, parts = np.array(batch.column("kin").to_pylist(), object), [[np.empty(0, np.int64)] for _ in range(5)]
            for k in set(kin.tolist()) & set(by_kin):
                ids, root, stratum, x = by_kin[k]
                part = batch.take(pa.array(np.flatnonzero(kin == k)))
                own, group = np.array(part.column("node")), np.array(part.column("root"))
                i, j = np.nonzero(x @ _matrix(part.column("v")).T >= least)
                i, j = i[ids[i] != own[j]], j[ids[i] != own[j]]
                same = root[i] == group[j]
                found = np.bincount(i[same], minlength=len(ids))
                seen, i, j = np.flatnonzero(found), i[~same], j[~same]
                both = np.concatenate([i, seen])
                other = np.concatenate([own[j], np.full(len(seen), -1)])
                for out, column in zip(parts, (ids[both], other, np.concatenate([0 * i, found[seen]]), stratum[both], np.arange(len(both)) < len(i)), strict=True):
                    out.append(column)
            node, other, found, stratum, lost = map(np.concatenate, parts)
            hide = ~lost.astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64(), mask=hide), pa.array(other, pa.int64(), mask=hide), *(pa.array(c, pa.int64()) for c in (found, node, stratum))],
                                             ["a", "b", "found", "node", "stratum"])

    return known.mapInArrow(look, "a long, b long, found long, node long, stratum long")


def recall_of(seen: DataFrame) -> float:
    """The mean share of its links that an audited node has found, in the stratum where it is smallest; 1 without links.

    Each node counts once, so a crowd with many links a node does not cover up what isolated pairs have lost.
    """
    nodes = seen.groupBy("stratum", "node").agg((F.sum("found") / (F.sum("found") + F.count("a"))).alias("share"))
    return nodes.groupBy("stratum").agg(F.avg("share").alias("share")).agg(F.coalesce(F.min("share"), F.lit(1.0))).first()[0]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links`` (other rows of the same label with cosine ``least`` or more, in double
    precision), ``component_id`` (the smallest key that links lead to, itself included) and ``kept`` (it is that one).

    Equal vectors of a label are one node. A random forest gives each node a first list of neighbours; rounds of NN-descent refine the
    lists until hardly any changes. Every pair of at least ``least`` that forest or rounds meet joins components, whether or not a list
    has room for it, and each node lists the nearest of other components apart from those of its own. Whenever rounds join components,
    lists are dealt anew and rounds go on, so at the end no list of other components holds a link, nor is full of them. Members of a
    component are then compared in tiles. An audit of picked nodes against all others adds what it finds missing; while its recall is below
    the target in any class of component size, a new forest joins and other nodes are audited, ``TRIES`` times before a warning.

    Null labels, null keys, and vectors that are null, empty, zero or not finite link with nothing and are components of their own;
    vectors of different length are not compared. Repeated rows count as other rows to each other. Other columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("string").alias("_label"), F.arrow_udf("binary")(_unit)(F.col(vector).cast("array<double>")).alias("v"))
    rows = durable(rows.withColumn("kin", F.when(F.col("v").isNotNull() & F.col("_key").isNotNull(), F.concat(F.length("v").cast("string"), F.lit(":"), F.col("_label")))).drop("_label"))
    whole = rows.filter("kin is not null")
    nodes = durable(whole.groupBy("kin", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("_key").alias("least")).withColumn("node", F.xxhash64("kin", "v")))
    sizes = nodes.groupBy("kin").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    bits = min(30, max(1, math.ceil(math.log2(max(2, largest / (2 * SPAN))))))
    trees, tasks = trees_for(bits, least), max(1, total // 2000)
    now, roots = None, None
    for seed in range(TRIES):
        start = durable(forest(nodes, seed, bits, trees).withColumn("fresh", F.lit(True)))
        links = start.filter(F.col("near") >= least)
        roots = components(links) if roots is None else joined(roots, links)
        now = start if now is None else now.select("a", "b", "near", F.lit(False).alias("fresh")).unionAll(start)
        while True:
            now, strong = lists(now, roots=roots), start.limit(0).select("a", "b")
            for _ in range(ROUNDS):
                before = now.count()
                step = durable(descend(now, nodes, tasks, roots=roots, least=least))
                strong = strong.unionAll(step.filter(F.col("near") >= least).select("a", "b"))
                now = lists(now.select("a", "b", "near", F.lit(False).alias("fresh")).unionAll(step.withColumn("fresh", F.lit(True))), roots=roots)
                if now.filter("fresh").count() <= 0.001 * before:
                    break
            if now.filter(F.col("out") & (F.col("near") >= least)).isEmpty():  # a link to another component would head a list
                break
            roots = joined(roots, strong)
            now = now.select("a", "b", "near", F.lit(True).alias("fresh"))
        seen = durable(audit(nodes, roots, total, least, seed=seed))
        recall = recall_of(seen)
        lost = seen.filter("a is not null")
        if not lost.isEmpty():
            roots = joined(roots, lost)
        if recall >= RECALL:
            break
    else:
        warnings.warn(f"near-duplicate vectors: audited recall {recall:.5f} after {TRIES} forests, below {RECALL}", stacklevel=2)

    blocks = durable(in_blocks(roots, ["root", "node"], BLOCK))
    tiles = tiles_of(blocks.select(F.col("root").alias("key"), "block"))
    dealt = blocks.join(tiles, "block").join(nodes.select("node", "v", "copies", "kin"), "node").select(F.explode("tiles").alias("tile"), "node", "root", "block", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids, root, block, copies = (np.array(table.column(c)) for c in ("node", "root", "block", "copies"))
        raw, links = table.column("v").to_pylist(), np.zeros(len(ids), np.int64)
        two = block.min() != block.max()
        order = np.argsort(root, kind="stable")
        for rows_ in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            x = np.frombuffer(b"".join(raw[i] for i in rows_), float).reshape(len(rows_), -1)
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if two:
                near &= block[rows_, None] != block[None, rows_]
            links[rows_] = near @ copies[rows_]
        return pa.table({"node": table.column("node"), "links": pa.array(links, pa.int64())})

    linked = dealt.select("tile.x", "tile.y", "node", "root", "block", "copies", "v").groupBy("x", "y").applyInArrow(compare, "node long, links long")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    first = roots.join(nodes.select("node", "least"), "node")
    first = roots.join(first.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    judged = nodes.join(links, "node", "left").join(first, "node", "left")
    judged = judged.select(F.col("kin").alias("_kin"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("first"))
    out = rows.join(judged, (F.col("kin") == F.col("_kin")) & (F.col("v") == F.col("_v")), "left")
    out = out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "_key").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
