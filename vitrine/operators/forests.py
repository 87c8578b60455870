"""Random forests of regression trees, grown where they are asked.

As in the library's forest, values are put into at most 32 bins between thresholds from a sample of about 10,000 rows, each tree has its
own Poisson draw of every row, and a node is divided by the cut with the largest fall of variance among a third of the features. A tree
sees a row only by its bins, so rows with equal bins are one cell with a count and a sum for each tree. Cells are dealt to tasks by tree
and, where a tree may have more than ``CELLS`` of them, by the node that its first levels, found over all rows, lead to. A task grows the
nodes below with the asked cells beside them. No tree is gathered on the driver or sent out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# The functions below travel to the workers with each job, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature and the bits of one; rows that thresholds are taken from.
BINS, BITS, SAMPLE = 32, 5, 10_000
#: Features in one whole number, cells that one task may hold of a node, rows that are drawn at once.
PACKED, CELLS, CHUNK = 12, 1 << 18, 1 << 18
#: Least fall of variance of a cut, where the target has variance 1, and how much larger a later cut's must be: the rest is rounding, which
#: differs with the order in which sums arrive.
LEAST, NEAR = 1e-14, 1 + 1e-9


def thresholds(values: np.ndarray, most: int = BINS) -> list[float]:
    """Up to ``most`` - 1 numbers between the values, with about as many values between one and the next."""
    seen, counts = np.unique(values, return_counts=True)
    middle = (seen[1:] + seen[:-1]) / 2
    if len(middle) < most:
        return middle.tolist()
    stride, found, target = len(values) / most, [], len(values) / most
    upto = np.cumsum(counts)
    for i in range(len(middle)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            found.append(float(middle[i]))
            target += stride
    return found[: most - 1]


def _keys(values: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """The bins of rows, twelve features to a whole number."""
    out = np.zeros((len(values), -(-len(cuts) // PACKED)), np.int64)
    for f, at in enumerate(cuts):
        out[:, f // PACKED] |= np.searchsorted(np.array(at), values[:, f]) << BITS * (f % PACKED)
    return out


def cell_columns(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> dict[str, Column]:
    """The numbers of ``_keys`` as columns."""
    def packed(at):
        return F.pandas_udf(lambda *values: pd.Series(_keys(np.stack(values, axis=1), at)[:, 0]), "long")

    parts = [(features[i:i + PACKED], cuts[i:i + PACKED]) for i in range(0, len(features), PACKED)]
    return {f"_cell{i}": packed(at)(*[F.col(f).cast("double") for f in some]) for i, (some, at) in enumerate(parts)}


def _numbers(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1)


def _bins(keys: np.ndarray, features: int) -> np.ndarray:
    return np.stack([keys[:, f // PACKED] >> BITS * (f % PACKED) & BINS - 1 for f in range(features)], axis=1)


def _offered(seed: int, tree: int, nodes: np.ndarray, features: int, some: int) -> np.ndarray:
    """Which features a node may be divided by: a function of seed, tree and node, so that it does not matter where the node is grown."""
    x = nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
    for salt in (seed, tree):
        x = (x ^ np.uint64(salt & 0xFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.argsort(axis=1, kind="stable").argsort(axis=1) < some


def _cuts(at: np.ndarray, bins: np.ndarray, n: np.ndarray, rest: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one feature the best cut of each node that it can divide: nodes, falls of variance, and last bins on the left.

    ``at`` is the node of a cell and ``rest`` its sum less what the mean of the node gives; ``total`` counts the rows of a node.
    """
    key = at * BINS + bins
    order = key.argsort(kind="stable")
    key, upto_n, upto_s = key[order], np.concatenate([[0.0], n[order].cumsum()]), np.concatenate([[0.0], rest[order].cumsum()])
    node = key // BINS
    end = np.flatnonzero((key[1:] != key[:-1]) & (node[1:] == node[:-1]))
    if not len(end):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    inside = node[end]
    start = np.searchsorted(node, inside)
    left, whole, fall = upto_n[end + 1] - upto_n[start], total[inside], upto_s[end + 1] - upto_s[start]
    gain = fall * fall * (1 / left + 1 / (whole - left)) / whole
    first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    most = np.maximum.reduceat(gain, first)
    best = np.flatnonzero(gain * NEAR >= np.repeat(most, np.diff(np.concatenate([first, [len(gain)]]))))
    nodes, place = np.unique(inside[best], return_index=True)
    return nodes, most, key[end[best[place]]] % BINS


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray, asked: np.ndarray, tree: int, node: int, seed: int, depth: int, some: int) -> np.ndarray:
    """What the tree below ``node`` says of the asked cells, all nodes of a level at once; nodes that nothing is asked of are not divided.

    Nodes are numbered from the root, 1: the children of i are 2 i and 2 i + 1.
    """
    out, asks = np.empty(len(asked)), np.arange(len(asked))
    at, ask_at, nodes = np.zeros(len(bins), np.int64), np.zeros(len(asked), np.int64), np.array([node])
    for level in range(node.bit_length() - 1, depth + 1):
        total = np.bincount(at, n, len(nodes))
        mean = np.bincount(at, s, len(nodes)) / total
        out[asks] = mean[ask_at]
        if level == depth:
            break
        rest, offered = s - n * mean[at], _offered(seed, tree, nodes, bins.shape[1], some)
        gain, feature, cut = np.full(len(nodes), LEAST), np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        for f in range(bins.shape[1]):
            mine = np.flatnonzero(offered[at, f])
            where, most, last = _cuts(at[mine], bins[mine, f], n[mine], rest[mine], total)
            better = most > gain[where] * NEAR
            where = where[better]
            gain[where], feature[where], cut[where] = most[better], f, last[better]
        on = feature[ask_at] >= 0
        asks, ask_at = asks[on], ask_at[on]
        if not len(asks):
            break
        ask_at = 2 * ask_at + (asked[asks, feature[ask_at]] > cut[ask_at])
        child = 2 * at + (bins[np.arange(len(bins)), feature[at]] > cut[at])
        below, ask_at = np.unique(ask_at, return_inverse=True)
        place = np.searchsorted(below, child).clip(max=len(below) - 1)
        held = (below[place] == child) & (feature[at] >= 0)
        bins, n, s, at = bins[held], n[held], s[held], place[held]
        nodes = 2 * nodes[below // 2] + below % 2
    return out


class Top:
    """The first levels of the trees: how their nodes are divided, and the nodes that no cut divides."""

    def __init__(self, trees: int):
        self.split: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
        self.whole: list[set[int]] = [set() for _ in range(trees)]

    def node(self, tree: int, bins: np.ndarray) -> np.ndarray:
        node = np.ones(len(bins), np.int64)
        if not self.split[tree]:
            return node
        known = np.array(sorted(self.split[tree]))
        feature, cut = np.array([self.split[tree][i] for i in known.tolist()]).T
        going = np.arange(len(bins))
        while len(going):
            place = np.searchsorted(known, node[going]).clip(max=len(known) - 1)
            on = known[place] == node[going]
            going, place = going[on], place[on]
            node[going] = 2 * node[going] + (bins[going, feature[place]] > cut[place])
        return node


def _drawn(features: Sequence[str], cuts: Sequence[Sequence[float]], trees: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """Chunks of a task's rows as cells: keys, and by tree the count and sum of the rows drawn. A task draws the same whenever it runs."""
    def chunks(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield pa.Table.from_batches(held), rng
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held), rng

    def run(batches):
        for table, rng in chunks(batches):
            key, y, draw = _keys(_numbers(table, features), cuts), table.column("_y").to_numpy(), rng.poisson(1.0, (table.num_rows, trees))
            order = np.lexsort(key.T)
            key, y, draw = key[order], y[order], draw[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            cell = new.cumsum() - 1
            yield key[new], [(np.bincount(cell, draw[:, t]), np.bincount(cell, draw[:, t] * y)) for t in range(trees)]
    return run


def _levels(rows: DataFrame, drawn: Callable, ranges: Sequence[int], n: int, trees: int, seed: int, depth: int, some: int) -> tuple[Top, int]:
    """Divide nodes over all rows, a level a pass, until one task can hold the cells of each. Also the number of nodes at the end."""
    top, features = Top(trees), len(ranges)
    boxes = {(t, 1): tuple((0, r - 1) for r in ranges) for t in range(trees)}
    large = lambda rows, box: min(rows, math.prod(high - low + 1 for low, high in box)) > CELLS
    going = {i: box for i, box in boxes.items() if large(n, box)}
    ended = trees - len(going)
    for _ in range(depth):
        if not going:
            break
        open_nodes = [np.array(sorted(i for t, i in going if t == tree), np.int64) for tree in range(trees)]

        def counted(batches):
            for key, sums in drawn(batches):
                bins = _bins(key, features)
                for t, (count, total) in enumerate(sums):
                    node = top.node(t, bins)
                    mine = np.flatnonzero(np.isin(node, open_nodes[t]) & (count > 0))
                    for f in range(features) if len(mine) else ():
                        found, at = np.unique(node[mine] * BINS + bins[mine, f], return_inverse=True)
                        yield pa.RecordBatch.from_pydict({"_tree": np.full(len(found), t), "_node": found // BINS, "_feature": np.full(len(found), f), "_bin": found % BINS,
                                                          "_n": np.bincount(at, count[mine], len(found)), "_s": np.bincount(at, total[mine], len(found))})

        def divided(table):
            t, node = table.column("_tree")[0].as_py(), table.column("_node")[0].as_py()
            feature, bins, count, total = (table.column(c).to_numpy() for c in ("_feature", "_bin", "_n", "_s"))
            offered, best = _offered(seed, t, np.array([node]), features, some)[0], (LEAST, -1, 0, 0.0, 0.0)
            whole = count[feature == 0].sum()
            mean = total[feature == 0].sum() / whole
            for f in np.flatnonzero(offered).tolist():
                mine = feature == f
                _, most, last = _cuts(np.zeros(mine.sum(), np.int64), bins[mine], count[mine], (total - count * mean)[mine], np.array([whole]))
                if len(most) and most[0] > best[0] * NEAR:
                    left = count[mine][bins[mine] <= last[0]].sum()
                    best = (most[0], f, int(last[0]), left, whole - left)
            return pa.table({"_tree": [t], "_node": [node], "_feature": [best[1]], "_bin": [best[2]], "_left": [float(best[3])], "_right": [float(best[4])]})

        sums = rows.mapInArrow(counted, "_tree long, _node long, _feature long, _bin long, _n double, _s double")
        sums = sums.groupBy("_tree", "_node", "_feature", "_bin").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        found = sums.groupBy("_tree", "_node").applyInArrow(divided, "_tree long, _node long, _feature long, _bin long, _left double, _right double").collect()
        boxes, going = going, {}
        for r in found:
            t, node, f = r["_tree"], r["_node"], r["_feature"]
            if f < 0:
                top.whole[t].add(node)
                ended += 1
                continue
            top.split[t][node] = (f, r["_bin"])
            box = list(boxes[t, node])
            low, high = box[f]
            for child, part, count in ((2 * node, (low, r["_bin"]), r["_left"]), (2 * node + 1, (r["_bin"] + 1, high), r["_right"])):
                below = tuple([*box[:f], part, *box[f + 1:]])
                if large(count, below):
                    going[t, child] = below
                else:
                    ended += 1
    for t, node in going:
        top.whole[t].add(node)
    return top, ended + len(going)


def predicted(known: DataFrame, asked: DataFrame, features: Sequence[str], target: str, n: int, trees: int, depth: int, seed: int, centre: float, scale: float) -> tuple[DataFrame, dict[str, Column]]:
    """The mean of the trees' values for every cell with an asked row, and the columns that give the cell of a row.

    ``known`` has ``n`` rows with the features and ``target`` and must give the same rows in the same partitions whenever it is read;
    ``centre`` and ``scale`` are about the mean and deviation of the target.
    """
    rows = known.select(*[F.col(f).cast("double").alias(f) for f in features], ((F.col(target) - F.lit(centre)) / F.lit(scale)).alias("_y"))
    sample = (rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed)).select(*features).toArrow()
    cuts = [thresholds(sample.column(f).to_numpy(), min(BINS, max(n, 2))) for f in features]
    cells = cell_columns(features, cuts)
    keys, width, some = list(cells), len(features), len(features) if trees == 1 else math.ceil(len(features) / 3)
    drawn = _drawn(features, cuts, trees, seed)
    top, groups = _levels(rows, drawn, [len(c) + 1 for c in cuts], n, trees, seed, depth, some)

    def counted(batches):
        for key, sums in drawn(batches):
            bins = _bins(key, width)
            for t, (count, total) in enumerate(sums):
                mine = np.flatnonzero(count)
                node, held = top.node(t, bins[mine]), key[mine]
                held[np.isin(node, list(top.whole[t]))] = 0
                yield pa.RecordBatch.from_pydict({"_tree": np.full(len(mine), t), "_node": node, **dict(zip(keys, held.T, strict=True)), "_n": count[mine], "_s": total[mine]})

    def placed(batches):
        for batch in batches:
            key = _numbers(batch, keys)
            bins = _bins(key, width)
            for t in range(trees):
                yield pa.RecordBatch.from_pydict({"_tree": np.full(len(key), t), "_node": top.node(t, bins), **dict(zip(keys, key.T, strict=True))})

    def answered(cell, query):
        said = np.empty(0)
        if cell.num_rows and query.num_rows:
            said = grow(_bins(_numbers(cell, keys), width), cell.column("_n").to_numpy(), cell.column("_s").to_numpy(), _bins(_numbers(query, keys), width),
                        cell.column("_tree")[0].as_py(), cell.column("_node")[0].as_py(), seed, depth, some)
        return pa.table({**{k: query.column(k).slice(0, len(said)) for k in keys}, "_said": said})

    whole, kinds = ", ".join(f"{k} long" for k in keys), ["_tree", "_node"]
    tasks = 2 * min(groups, 2048)
    learnt = rows.mapInArrow(counted, f"_tree long, _node long, {whole}, _n double, _s double").groupBy(*kinds, *keys).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    queries = asked.select(*[c.alias(k) for k, c in cells.items()]).distinct().mapInArrow(placed, f"_tree long, _node long, {whole}")
    beside = learnt.repartition(tasks, *kinds).groupBy(*kinds).cogroup(queries.repartition(tasks, *kinds).groupBy(*kinds))
    said = beside.applyInArrow(answered, f"{whole}, _said double")
    return said.groupBy(*keys).agg((F.avg("_said") * F.lit(scale) + F.lit(centre)).alias("_guess")), cells
