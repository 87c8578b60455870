"""Hyper-parameter search that fits many models in one pass over the data.

Rows are turned once into cached blocks of numbers: raw amounts, flags, categories and term counts. What a fold's pipeline learns from its
training rows (vocabulary, document frequencies, medians, quartiles, categories) is a small :class:`Prepared`, applied to a block inside
the task. So one scan serves all folds, vocabulary sizes and trials at once: for logistic regression it returns the loss and gradient of
every model at its next point, the driver only steps; for Gaussian naive Bayes it returns the moments of every class. Steps of logistic
regression are shaped by how the features of a sample of rows vary; where a fit ends is decided by the gradient over all rows.

A block of trials is proposed at a time by a Parzen-estimator sampler from the scores so far.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import CountVectorizerModel, SQLTransformer
from pyspark.sql import DataFrame, functions as F

from vitrine.ml import words
from vitrine.operators.ordered import exact_quantiles
from vitrine.session import spread

# The functions below travel to the workers with each job, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block; a dense block of them and of all columns is the largest thing a task holds.
BLOCK_ROWS = 1000
#: Partial sums that come to the driver as they are; more are added up on the cluster first.
FEW_PARTS = 64
# Fixed value: largest gradient entry of the mean objective at which a fit has converged.
TOLERANCE = 1e-4
#: Rows, about, whose features shape the steps of a fit, and directions kept of them.
SHAPE_ROWS, SHAPE_RANK = 4096, 128
#: Least curvature of a direction, as a share of the mean; and halvings after which a fit goes on without its shape.
_FLAT, _HALVINGS = 0.01, 5


# ---------------------------------------------------------------- what folds learn

@dataclass
class Prepared:
    """What each fold learnt from its training rows, over one numbering of columns: categories, amounts, flags, terms."""

    categories: list[tuple[str, str]] = field(default_factory=list)
    amounts: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    active: np.ndarray | None = None  # (folds, categories): has a column of its own in this fold
    center: np.ndarray | None = None  # (folds, amounts)
    scale: np.ndarray | None = None
    place: np.ndarray | None = None  # (folds, terms): place in the fold's vocabulary, most frequent first; beyond any size if not in it
    idf: np.ndarray | None = None
    folds: int = 5

    @property
    def narrow(self) -> int:
        return len(self.categories) + len(self.amounts) + len(self.flags)

    @property
    def columns(self) -> int:
        return self.narrow + len(self.terms)

    def used(self, fold: int, size: int) -> np.ndarray:
        """Which columns exist for this fold and vocabulary size."""
        out = np.ones(self.columns, bool)
        out[: len(self.categories)] = self.active[fold]
        out[self.narrow :] = self.place[fold] < size
        return out


def fold_vocabularies(rows: DataFrame, folds: int, size: int, column: str = "review_text", min_docs: int = words.MIN_DOCS,
                      max_share: float = words.MAX_SHARE) -> list[list[tuple[str, float]]]:
    """Terms and idf learnt without each fold, most frequent first, from one count of all rows.

    A term's totals per fold are counted in one shuffle; a fold's training totals are all less its own. ``size`` lines a fold reach the
    driver.
    """
    own = lambda f, what: F.sum(F.when(F.col("fold") != f, F.col(what)).otherwise(0)).alias(f"{what}{f}")
    totals = words.tallied(rows, column, "fold").groupBy("term").agg(*[own(f, what) for f in range(folds) for what in ("use", "doc")]).persist()
    try:
        documents = totals.filter("term IS NULL").first()
        out = []
        for f in range(folds):
            n = documents[f"doc{f}"] if documents else 0
            kept = totals.filter(F.col("term").isNotNull() & (F.col(f"doc{f}") >= min_docs) & (F.col(f"doc{f}") <= max_share * n))
            top = kept.orderBy(F.col(f"use{f}").desc(), "term").limit(size).select("term", F.col(f"doc{f}").alias("doc")).collect()
            out.append([(r["term"], math.log((1 + n) / (1 + r["doc"])) + 1) for r in top])
        return out
    finally:
        totals.unpersist()


def _outside(rows: DataFrame, folds: int, columns: Sequence[str]) -> DataFrame:
    """Each row once for every fold it trains (``_for``), with a few narrow columns only."""
    return rows.select(*columns, F.explode(F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("fold"))).alias("_for"))


def prepare(rows: DataFrame, folds: int, size: int, categories: Sequence[str] = (), amounts: Sequence[str] = (), flags: Sequence[str] = (),
            text: str | None = "review_text", most_categories: int = 1000, **bounds) -> Prepared:
    """Learn what every fold's pipeline needs: first category left out, medians and quartiles, vocabulary and idf."""
    out = Prepared(amounts=list(amounts), flags=list(flags), folds=folds)
    listed = []
    for c in categories:
        seen = rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.collect_set("fold").alias("folds")).limit(most_categories + 1).collect()
        if len(seen) > most_categories:
            raise ValueError(f"{c} has more than {most_categories} values")
        listed += [(c, r["value"], set(r["folds"])) for r in sorted(seen, key=lambda r: r["value"])]
    out.categories = [(c, v) for c, v, _ in listed]
    out.active = np.zeros((folds, len(listed)), bool)
    for f in range(folds):
        begun = set()
        for i, (c, _, seen) in enumerate(listed):
            if seen - {f}:
                out.active[f, i] = c in begun
                begun.add(c)
    out.center, out.scale = np.zeros((folds, len(amounts))), np.ones((folds, len(amounts)))
    if amounts:
        for r in exact_quantiles(_outside(rows, folds, amounts), list(amounts), [0.25, 0.5, 0.75], ["_for"]).collect():
            i = list(amounts).index(r["column_name"])
            out.center[r["_for"], i] = r["p50"]
            out.scale[r["_for"], i] = (r["p75"] - r["p25"]) or 1.0
    known = fold_vocabularies(rows, folds, size, text, **bounds) if text else [[] for _ in range(folds)]
    out.terms = sorted({t for terms in known for t, _ in terms})
    at = {t: i for i, t in enumerate(out.terms)}
    out.place, out.idf = np.full((folds, len(at)), np.iinfo(np.int32).max), np.zeros((folds, len(at)))
    for f, terms in enumerate(known):
        for place, (t, idf) in enumerate(terms):
            out.place[f, at[t]], out.idf[f, at[t]] = place, idf
    return out


# ---------------------------------------------------------------- blocks

_FIELDS = ("fold", "label", "narrow", "ends", "at", "count")
_TYPES = {"fold": np.int32, "label": np.float64, "narrow": np.float64, "ends": np.int64, "at": np.int32, "count": np.float64}


def blocks(rows: DataFrame, prepared: Prepared, text: str | None = "review_text", label: str = "label") -> DataFrame:
    """The rows (fold, label and the prepared columns) as blocks of packed numbers, one line each; deal, pack, cache."""
    value = lambda c: F.col(c).cast("double")
    narrow = [*[(F.col(c).cast("string").eqNullSafe(F.lit(v))).cast("double") for c, v in prepared.categories], *map(value, prepared.amounts), *map(value, prepared.flags)]
    kept = [F.col("fold").cast("int").alias("fold"), value(label).alias("label"), F.array(*narrow).cast("array<double>").alias("narrow")]
    shaped = spread(rows)
    if text and prepared.terms:
        listed = SQLTransformer(statement=words.TERMS_SQL.replace("{column}", text))
        counted = CountVectorizerModel.from_vocabulary(prepared.terms, inputCol="terms", outputCol="_counts")
        sparse = F.unwrap_udt("_counts")
        shaped = counted.transform(listed.transform(shaped)).select(*kept, sparse["indices"].alias("at"), sparse["values"].alias("count"))
    else:
        shaped = shaped.select(*kept, F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("count"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = {name: batch.column(name).slice(start, BLOCK_ROWS) for name in ("fold", "label", "narrow", "at", "count")}
                arrays = {"fold": part["fold"].to_numpy(zero_copy_only=False), "label": part["label"].to_numpy(zero_copy_only=False),
                          "narrow": part["narrow"].flatten().to_numpy(zero_copy_only=False), "at": part["at"].flatten().to_numpy(zero_copy_only=False),
                          "count": part["count"].flatten().to_numpy(zero_copy_only=False),
                          "ends": np.cumsum([0, *[len(x) for x in part["at"]]])}
                yield pa.RecordBatch.from_pydict({n: [np.ascontiguousarray(arrays[n], _TYPES[n]).tobytes()] for n in _FIELDS})

    return shaped.mapInArrow(pack, ", ".join(f"{n} binary" for n in _FIELDS)).persist()


def _unpacked(line: dict) -> dict[str, np.ndarray]:
    return {n: np.frombuffer(line[n], _TYPES[n]) for n in _FIELDS}


def _those(block: dict[str, np.ndarray], held: np.ndarray) -> dict[str, np.ndarray]:
    """The given rows of a block."""
    each = np.diff(block["ends"])
    terms = np.repeat(held, each)
    return {"fold": block["fold"][held], "label": block["label"][held], "narrow": block["narrow"].reshape(len(held), -1)[held].ravel(),
            "ends": np.cumsum([0, *each[held]]), "at": block["at"][terms], "count": block["count"][terms]}


def _of_fold(block: dict[str, np.ndarray], fold: int) -> dict[str, np.ndarray]:
    """The block's rows that lie in a fold."""
    return _those(block, block["fold"] == fold)


def _owners(block: dict[str, np.ndarray]) -> np.ndarray:
    """The row that each term count belongs to."""
    return np.repeat(np.arange(len(block["label"])), np.diff(block["ends"]))


def _narrow(block: dict[str, np.ndarray], prepared: Prepared, fold: int) -> np.ndarray:
    """Categories, amounts and flags as this fold's pipeline turns them into features."""
    out = block["narrow"].reshape(len(block["label"]), prepared.narrow).copy()
    first = len(prepared.categories)
    out[:, :first] *= prepared.active[fold]
    amounts = slice(first, first + len(prepared.amounts))
    out[:, amounts] = (out[:, amounts] - prepared.center[fold]) / prepared.scale[fold]
    return out


def _counts(block: dict[str, np.ndarray], prepared: Prepared) -> np.ndarray:
    """Plain term counts. A fold's text features are these, each column times its weight and each row over its length, so that products of
    one such matrix serve all folds and vocabulary sizes."""
    out = np.zeros((len(block["label"]), len(prepared.terms)))
    out[_owners(block), block["at"]] = block["count"]
    return out


def _weights(prepared: Prepared, fold: int, size: int) -> np.ndarray:
    return prepared.idf[fold] * (prepared.place[fold] < size)


def _lengths(block: dict[str, np.ndarray], prepared: Prepared, fold: int, size: int) -> np.ndarray:
    values = block["count"] * _weights(prepared, fold, size)[block["at"]]
    length = np.sqrt(np.bincount(_owners(block), values * values, minlength=len(block["label"])))
    return np.where(length > 0, length, 1.0)


def _all_lengths(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The length of each row of counts under each column of weights; 1 for a row without a term."""
    length = np.sqrt(np.square(counts) @ np.square(weights))
    return np.where(length > 0, length, 1.0)


def _values(block: dict[str, np.ndarray], prepared: Prepared, fold: int, size: int) -> np.ndarray:
    """The text feature that each term count becomes."""
    values = block["count"] * _weights(prepared, fold, size)[block["at"]]
    return values / _lengths(block, prepared, fold, size)[_owners(block)]


def matrix(block: dict[str, np.ndarray], prepared: Prepared, fold: int, size: int) -> np.ndarray:
    """The block's rows as this fold's pipeline with this vocabulary size turns them into features."""
    rows, narrow = len(block["label"]), prepared.narrow
    out = np.zeros((rows, prepared.columns))
    out[:, :narrow] = _narrow(block, prepared, fold)
    out[_owners(block), narrow + block["at"]] = _values(block, prepared, fold, size)
    return out


def summed(packed: DataFrame, work: Callable[[dict[str, np.ndarray]], np.ndarray], length: int) -> np.ndarray:
    """The sum over all blocks of the numbers ``work`` gives for each.

    A task adds up its own blocks. Where there are many tasks, their sums are added in groups on the cluster before the driver sees them.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for line in batch.to_pylist():
                part = work(_unpacked(line))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [np.ascontiguousarray(total, np.float64).tobytes()]})

    def merged(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(p.as_py(), np.float64) for p in table["part"]], axis=0)
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    sums, tasks = packed.mapInArrow(partial, "part binary"), packed.rdd.getNumPartitions()
    while tasks > FEW_PARTS:
        tasks = math.ceil(math.sqrt(tasks))
        sums = sums.groupBy(F.spark_partition_id() % tasks).applyInArrow(merged, "part binary")
    out = np.zeros(length)
    for row in sums.collect():
        out += np.frombuffer(row["part"], np.float64)
    return out


def _sent(packed: DataFrame, value):
    return packed.sparkSession.sparkContext.broadcast(value)


# ---------------------------------------------------------------- logistic regression

@dataclass
class Shape:
    """How the features of some rows vary: directions (columns, the intercept last) with the mean square along each, largest first.

    Directions that are not listed are taken to vary like the last one.
    """

    directions: np.ndarray
    squares: np.ndarray

    def solved(self, gradient: np.ndarray, penalty: float) -> np.ndarray:
        """The gradient over the curvature that logistic regression has at most along each direction."""
        along, rest = self.directions.T @ gradient, 0.25 * self.squares[-1] + penalty
        return gradient / rest + self.directions @ (along / (0.25 * self.squares + penalty) - along / rest)


@dataclass
class _Fit:
    """One model on its way to the minimum: limited-memory BFGS, one evaluation a pass.

    Steps start from the curvature of ``shape``, over the columns that the model has (``used``). Where a step has to be cut too often, the
    fit goes on without it.
    """

    fold: int
    size: int
    C: float
    limit: int
    class_weight: tuple[float, float]
    weight: float
    x: np.ndarray
    point: np.ndarray
    shape: Shape | None = None
    used: np.ndarray | None = None
    value: float = math.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    rounds: int = 0
    cuts: int = 0
    pairs: list = field(default_factory=list)
    done: bool = False

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """Take the summed loss and gradient at ``point`` and choose the next point."""
        penalty = 1.0 / (self.C * self.weight)
        value = loss / self.weight + 0.5 * penalty * float(self.point[:-1] @ self.point[:-1])
        gradient = gradient / self.weight
        gradient[:-1] += penalty * self.point[:-1]
        if self.gradient is not None and value > self.value + 1e-4 * self.step * float(self.gradient @ self.direction):
            self.step *= 0.5
            self.cuts += 1
            if self.shape is not None and self.cuts >= _HALVINGS:
                self.shape, self.pairs = None, []
                self._turn()
                return
            self.done = self.step < 1e-10
            self.point = self.x + self.step * self.direction
            return
        if self.gradient is not None:
            s, y = self.point - self.x, gradient - self.gradient
            if float(s @ y) > 1e-12:
                self.pairs = [*self.pairs[-9:], (s, y)]
            self.rounds += 1
        self.x, self.value, self.gradient = self.point, value, gradient
        if np.abs(gradient).max() <= TOLERANCE or self.rounds >= self.limit:
            self.done = True
            return
        self._turn()

    def _turn(self) -> None:
        self.direction, self.cuts = self._descent(self.gradient), 0
        self.step = 1.0 if self.pairs or self.shape is not None else min(1.0, 1.0 / float(np.sqrt(self.gradient @ self.gradient)))
        self.point = self.x + self.step * self.direction

    def _shaped(self, gradient: np.ndarray) -> np.ndarray:
        if self.shape is None:
            return gradient
        return self.used * self.shape.solved(self.used * gradient, 1.0 / (self.C * self.weight))

    def _descent(self, gradient: np.ndarray) -> np.ndarray:
        q, kept = gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            kept.append(a)
            q -= a * y
        q = self._shaped(q)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ self._shaped(y))
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += (a - float(y @ q) / float(s @ y)) * s
        return -q


def _grouped(fits: Sequence) -> dict[tuple[int, int], list[int]]:
    out: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(fits):
        out.setdefault((f.fold, f.size), []).append(i)
    return out


def class_sizes(packed: DataFrame, folds: int) -> np.ndarray:
    """Rows of each (fold, label)."""

    def count(block: dict[str, np.ndarray]) -> np.ndarray:
        return np.bincount(block["fold"] * 2 + (block["label"] > 0), minlength=2 * folds).astype(float)

    return summed(packed, count, 2 * folds).reshape(folds, 2)


def _some(packed: DataFrame, total: float, rows: int = SHAPE_ROWS) -> list[dict[str, np.ndarray]]:
    """About ``rows`` of the rows as blocks, spread evenly over every task's."""
    step = max(1, math.ceil(total / rows))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for line in batch.to_pylist():
                block = _unpacked(line)
                n = len(block["label"])
                some = _those(block, (seen + np.arange(n)) % step == 0)
                seen += n
                yield pa.RecordBatch.from_pydict({name: [np.ascontiguousarray(some[name], _TYPES[name]).tobytes()] for name in _FIELDS})

    return [_unpacked(r.asDict()) for r in packed.mapInArrow(pick, ", ".join(f"{n} binary" for n in _FIELDS)).collect()]


def shape_of(some: Sequence[dict[str, np.ndarray]], prepared: Prepared, size: int, rank: int = SHAPE_RANK) -> Shape:
    """The shape of some rows for a vocabulary size, over the columns that any fold has, by subspace iteration."""
    weights = np.max([_weights(prepared, f, size) for f in range(prepared.folds)], axis=0)[:, None]
    parts = []
    for block in some:
        counts = _counts(block, prepared)
        narrow = np.mean([_narrow(block, prepared, f) for f in range(prepared.folds)], axis=0)
        parts.append(np.concatenate([narrow, counts * weights.T / _all_lengths(counts, weights), np.ones((len(counts), 1))], 1))
    x = np.concatenate(parts) if parts else np.zeros((0, prepared.columns + 1))
    x /= math.sqrt(max(len(x), 1))
    basis = np.random.default_rng(0).normal(size=(x.shape[1], min(rank, x.shape[1])))
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, along, turned = np.linalg.svd(x @ basis, full_matrices=False)
    least = _FLAT * float(np.square(x).sum()) / x.shape[1]
    return Shape(basis @ turned.T, np.maximum(np.square(along), max(least, 1e-12)))


@dataclass
class _Asked:
    """Points of many models as the tasks need them: term coefficients times the weights of the model's fold and size, lengths by group."""

    scaled: np.ndarray
    narrow: np.ndarray
    intercept: np.ndarray
    weights: np.ndarray  # (terms, groups)
    group: np.ndarray  # of each model
    fold: np.ndarray


def _asked(prepared: Prepared, fits: Sequence, points: np.ndarray) -> _Asked:
    groups, first = _grouped(fits), prepared.narrow
    weights = np.stack([_weights(prepared, *g) for g in groups], 1)
    group = np.zeros(len(fits), np.int64)
    for g, which in enumerate(groups.values()):
        group[which] = g
    return _Asked(points[first:-1] * weights[:, group], points[:first], points[-1], weights, group, np.array([f.fold for f in fits]))


def _said(block: dict[str, np.ndarray], counts: np.ndarray, prepared: Prepared, asked: _Asked) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """What each model says of each row, the lengths of the rows for each model, and the narrow features by fold."""
    length = _all_lengths(counts, asked.weights)[:, asked.group]
    out = counts @ asked.scaled / length + asked.intercept
    narrow = {f: _narrow(block, prepared, f) for f in np.unique(asked.fold).tolist()}
    for f, features in narrow.items():
        out[:, asked.fold == f] += features @ asked.narrow[:, asked.fold == f]
    return out, length, narrow


def logistic_weights(packed: DataFrame, prepared: Prepared, models: Sequence[dict], sizes: np.ndarray, shapes: dict[int, Shape] | None = None) -> list[np.ndarray]:
    """Coefficients (intercept last) of every model, ``fold``, ``max_features``, ``C``, ``max_iter`` and ``class_weight`` each.

    Every pass evaluates all models that have not converged, each at its own next point. ``shapes`` holds shapes by vocabulary size and
    takes those that it lacks.
    """
    width, first, fits = prepared.columns + 1, prepared.narrow, []
    shapes = {} if shapes is None else shapes
    if lacking := {m["max_features"] for m in models} - set(shapes):
        some = _some(packed, float(sizes.sum()))
        shapes |= {size: shape_of(some, prepared, size) for size in lacking}
    for m in models:
        inside = sizes.sum(0) - sizes[m["fold"]]
        weight = tuple(inside.sum() / (2 * max(n, 1.0)) if m["class_weight"] == "balanced" else 1.0 for n in inside)
        total = float(sum(w * n for w, n in zip(weight, inside, strict=True))) or 1.0
        used = np.append(prepared.used(m["fold"], m["max_features"]), True)
        fits.append(_Fit(m["fold"], m["max_features"], m["C"], m["max_iter"], weight, total, np.zeros(width), np.zeros(width), shapes[m["max_features"]], used))
    while going := [f for f in fits if not f.done]:
        asked = _asked(prepared, going, np.stack([f.point for f in going], 1))
        sent = _sent(packed, (prepared, asked, np.array([f.class_weight for f in going])))

        def evaluate(block: dict[str, np.ndarray], sent=sent) -> np.ndarray:
            prepared, asked, weights = sent.value
            counts, sign = _counts(block, prepared), np.where(block["label"] > 0, 1.0, -1.0)[:, None]
            said, length, narrow = _said(block, counts, prepared, asked)
            w = weights.T[(block["label"] > 0).astype(int)] * (block["fold"][:, None] != asked.fold)
            margin = sign * said
            small = np.exp(-np.abs(margin))
            pull = -sign * w * np.where(margin > 0, small, 1.0) / (1 + small)
            out = np.empty((width + 1, len(asked.fold)))
            out[0], out[-1] = (w * (np.log1p(small) + np.maximum(-margin, 0.0))).sum(0), pull.sum(0)
            for f, features in narrow.items():
                out[1 : 1 + first, asked.fold == f] = features.T @ pull[:, asked.fold == f]
            np.matmul(counts.T, pull / length, out=out[1 + first : -1])
            return out.ravel()

        found = summed(packed, evaluate, (width + 1) * len(going)).reshape(width + 1, len(going))
        sent.destroy()
        found[1 + first : -1] *= asked.weights[:, asked.group]
        for i, f in enumerate(going):
            f.told(float(found[0, i]), found[1:, i].copy())
    return [f.x for f in fits]


def _judged_logistic(packed: DataFrame, prepared: Prepared, models: Sequence[dict], found: Sequence[np.ndarray]) -> np.ndarray:
    """Confusion counts (model, label, prediction) on the held-out rows."""
    named = [_Named(m["fold"], m["max_features"]) for m in models]
    sent = _sent(packed, (prepared, _asked(prepared, named, np.stack(list(found), 1))))

    def judge(block: dict[str, np.ndarray]) -> np.ndarray:
        prepared, asked = sent.value
        said, _, _ = _said(block, _counts(block, prepared), prepared, asked)
        out = np.zeros((len(asked.fold), 4))
        for f in np.unique(asked.fold):
            held, which = block["fold"] == f, asked.fold == f
            out[which] = _cells(block["label"][held], said[held][:, which] > 0)
        return out.ravel()

    cells = summed(packed, judge, len(models) * 4).reshape(len(models), 2, 2)
    sent.destroy()
    return cells


@dataclass
class _Named:
    fold: int
    size: int


def _cells(label: np.ndarray, said: np.ndarray) -> np.ndarray:
    cell = 2 * (label > 0)[:, None] + said
    return np.stack([(cell == i).sum(0) for i in range(4)], 1)


# ---------------------------------------------------------------- Gaussian naive Bayes

def class_moments(packed: DataFrame, prepared: Prepared, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """For each (fold, size): number, sum and sum of squares of every feature in each class of the training rows, (class, 3, columns).

    All folds and vocabulary sizes come from one pass; any smoothing is applied afterwards.
    """
    sent = _sent(packed, (prepared, list(wanted)))

    def add(block: dict[str, np.ndarray]) -> np.ndarray:
        prepared, wanted = sent.value
        out = np.zeros((len(wanted), 2, 3, prepared.columns))
        of, first = _owners(block), prepared.narrow
        for i, (fold, size) in enumerate(wanted):
            narrow, values = _narrow(block, prepared, fold), _values(block, prepared, fold, size)
            for c in (0, 1):
                rows = (block["fold"] != fold) & ((block["label"] > 0) == c)
                terms = rows[of]
                at, held = block["at"][terms], values[terms]
                out[i, c, 0] = rows.sum()
                for k, power in enumerate((narrow[rows], np.square(narrow[rows])), 1):
                    out[i, c, k, :first] = power.sum(0)
                for k, power in enumerate((held, np.square(held)), 1):
                    out[i, c, k, first:] = np.bincount(at, power, minlength=len(prepared.terms))
        return out.ravel()

    found = summed(packed, add, len(wanted) * 6 * prepared.columns).reshape(len(wanted), 2, 3, prepared.columns)
    sent.destroy()
    return dict(zip(wanted, found, strict=True))


def _gaussians(moments: np.ndarray, used: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances and log priors of both classes over the used columns; smoothing is a share of the largest variance."""
    n, total, square = (moments[:, k][:, used] for k in range(3))
    rows = np.maximum(n, 1.0)
    mean, variance = total / rows, np.maximum(square / rows - (total / rows) ** 2, 0.0)
    everything = np.maximum(n.sum(0), 1.0)
    overall = np.maximum(square.sum(0) / everything - (total.sum(0) / everything) ** 2, 0.0)
    variance = variance + smoothing * (float(overall.max()) if overall.size else 0.0)
    prior = np.log(np.maximum(moments[:, 0, 0], 1e-300) / max(float(moments[:, 0, 0].sum()), 1.0)) if moments.shape[2] else np.zeros(2)
    return mean, np.maximum(variance, 1e-300), prior


def _judged_bayes(packed: DataFrame, prepared: Prepared, models: Sequence[dict], moments: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    named = [_Named(m["fold"], m["max_features"]) for m in models]
    sent = _sent(packed, (prepared, _grouped(named), [m["var_smoothing"] for m in models], moments))

    def judge(block: dict[str, np.ndarray]) -> np.ndarray:
        prepared, groups, smoothing, moments = sent.value
        out = np.zeros((len(smoothing), 4))
        for (fold, size), which in groups.items():
            held, used = _of_fold(block, fold), prepared.used(fold, size)
            x = matrix(held, prepared, fold, size)[:, used]
            chance = np.zeros((2, len(x), len(which)))
            shaped = [_gaussians(moments[fold, size], used, smoothing[i]) for i in which]
            for c in (0, 1):
                apart = (x - shaped[0][0][c]) ** 2
                spreads = np.stack([v[c] for _, v, _ in shaped], 1)
                chance[c] = -0.5 * (apart @ (1 / spreads) + np.log(2 * np.pi * spreads).sum(0)) + shaped[0][2][c]
            out[which] = _cells(held["label"], chance[1] > chance[0])
        return out.ravel()

    cells = summed(packed, judge, len(models) * 4).reshape(len(models), 2, 2)
    sent.destroy()
    return cells


# ---------------------------------------------------------------- sampler

@dataclass(frozen=True)
class Range:
    """A number to choose from ``low`` to ``high``, on a logarithmic scale or in whole steps if asked for."""

    low: float
    high: float
    log: bool = False
    step: float | None = None


Space = dict[str, Range | Sequence]


class Parzen:
    """Tree-structured Parzen estimator: draw where good trials are dense and the others are not.

    The best tenth of the trials (at least one) and the rest each give a density: Gaussian kernels of the width of the gaps between
    neighbours, and a flat one, for numbers; counts for choices. Of 24 draws from the first the one with the largest ratio to the second
    is proposed. Trials proposed but not yet scored count among the rest, so that the proposals of a block keep apart.
    """

    STARTUP, DRAWS = 10, 24

    def __init__(self, space: Space, seed: int) -> None:
        self.space, self.random = space, random.Random(seed)
        self.scored: list[tuple[float, dict]] = []

    def tell(self, params: dict, score: float) -> None:
        self.scored.append((score, params))

    def ask(self, n: int) -> list[dict]:
        out: list[dict] = []
        for _ in range(n):
            if len(self.scored) < self.STARTUP:
                out.append({name: self._anywhere(kind) for name, kind in self.space.items()})
                continue
            ranked = sorted(self.scored, key=lambda t: -t[0])
            good = max(1, math.ceil(len(ranked) / 10))
            fine, rest = [p for _, p in ranked[:good]], [p for _, p in ranked[good:]] + out
            out.append({name: self._proposed(kind, [p[name] for p in fine], [p[name] for p in rest]) for name, kind in self.space.items()})
        return out

    def _anywhere(self, kind):
        if isinstance(kind, Range):
            low, high = self._ends(kind)
            return self._back(kind, self.random.uniform(low, high))
        return self.random.choice(list(kind))

    @staticmethod
    def _ends(kind: Range) -> tuple[float, float]:
        return (math.log(kind.low), math.log(kind.high)) if kind.log else (kind.low, kind.high)

    @staticmethod
    def _back(kind: Range, value: float):
        if kind.log:
            return min(kind.high, max(kind.low, math.exp(value)))
        if kind.step:
            return type(kind.low)(min(kind.high, kind.low + round((value - kind.low) / kind.step) * kind.step))
        return value

    def _proposed(self, kind, fine: list, rest: list):
        if not isinstance(kind, Range):
            weigh = lambda seen, v: (seen.count(v) + 1.0) / (len(seen) + len(kind))
            drawn = self.random.choices(list(kind), [weigh(fine, v) for v in kind], k=self.DRAWS)
            return max(drawn, key=lambda v: weigh(fine, v) / weigh(rest, v))
        low, high = self._ends(kind)
        inside = lambda seen: sorted(math.log(v) if kind.log else v for v in seen)
        near, far = (self._kernels(inside(seen), low, high) for seen in (fine, rest))
        drawn = []
        for _ in range(self.DRAWS):
            center, width = self.random.choice(near)
            value = self.random.uniform(low, high) if width is None else min(high, max(low, self.random.gauss(center, width)))
            drawn.append(value)
        return self._back(kind, max(drawn, key=lambda v: self._density(near, v, low, high) / self._density(far, v, low, high)))

    @staticmethod
    def _kernels(points: list[float], low: float, high: float) -> list[tuple[float, float | None]]:
        out: list[tuple[float, float | None]] = [(0.0, None)]
        edged = [low, *points, high]
        least = (high - low) / min(100, len(points) + 2)
        for i, p in enumerate(points, 1):
            out.append((p, min(high - low, max(least, edged[i + 1] - p, p - edged[i - 1]))))
        return out

    @staticmethod
    def _density(kernels: list[tuple[float, float | None]], value: float, low: float, high: float) -> float:
        total = 0.0
        for center, width in kernels:
            if width is None:
                total += 1 / (high - low)
            else:
                total += math.exp(-0.5 * ((value - center) / width) ** 2) / (width * math.sqrt(2 * math.pi))
        return total / len(kernels)


# ---------------------------------------------------------------- search

def macro_f1(cells: np.ndarray) -> float:
    """Mean F1 of both classes from (label, prediction) counts; an undefined F1 is 0."""
    scores = []
    for c in (0, 1):
        both = cells[c].sum() + cells[:, c].sum()
        scores.append(2 * cells[c, c] / both if both else 0.0)
    return float(np.mean(scores))


def objective(scores: Sequence[float]) -> float:
    """Mean over folds less half the population deviation; 0 if a score is undefined."""
    return 0.0 if np.isnan(scores).any() else float(np.mean(scores) - 0.5 * np.std(scores))


def run(packed: DataFrame, prepared: Prepared, model: str, space: Space, trials: int, seed: int, at_once: int = 10, size: int = words.VOCABULARY) -> list[dict]:
    """Scores of every trial on every fold: proposals in blocks of ``at_once``, all fits of a block side by side in each pass.

    ``model`` is ``logistic`` or ``naive_bayes``. A trial is a dict of its parameters, ``trial``, ``scores`` by fold and ``objective``.
    """
    sampler, out = Parzen(space, seed), []
    folds = range(prepared.folds)
    sizes = class_sizes(packed, prepared.folds)
    moments: dict[tuple[int, int], np.ndarray] = {}
    shapes: dict[int, Shape] = {}
    if model == "naive_bayes":
        steps = space.get("max_features")
        every = [size] if steps is None else [int(steps.low + i * steps.step) for i in range(int((steps.high - steps.low) / steps.step) + 1)]
        for f in folds:  # a fold at a time bounds what a task adds up
            moments |= class_moments(packed, prepared, [(f, s) for s in every])
    while len(out) < trials:
        block = [{"max_features": size} | p for p in sampler.ask(min(at_once, trials - len(out)))]
        models = [p | {"fold": f} for p in block for f in folds]
        if model == "logistic":
            cells = _judged_logistic(packed, prepared, models, logistic_weights(packed, prepared, models, sizes, shapes))
        elif model == "naive_bayes":
            cells = _judged_bayes(packed, prepared, models, moments)
        else:
            raise ValueError(f"no such model: {model}")
        for i, p in enumerate(block):
            scores = [macro_f1(cells[i * prepared.folds + f]) for f in folds]
            sampler.tell(p, objective(scores))
            out.append({"trial": len(out), **p, "scores": scores, "objective": objective(scores)})
    return out
