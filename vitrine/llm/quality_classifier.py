"""Quality classification by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import agreed, labelled_sample
from vitrine.llm.features import WordKeys, gram_keys, mixed

#: Hashed indicators: shapes of characters, repetition of words, words and pairs of words each have a range of their own.
SHAPE_BITS, SAME_BITS, WORD_BITS = 14, 5, 17
SHAPES_TO, SAME_TO, WORDS_TO = 5, 4, 2
SIZE = (1 << SHAPE_BITS) + (1 << SAME_BITS) + (1 << WORD_BITS)
_AT_ONCE = 1 << 20


@lru_cache(maxsize=1)
def _shapes() -> np.ndarray:
    """What each code point is to a shape: lower and upper letters, other letters, digits and blanks are one kind each, all else is itself."""
    kinds = np.arange(0x110000, dtype=np.uint64)
    text = [chr(i) for i in range(0x3000)]
    for i, c in enumerate(text):
        kinds[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isdigit() else 5 if c.isspace() and c != "\n" else i
    kinds[0x3000:] = 6
    return kinds


class Indicators:
    """Which hashed n-grams a text has."""

    def __init__(self) -> None:
        self.keys = WordKeys()

    def of(self, text: str) -> np.ndarray:
        """Sorted places of the n-grams of the whole text. Parts of long texts overlap, so none is missed at a border."""
        has = np.zeros(1 << SHAPE_BITS, bool)
        for begin in range(0, len(text), _AT_ONCE):
            part = text[max(0, begin - SHAPES_TO + 1):begin + _AT_ONCE]
            kinds = _shapes()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")]
            for order in range(1, SHAPES_TO + 1):
                has[mixed(gram_keys(kinds, order), SHAPE_BITS)] = True
        words = text.split()
        keys = self.keys(words)
        same = (keys[1:] == keys[:-1]).astype(np.uint64)
        repeats = [mixed(gram_keys(same, order), SAME_BITS) for order in range(1, SAME_TO + 1)]
        grams = [mixed(gram_keys(keys, order), WORD_BITS) for order in range(1, WORDS_TO + 1)]
        return np.concatenate([np.flatnonzero(has), np.unique(np.concatenate(repeats)) + (1 << SHAPE_BITS), np.unique(np.concatenate(grams)) + (1 << SHAPE_BITS) + (1 << SAME_BITS)])


@dataclass(frozen=True)
class Model:
    """A weight for each indicator (the ratio is multiplied in), its ratio (for the length of a row), bias and calibration."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[places].astype(float) ** 2).sum()))
        return self.bias + (float(self.weights[places].sum()) / length if length > 0 else 0.0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def log_count_ratios(rows: Sequence[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """``log((p + smooth) / |p|) - log((q + smooth) / |q|)`` of the texts with label 1 and 0 that have each indicator."""
    counts = [np.full(SIZE, smooth) for _ in range(2)]
    for places, y in zip(rows, label, strict=True):
        counts[int(y)][places] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: Sequence[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 30,
                            enough: float = 1e-3) -> tuple[np.ndarray, float]:
    """``min |w|^2 / 2 + cost * sum max(0, 1 - y (w x + b))`` over the dual, one row at a time.

    Row i holds ``values`` at its places, scaled to length 1, and a 1 for the bias. Each step solves its row's dual variable exactly within
    [0, cost]; passes go through the rows in a new order and end when no step is larger than ``enough``.
    """
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    scaled = [values[p] / max(1e-12, float(np.sqrt((values[p] ** 2).sum()))) for p in rows]
    square = [float(x @ x) + 1.0 for x in scaled]
    rng = np.random.default_rng(5)
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ scaled[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * scaled[i]
                bias += step * y[i]
                largest = max(largest, abs(step))
        if largest < enough:
            break
    return w, bias


def _calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted rows, with targets drawn in from 0 and 1 (Platt)."""
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(slope, x.T @ (weight * (target - p)) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(rows: Sequence[np.ndarray], label: Sequence[int], totals: dict[int, int] | None = None) -> Model:
    """Train on indicator places. A fifth of the rows only calibrates the score; ``totals`` are the labels' numbers before sampling."""
    label = np.array(label, np.int64)
    totals = totals or {k: int((label == k).sum()) for k in (0, 1)}
    if len(set(label.tolist())) < 2:
        prior = (totals.get(1, 0) + 1) / (totals.get(0, 0) + totals.get(1, 0) + 2)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    held = np.arange(len(rows)) % 5 == 4
    if any(not (label[part] == k).any() for part in (held, ~held) for k in (0, 1)):
        held[:] = False
    train, judged = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(rows))
    ratios = log_count_ratios([rows[i] for i in train], label[train])
    w, bias = dual_coordinate_descent([rows[i] for i in train], ratios, np.where(label[train] == 1, 1.0, -1.0))
    model = Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, 1.0, 0.0)
    margin = np.array([model.margin(rows[i]) for i in judged])
    share = np.array([totals.get(k, 0) / max(1, int((label == k).sum())) for k in (0, 1)])
    weight = share[label[judged]]
    slope, shift = _calibrate(margin, label[judged], weight * len(judged) / weight.sum())
    return Model(model.weights, model.ratios, bias, slope, shift)


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = 2500) -> Model:
    """Learn from labelled documents outside the held-out fold.

    Bound: about ``per_class`` documents of each label value; what reaches the driver are the places of their n-grams, at most ``SIZE`` each.
    """
    places = F.arrow_udf("array<int>")(_places)
    sample = labelled_sample(docs, labels, label, folds, held_out, per_class).select("_id", "_label", places("_text").alias("_at")).collect()
    sample.sort(key=lambda r: r._id)
    known = agreed(labels, label, folds, held_out).groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit([np.array(r._at, np.int64) for r in sample], [r._label for r in sample], {int(r._label): r.n for r in known})


def _places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    found = Indicators()
    for texts in batches:
        yield pa.array([found.of(t.as_py() or "").astype(np.int32) for t in texts], pa.list_(pa.int32()))


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) of every whole text and ``predicted`` (1 from ``least``).

    A null or empty text has no n-gram and the score of the bias. Columns of these names are replaced; repeated rows get equal scores; an
    empty table gives an empty result; a model fit to one label, or none, scores every text alike.
    """

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = Indicators()
        for texts in batches:
            margin = np.array([model.margin(found.of(t.as_py() or "")) for t in texts], float)
            yield pa.array(model.probability(margin), pa.float64())

    return docs.withColumn("score", judge(F.col(text))).withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
