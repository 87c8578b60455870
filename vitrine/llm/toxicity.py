"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine on top."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import labelled_sample

#: Common subsequences of these lengths count; a skipped character costs DECAY.
LENGTHS, DECAY = (3, 4), 0.6
#: Stands before each unit, so that how it begins can be told.
START = "^"
LANDMARKS = 60
#: A longer unit is compared window by window, each half a window after the last.
WINDOW = 14
REMEMBERED = 600_000
#: A string shows a toxic sentence at first if its log odds, times the root of its number of toxic texts, are higher than this.
SHOWN_FROM = 11.0
#: No string shows a toxic sentence whose log odds of lying in a toxic text are lower.
LEAST_ODDS = 2.0
#: Share of clean texts that a string's margin must exceed to show a toxic sentence.
CLEAN_SHARE = 0.995
#: Clean strings in training, and how many of those judged wrong may join in each round.
NEGATIVES = 5000
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Three or more letters one by one, with blanks or marks between.
_SPELT = re.compile(r"(?<!\S)(?:[^\w\s]*[^\W\d_][^\w\s]*(?:\s+|$)){3,}")


def spelt_out(sentence: str) -> list[str]:
    """Words that are spelt out letter by letter, joined without blanks."""
    return ["".join(m.group().split()) for m in _SPELT.finditer(sentence)]


def unit_of(token: str) -> str:
    """A blank-free token as the kernel sees it: without marks at its edges."""
    return token if token.isalpha() else _EDGES.sub("", token)


def windows(unit: str) -> list[str]:
    """A unit as compared strings: START and the unit, or START and parts of WINDOW characters, each half a window after the last."""
    return [START + unit[a:a + WINDOW] for a in range(0, max(1, len(unit) - WINDOW // 2), WINDOW // 2)]


def _letters(words: Sequence[str], pad: int) -> np.ndarray:
    """Code points, one padded column a word. A character that is no letter matches nothing: it only lengthens gaps."""
    out = np.full((len(words), max(map(len, words))), pad, np.int32)
    for row, word in zip(out, words, strict=True):
        row[:len(word)] = [ord(c) if c.isalpha() or c == START else pad for c in word]
    return np.ascontiguousarray(out.T)


def _weights(match: np.ndarray) -> list[np.ndarray]:
    """Gap-weighted kernels of every length in LENGTHS, from which places match: (places, places, ...) to (...)."""
    here = match.astype(np.float32) * np.float32(DECAY * DECAY)
    out, ending = [], here.copy()
    for length in range(2, max(LENGTHS) + 1):
        # shorter matches that end at or before each place, decayed up to it: a running sum along either string
        for j in range(1, ending.shape[1]):
            ending[:, j] += np.float32(DECAY) * ending[:, j - 1]
        for i in range(1, ending.shape[0]):
            ending[i] += np.float32(DECAY) * ending[i - 1]
        longer = np.zeros_like(ending)
        longer[1:, 1:] = ending[:-1, :-1] * here[1:, 1:]
        ending = longer
        if length in LENGTHS:
            out.append(ending.sum((0, 1)))
    return out


def _own(s: np.ndarray) -> list[np.ndarray]:
    return [np.maximum(k, 1e-12) for k in _weights((s[:, None] == s[None]) & (s[:, None] >= 0))]


def kernel(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """Mean over LENGTHS of the normalised kernels: 1 for equal strings, 0 without a common subsequence. Words by landmarks."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not len(words) or not len(landmarks):
        return out
    target = _letters(landmarks, -2)
    of_target = _own(target)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 64):
        some = order[at:at + 64]
        s = _letters([words[i] or " " for i in some], -1)
        both = _weights(s[:, None, :, None] == target[None, :, None, :])
        out[some] = sum(k / np.sqrt(o[:, None] * t) for k, o, t in zip(both, _own(s), of_target, strict=True)) / len(LENGTHS)
    return out


@dataclass(frozen=True)
class Model:
    """Landmarks, the weight of a string's kernel with each (the support vector machine folded with the Nyström map), and the calibration."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


class Folded:
    """A model's margins without visiting landmarks: the weight of every subsequence of three or four letters, summed over landmarks.

    The kernel is a dot product over subsequences, so ``sum_j w_j k(u, l_j)`` is one weight per subsequence of ``u``. The sums are the
    same as those over landmarks.
    """

    def __init__(self, model: Model):
        self.bias = model.bias
        alphabet = sorted({c for mark in model.landmarks for c in mark if c.isalpha() or c == START})
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        base = self.base = len(alphabet) + 1
        three: dict[tuple, float] = Counter()
        four: dict[tuple, float] = Counter()
        for mark, weight in zip(model.landmarks, model.weights.tolist(), strict=True):
            codes = [self.code.get(c, 0) for c in mark]
            for table, norm, size in zip((three, four), _own(_letters([mark], -1)), LENGTHS, strict=True):
                for places in combinations(range(len(codes)), size):
                    key = tuple(codes[p] for p in places)
                    if all(key):
                        table[key] += weight / len(LENGTHS) / float(norm[0]) ** 0.5 * DECAY ** (places[-1] - places[0] + 1)
        for key in four:
            three[key[:3]] += 0.0
        self.number = np.zeros(base ** 3, np.int32)
        self.of_three, self.of_four = np.zeros(len(three) + 1, np.float32), np.zeros((len(three) + 1, base), np.float32)
        at = {}
        for i, (key, weight) in enumerate(sorted(three.items()), 1):
            at[key] = i
            self.number[(key[0] * base + key[1]) * base + key[2]] = i
            self.of_three[i] = weight
        for key, weight in four.items():
            self.of_four[at[key[:3]], key[3]] = weight

    def margins(self, found: Sequence[str]) -> np.ndarray:
        """The margin of each unit: that of its highest window, the bias for a unit without a window that is long enough."""
        out = np.full(len(found), -np.inf)
        by_size: dict[int, list[tuple[int, str]]] = {}
        for i, unit in enumerate(found):
            for w in windows(unit):
                by_size.setdefault(len(w), []).append((i, w))
        for size, parts in by_size.items():
            for at in range(0, len(parts), 512):
                some = parts[at:at + 512]
                np.maximum.at(out, [i for i, _ in some], self._same_size([w for _, w in some], size))
        return out

    def _same_size(self, words: list[str], size: int) -> np.ndarray:
        if size < max(LENGTHS) or self.base == 1:
            return np.full(len(words), self.bias)
        own = _own(_letters(words, -1))
        codes = np.array([[self.code.get(c, 0) for c in w] for w in words], np.int32)
        threes, fours, near, wide, far = _places(size)
        number = self.number[(codes[:, threes[:, 0]] * self.base + codes[:, threes[:, 1]]) * self.base + codes[:, threes[:, 2]]]
        total = (self.of_three[number] @ near) / np.sqrt(own[0])
        total += (self.of_four[number[:, fours], codes[:, far]] @ wide) / np.sqrt(own[1])
        return total + self.bias


@lru_cache(maxsize=64)
def _places(size: int) -> tuple[np.ndarray, ...]:
    """Places of every three letters of a string of ``size``; for every four, which three they begin with; the decay of each; the fourth place."""
    threes = np.array(list(combinations(range(size), 3)))
    place = {tuple(t): i for i, t in enumerate(threes.tolist())}
    fours = np.array(list(combinations(range(size), 4)))
    near = np.float32(DECAY) ** (threes[:, 2] - threes[:, 0] + 1).astype(np.float32)
    wide = np.float32(DECAY) ** (fours[:, 3] - fours[:, 0] + 1).astype(np.float32)
    return threes, np.array([place[tuple(f[:3])] for f in fours.tolist()]), near, wide, fours[:, 3]


class Scorer:
    """Scores texts, remembering the margins of tokens."""

    def __init__(self, model: Model):
        self.folded, self.known = Folded(model), {}

    def _learn(self, tokens: set[str]) -> None:
        fresh = [t for t in tokens if t not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(tokens)
        self.known.update(zip(fresh, self.folded.margins([unit_of(t) for t in fresh]).tolist(), strict=True))

    def margins(self, texts: Sequence[str]) -> list[tuple[float, str]]:
        """The highest margin of each whole text and the token that has it."""
        cut = []
        for text in texts:
            low = text.lower()
            cut.append(low.split() + spelt_out(low))
        self._learn({t for tokens in cut for t in tokens})
        return [max(((self.known[t], t) for t in set(tokens)), default=(self.folded.bias, "")) for tokens in cut]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, damp = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    damp[-1] = ridge * 1e-3
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() / weight.sum() + damp @ w ** 2
    now = loss(w)
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * weight[inside, None]
        step = np.linalg.solve(a.T @ x1[inside] / weight.sum() + np.diag(damp), a.T @ y[inside] / weight.sum()) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-10:
            break
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in from 0 and 1 (Platt)."""
    pos, neg = int(label.sum()), int((~label).sum())
    target = np.where(label, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _numbered(text: str, number: dict[str, int]) -> np.ndarray:
    """Numbers of the compared strings of a text in order, with -1 between sentences; new strings get the next number."""
    out = [-1]
    for sentence in _SENTENCE.split(text.lower()):
        out += [number.setdefault(w, len(number)) for t in sentence.split() + spelt_out(sentence) for w in windows(unit_of(t)) if len(w) >= max(LENGTHS)]
        out.append(-1)
    return np.array(out, np.int64)


def _surroundings(texts: Sequence[np.ndarray], strings: int) -> np.ndarray:
    """In how many different surroundings (the strings before and after in its sentence) each string occurs.

    Copies and near copies of a sentence so count once, or nearly: a string tells something by what varies around it.
    """
    all_ = np.concatenate(texts) if len(texts) else np.array([-1, -1, -1])
    base = strings + 1
    key = ((all_[1:-1] + 1) * base + all_[:-2] + 1) * base + all_[2:] + 1
    return np.bincount(np.unique(key[all_[1:-1] >= 0]) // (base * base) - 1, minlength=strings).astype(float)


def _disturbed(word: str, rng: np.random.Generator) -> str:
    """A word with a letter put in or doubled."""
    at = int(rng.integers(2, len(word)))
    return word[:at] + (word[at - 1] if rng.random() < 0.4 else chr(97 + int(rng.integers(26)))) + word[at:]


def _choose_landmarks(scored: list[tuple[float, str]], most: int) -> list[str]:
    """From the best down, each time the string of high score least like those chosen, until all have a near relative among them."""
    pool = sorted(scored, reverse=True)[:1000]
    names, chosen, like = [u for _, u in pool], [], np.zeros(len(pool))
    weight = np.array([s for s, _ in pool]) ** 0.25
    while len(chosen) < min(most, len(pool)):
        best = int(np.argmax(weight * (1 - like)))
        if like[best] > 0.6:
            break
        chosen.append(names[best])
        like = np.maximum(like, kernel(names, [names[best]])[:, 0])
    return chosen


def _constant(label: np.ndarray) -> Model:
    """The share of toxic texts as the score of every text."""
    return Model([], np.zeros(0), 0.0, 1.0, float(np.log((label.sum() + 1) / ((~label).sum() + 1))))


def fit(texts: Sequence[str], toxic: Sequence[bool], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """Train on sentences that carry the label of their text.

    Every sentence of a clean text is clean; those of a toxic text are toxic where a string shows it. Rounds alternate: the
    machine is fit to the strings that show toxic sentences (also with a letter put in or doubled) against clean ones (those it got wrong
    join), then the showing strings are chosen anew. Without both labels, or a telling string, the score is constant.
    """
    label = np.array(toxic, bool)
    if not label.any() or label.all():
        return _constant(label)
    number: dict[str, int] = {}
    docs = [_numbered(t, number) for t in texts]
    strings = list(number)
    held = np.arange(len(docs)) % 5 == 4  # calibrates, does not train
    if any(not (label[part] == kind).any() for part in (held, ~held) for kind in (True, False)):
        held[:] = False
    toxic_docs, clean_docs = ([d for d, h, y in zip(docs, held, label, strict=True) if not h and y == kind] for kind in (True, False))
    in_toxic, in_clean = _surroundings(toxic_docs, len(strings)), _surroundings(clean_docs, len(strings))
    odds = np.log((in_toxic + 0.5) / (in_toxic.sum() + 1)) - np.log((in_clean + 0.5) / (in_clean.sum() + 1))
    rank = odds * np.sqrt(in_toxic)
    certain = (rank > SHOWN_FROM) & (odds > LEAST_ODDS)
    marks = _choose_landmarks([(r, strings[k]) for k in np.flatnonzero(certain) for r in (rank[k],)], landmarks)
    if not marks:
        return _constant(label)
    rng = np.random.default_rng(11)
    clean = np.flatnonzero(in_clean)
    missed = np.zeros(len(strings), bool)
    hard = missed.copy()
    hard[clean[::max(1, len(clean) // NEGATIVES)]] = True
    shown = certain
    for round_ in range(rounds):
        positive, negative = np.flatnonzero(shown), np.flatnonzero(hard & ~shown)
        disturbed = [_disturbed(strings[k], rng) for k in positive for _ in range(2)]
        disturbed = [u for u in disturbed if u not in number]
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float) + 1e-3 * np.eye(len(marks)))
        to_feature = vectors / np.sqrt(np.maximum(values, 1e-3))  # Nyström: a string's features are its kernels with the landmarks times this
        features = kernel([*(strings[k] for k in positive), *disturbed, *(strings[k] for k in negative)], marks) @ to_feature
        toxic_rows = len(positive) + len(disturbed)
        y = np.concatenate([np.ones(toxic_rows), -np.ones(len(negative))])
        weight = np.concatenate([np.sqrt(in_toxic[positive]), np.full(len(disturbed), 0.3), np.sqrt(in_clean[negative]) * np.where(missed[negative], 3, 1)])
        if len(negative):
            weight[:toxic_rows] *= weight[toxic_rows:].sum() / weight[:toxic_rows].sum()
        w, bias = _svm(features.astype(float), y, weight)
        model = Model(marks, (to_feature @ w).astype(np.float32), bias, 1.0, 0.0)
        if round_ + 1 == rounds:
            break
        rank = Folded(model).margins([u.removeprefix(START) for u in strings])
        # what clean texts reach shows nothing: no string joins below the highest ones of nearly all of them
        tops = [rank[d[d >= 0]].max(initial=-1.0) for d in clean_docs]
        shown = certain | (odds > LEAST_ODDS) & (rank > max(0.0, float(np.quantile(tops, CLEAN_SHARE))))
        wrong = clean[(rank[clean] > -0.8) & ~shown[clean]]
        wrong = wrong[np.argsort(-rank[wrong], kind="stable")][:NEGATIVES]
        missed[wrong] = hard[wrong] = True
        # clean strings that come nearest become landmarks too, so that the machine can tell them apart
        marks = marks + [u for u in _choose_landmarks([(1 + rank[k], strings[k]) for k in wrong], landmarks) if u not in marks]
    judged = np.flatnonzero(held) if held.any() else np.arange(len(docs))
    margin = np.array([m for m, _ in Scorer(model).margins([texts[i] for i in judged])])
    slope, shift = _calibrate(margin, label[judged])
    return Model(marks, model.weights, model.bias, slope, shift)


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = 1500,
                  most_chars: int = 100_000) -> Model:
    """Learn from labelled documents outside the held-out fold.

    Bound: about ``per_class`` texts of each label value, none longer than ``most_chars`` (longer ones teach nothing, but are scored whole).
    """
    rows = labelled_sample(docs, labels, label, folds, held_out, per_class).filter((F.length("_text") <= most_chars)).collect()
    rows = sorted((r._id, r._label, r._text) for r in rows)
    return fit([t for _, _, t in rows], [y == 1 for _, y, _ in rows])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) of every whole text, ``predicted`` (1 from 0.5) and ``worst``, the token behind the score.

    A null text is scored as empty, which has no unit and the score of the bias. Columns of these names are replaced; repeated rows get
    equal scores; an empty table gives an empty result.
    """

    @F.arrow_udf("struct<score:double,worst:string>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            found = []
            for at in range(0, len(texts), 256):
                found += scorer.margins([t or "" for t in texts.slice(at, 256).to_pylist()])
            margin = np.array([m for m, _ in found])
            yield pa.StructArray.from_arrays([pa.array(model.probability(margin), pa.float64()), pa.array([w for _, w in found], pa.string())], ["score", "worst"])

    judged = docs.withColumn("_judged", judge(F.col(text)))
    judged = judged.withColumns({"score": F.col("_judged.score"), "worst": F.col("_judged.worst")}).drop("_judged")
    return judged.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
