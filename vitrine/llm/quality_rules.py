"""Quality rules as a learned decision list over text statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import agreed, bounded_sample, durable

_BLANKS = " \t\n\v\f\r"
_UPPER = re.compile(f"[A-Z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xDE)}]")
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines", "n_distinct", "n_same")
#: What rules may test: a name, and the expression over the counts. Shares lie between 0 and 1.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "same_share": "n_same / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
}


def _in_repeated(words: np.ndarray, size: int = 5) -> int:
    """Places of ``words`` (numbers of words) that lie in a window of ``size`` (5) words found twice or more."""
    n = len(words)
    if n <= size:
        return 0
    # rank pairs, pairs of pairs, then those with the fifth word: equal ranks are equal windows, without hashing
    rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    two = rank(words[:-1], words[1:])
    four = rank(two[:-2], two[2:])
    _, five, often = np.unique(four[:-1] * (int(words.max()) + 1) + words[4:], return_inverse=True, return_counts=True)
    edge = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(often[five] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS``. Words are runs without space, tab, line feed, vertical tab, form feed or return."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at these six characters only
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = Counter(line for line in text.split("\n") if line.strip(_BLANKS)) if "\n" in text else {}
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    upper = len(_UPPER.findall(text))
    marks = len(raw) - len(raw.translate(None, b"!?~^=+\\/{}[]@_\"`"))
    other = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"))
    return (
        len(words), word_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), sum(lines.values()) - len(lines) if lines else 0,
        _in_repeated(numbers), upper, max(0, word_chars - other), marks, sum(lines.values()) if lines else min(1, len(words)),
        len(seen), int((numbers[1:] == numbers[:-1]).sum()),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of every whole text (all 0 for a null or empty one) and ``base_failed``; columns of these names are replaced."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in _COUNTS) + ">")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(_COUNTS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_COUNTS))], list(_COUNTS))

    counted = docs.withColumn("_counts", counts(F.col(text)))
    counted = counted.withColumns({c: F.col(f"_counts.{c}") for c in _COUNTS}).drop("_counts")
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition (feature, "<=" or ">", threshold) get ``keep``."""

    conditions: tuple[tuple[str, str, float], ...]
    keep: bool
    covered: int
    wrong: int

    def column(self) -> Column:
        met = F.lit(True)
        for feature, sign, threshold in self.conditions:
            value = F.expr(FEATURES[feature])
            met = met & (value <= F.lit(threshold) if sign == "<=" else value > F.lit(threshold))
        return met


def _met(values: np.ndarray, conditions: Sequence[tuple[int, str, float]]) -> np.ndarray:
    met = np.ones(len(values), bool)
    for f, sign, threshold in conditions:
        met &= values[:, f] <= threshold if sign == "<=" else values[:, f] > threshold
    return met


def _best_condition(values: np.ndarray, bad: np.ndarray, met: np.ndarray, weight: np.ndarray) -> tuple | None:
    """The threshold condition with the largest information gain for rejecting, among rows already met, which count ``weight`` each."""
    if not bad[met].any() or bad[met].all():
        return None
    p, n = float(weight[met & bad].sum()), float(weight[met & ~bad].sum())
    before, best = np.log2(p / (p + n)), None
    for f in range(values.shape[1]):
        order = np.argsort(values[met, f], kind="stable")
        x, heavy = values[met, f][order], weight[met][order]
        heavy_bad = heavy * bad[met][order]
        ends = np.flatnonzero(x[1:] > x[:-1])
        if not len(ends):
            continue
        (left_bad, right_bad), (left, right) = ((np.cumsum(w)[ends], np.cumsum(w[::-1])[len(w) - 2 - ends]) for w in (heavy_bad, heavy))
        for sign, hit, total in (("<=", left_bad, left), (">", right_bad, right)):
            gain = np.where(hit > 0, hit * (np.log2(np.where(hit > 0, hit, 1) / total) - before), 0)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), (f, sign, float((x[ends[at]] + x[ends[at] + 1]) / 2)))
    return best and best[1]


def learn_rules(values: np.ndarray, bad: np.ndarray, names: Sequence[str], most_rules: int = 12, most_conditions: int = 4,
                least_precision: float = 0.9, least_covered: int = 8, weight: np.ndarray | None = None) -> list[Rule]:
    """A decision list for rejecting, by sequential covering.

    A rule grows on two thirds of the rows by adding the condition of largest information gain until it covers no row to keep, is then
    pruned on the other third (trailing conditions go while precision there does not fall), and is taken while its precision over all
    rows not yet covered is at least ``least_precision``; the rows it covers leave. The last rule, without condition, keeps.

    A row stands for ``weight`` rows (1) in gain, pruning and precision; ``least_covered`` and the numbers in the rules count rows given.
    """
    weight = np.ones(len(bad)) if weight is None else weight
    left, rules = np.ones(len(bad), bool), []
    prune_part = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and bad[left].sum() >= least_covered:
        grow, check = left & ~prune_part, left & prune_part
        conditions: list[tuple[int, str, float]] = []
        met = grow.copy()
        while len(conditions) < most_conditions and (found := _best_condition(values, bad, met, weight)):
            conditions.append(found)
            met = grow & _met(values, conditions)
        if not conditions:
            break

        def worth(some: list) -> float:
            hit = check & _met(values, some)  # noqa: B023  used at once
            return (weight[hit & bad].sum() + 0.5) / (weight[hit].sum() + 1)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = left & _met(values, conditions)
        covered, wrong = int(hit.sum()), int((hit & ~bad).sum())
        if covered < least_covered or 1 - weight[hit & ~bad].sum() / weight[hit].sum() < least_precision:
            break
        rules.append(Rule(tuple((names[f], s, t) for f, s, t in conditions), False, covered, wrong))
        left &= ~hit
    rules.append(Rule((), True, int(left.sum()), int((left & bad).sum())))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one conditional expression: the first rule that is met decides."""
    out = F.lit(rules[-1].keep)
    for rule in reversed(rules[:-1]):
        out = F.when(rule.column(), F.lit(rule.keep)).otherwise(out)
    return out


def fit_rules(measured: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 20_000) -> list[Rule]:
    """Learn from the statistics of labelled documents outside fold 0 of 5 that the base does not reject already.

    Bound: about ``per_class`` rows of each label value are read to the driver, a few numbers each. Ids whose labels disagree are left out.
    A row weighs as many rows of its label as there are for each one read, so class shares are those of all rows.
    """
    known = agreed(labels, label, 5, 0)
    rows = measured.filter("not base_failed").join(known, F.col("doc_id") == F.col("_id")).select("_id", "_label", *[F.expr(v).alias(f) for f, v in FEATURES.items()])
    rows = durable(rows)
    totals = dict(rows.groupBy("_label").agg(F.count(F.lit(1))).collect())
    sample = bounded_sample(rows, "_id", "_label", per_class).orderBy("_id").collect()
    if not sample:
        return [Rule((), True, 0, 0)]
    read = Counter(r[1] for r in sample)
    weight = np.array([totals[r[1]] / read[r[1]] for r in sample])
    return learn_rules(np.array([r[2:] for r in sample], float), np.array([r[1] == 0 for r in sample]), list(FEATURES), weight=weight)


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Statistics of all ``docs`` (without the text), ``base_failed``, ``kept``, and the number of the deciding ``rule``; and the list.

    Texts are read once: the statistics are written durably, and learning and verdicts read those. A null text has counts of 0 and fails
    the base; repeated rows are judged each; an empty table gives an empty result and the list that keeps all.
    """
    measured = durable(with_statistics(docs, text).drop(text))
    rules = fit_rules(measured, labels, label)
    number = F.lit(len(rules) - 1)
    for i in reversed(range(len(rules) - 1)):
        number = F.when(rules[i].column(), F.lit(i)).otherwise(number)
    judged = measured.withColumns({"kept": ~F.col("base_failed") & verdict(rules), "rule": F.when(~F.col("base_failed"), number)})
    return judged, rules
