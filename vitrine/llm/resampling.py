"""Importance resampling towards a target: array-scored weights, exact selection by weighted medians of medians.

Word n-grams are counted in hashed buckets over all documents and over the target's texts; a bucket's gain is the logarithm of the ratio
of its shares. Gains are one array of fixed length, so a document's weight is a sum of array look-ups inside its row. With Gumbel noise
drawn from the id, the highest scores are a sample without replacement in proportion to the weights.

The cut-off is found without sorting all rows: every partition names the median of the keys still in question, the median of those medians,
weighted by how many keys each stands for, splits them, and at least a quarter falls away each round. Only the winners are then sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import durable
from vitrine.llm.merkle import lower_ascii
from vitrine.operators.ordered import numbered

#: Parameters of the registered query.
LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10

#: With no more keys in question than this, they are ranked where the rounds are steered.
FINISH = 1024

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters a-z, digits and characters beyond ASCII, once A-Z are in lower case; a null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def grams(listed: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included."""
    def of_length(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(listed) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(listed))
        return F.transform(starts, lambda i: F.array_join(F.slice(listed, i, n), " "))

    return listed if longest == 1 else F.concat(listed, *[of_length(n) for n in range(2, longest + 1)])


def bucket_of(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket. Counts cover every text of both tables and are merged map-side; at most ``buckets`` lines reach the driver."""
    both = docs.select(F.col(text).alias("_text"), F.lit(0).alias("_side")).unionAll(target.select(F.col(text).alias("_text"), F.lit(1).alias("_side")))
    each = both.select("_side", F.explode(grams(words(F.col("_text")), longest)).alias("_gram"))
    lines = each.groupBy(bucket_of(F.col("_gram"), buckets).alias("_bucket")).agg(
        F.count_if(F.col("_side") == 0).alias("s"), F.count_if(F.col("_side") == 1).alias("t")).collect()
    found = {r["_bucket"]: (r["s"], r["t"]) for r in lines}
    all_s, all_t = (float(sum(pair[side] for pair in found.values()) + buckets) for side in (0, 1))
    out = []
    for b in range(buckets):
        s, t = found.get(b, (0, 0))
        out.append(math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))))
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the id's digest; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: list[int], text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of each row."""
    listed = docs.select("doc_id", words(F.col(text)).alias("_words"))
    # folded into one literal array by the optimizer; rows look up in it, nothing is joined
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(grams(F.col("_words"), longest), F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, bucket_of(g, len(gain))))
    n = F.size("_words").cast("long")
    counted = sum((F.greatest(n - m, F.lit(0).cast("long")) for m in range(1, longest)), n)
    return listed.select("doc_id", n.alias("n_words"), counted.alias("n_features"), total.alias("weight")).withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed))


# ---------------------------------------------------------------- selection

Key = tuple[int, int]  # score and id: a higher score is better, then a smaller id

_LAST = (1 << 63) - 1
_LINE = pa.schema([(f"{side}_{what}", pa.int64()) for side in ("over", "under") for what in ("n", "score", "id")] + [("same_n", pa.int64())])


def _better(score: np.ndarray, ids: np.ndarray, than: Key) -> np.ndarray:
    return (score > than[0]) | ((score == than[0]) & (ids < than[1]))


def _worse(score: np.ndarray, ids: np.ndarray, than: Key) -> np.ndarray:
    return (score < than[0]) | ((score == than[0]) & (ids > than[1]))


def _open_keys(batches: Iterable[pa.RecordBatch], best: Key | None, worst: Key | None) -> tuple[np.ndarray, np.ndarray]:
    """A partition's keys strictly between the two bounds: two numbers a row, no more than the partition has rows."""
    scores, ids = [], []
    for batch in batches:
        score, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        keep = np.ones(len(score), bool)
        if best is not None:
            keep &= _worse(score, doc, best)
        if worst is not None:
            keep &= _better(score, doc, worst)
        scores.append(score[keep])
        ids.append(doc[keep])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *scores]), np.concatenate([empty, *ids])


def _median(score: np.ndarray, ids: np.ndarray) -> tuple[int, int | None, int | None]:
    if not len(score):
        return 0, None, None
    order = np.lexsort((ids, -score))
    middle = order[(len(order) - 1) // 2]
    return len(score), int(score[middle]), int(ids[middle])


def _round(keys: DataFrame, best: Key | None, worst: Key | None, pivot: Key | None) -> list:
    """One line a partition: number and median of its open keys that are better and worse than the pivot (no pivot: all count as worse)."""

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = _open_keys(batches, best, worst)
        over = np.zeros(len(score), bool) if pivot is None else _better(score, ids, pivot)
        under = np.ones(len(score), bool) if pivot is None else _worse(score, ids, pivot)
        values = [*_median(score[over], ids[over]), *_median(score[under], ids[under]), int(len(score) - over.sum() - under.sum())]
        yield pa.RecordBatch.from_pydict(dict(zip(_LINE.names, [[v] for v in values], strict=True)), _LINE)

    shape = ", ".join(f"{name} bigint" for name in _LINE.names)
    return keys.mapInArrow(line, shape).filter("over_n + under_n + same_n > 0").collect()


def _weighted_median(lines: list, side: str) -> Key:
    medians = sorted(((r[f"{side}_score"], r[f"{side}_id"], r[f"{side}_n"]) for r in lines if r[f"{side}_n"]), key=lambda m: (-m[0], m[1]))
    half, seen = sum(m[2] for m in medians) / 2, 0
    for score, doc, n in medians:
        seen += n
        if seen >= half:
            return score, doc
    raise ValueError("no key is open")


def cutoff(keys: DataFrame, take: int, finish: int = FINISH) -> Key | None:
    """The key of the ``take``-th best row of ``keys`` (score, id), ties counted; None where there is no such row.

    Exact at any size. A partition reports one line a round, so the driver holds as many lines as there are partitions.
    """
    if take < 1:
        return None
    lines, side, best, worst = _round(keys, None, None, None), "under", None, None
    while True:
        left = sum(r[f"{side}_n"] for r in lines)
        if left < take:
            return None
        if left <= finish:
            found = keys
            bound = lambda than, up: (F.col("score") > than[0]) | ((F.col("score") == than[0]) & (F.col("id") < than[1])) if up else (
                (F.col("score") < than[0]) | ((F.col("score") == than[0]) & (F.col("id") > than[1])))
            for than, up in ((best, False), (worst, True)):
                found = found if than is None else found.filter(bound(than, up))
            ranked = sorted(((r["score"], r["id"]) for r in found.collect()), key=lambda k: (-k[0], k[1]))
            return ranked[take - 1]
        pivot = _weighted_median(lines, side)
        lines = _round(keys, best, worst, pivot)
        over, same = (sum(r[n] for r in lines) for n in ("over_n", "same_n"))
        if take <= over:
            side, worst = "over", pivot
        elif take <= over + same:
            return pivot
        else:
            side, best, take = "under", pivot, take - over - same


def drawn(rows: DataFrame, eligible: Column, percent: int = PERCENT, finish: int = FINISH) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... for the ``percent`` per cent of eligible rows with the best keys, null for all others.

    ``rows`` (doc_id, score and more) must not change when computed anew; :func:`resampled` hands in durable ones.
    """
    keys = rows.filter(eligible).select("score", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"))
    take = keys.count() * percent // 100
    last = cutoff(keys, take, finish)
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    wins = eligible & ((F.col("score") > last[0]) | ((F.col("score") == last[0]) & (place <= last[1])))
    # rows with the very key of the last one may be more than are left to draw; their order is that of all their columns
    order = [F.col("score").desc(), place.asc(), *[F.col(c).asc() for c in rows.columns if c not in ("score", "doc_id")]]
    winners = numbered(rows.filter(wins), order, (), "rank").withColumn("rank", F.when(F.col("rank") <= take, F.col("rank").cast("long")))
    return winners.unionByName(rows.filter(~wins).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
              least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``, drawn towards the texts of ``target``.

    Null and empty texts have no words, weight 0 and are never drawn. Equal scores go to the smaller id, a null id comes last. Rows with
    the same id are rows of their own and compete with the same noise. An empty target gives gains from the documents alone; no documents
    give no rows. Further columns are not read, so their names do not matter.
    """
    gain = gains(docs, target, text, longest, buckets)
    rows = durable(scored(docs, gain, text, longest, seed))
    return drawn(rows, F.col("n_words") >= least_words, percent)
