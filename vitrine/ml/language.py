"""Language of a text by naive Bayes over character trigrams.

The profile is learnt relationally: trigrams of all labelled texts, counted per language in hashed buckets, merged map-side. It is a small
array of whole numbers a language, so a text is scored inside its row and nothing is shuffled or joined.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.text import bound

# The functions below travel to the workers with each job, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, MOST_LANGUAGES = 8192, 256
#: Texts, and about so many characters, whose trigrams a task holds at a time; a longer text is held alone.
_TEXTS, _CHARACTERS = 1024, 1 << 20
#: Most trigrams that are looked up in a table.
_TABLE = 1 << 21


def _letters(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def trigrams(text: Column) -> Column:
    """Runs of three characters of the lower-cased letters, other characters being one space; none for a text without letters."""
    letters = _letters(text)
    chars = F.split(F.concat(F.lit(" "), letters, F.lit(" ")), "")
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2)))
    return F.when(F.length(letters) > 0, bound(F.filter(chars, lambda c: c != ""), runs)).otherwise(F.array().cast("array<string>"))


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


@dataclass(frozen=True)
class Profile:
    """Log likelihood of each bucket in each language, in whole thousandths (rounded down)."""

    tables: dict[str, list[int]]
    buckets: int = BUCKETS

    def scores(self, buckets: Column) -> Column:
        """(score, place, language) of every language for a list of buckets; later languages have lower places, so the first wins a tie."""
        each = []
        for i, (language, table) in enumerate(sorted(self.tables.items())):
            known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # becomes one literal
            each.append(F.struct(_total(buckets, known).alias("score"), F.lit(-i).alias("place"), F.lit(language).alias("language")))
        return F.array(*each)


def _total(buckets: Column, known: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.get(known, b))


def _lots(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in lots of a bounded size, each with the place of its first."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if i > start and (held > _CHARACTERS or i - start >= _TEXTS):
            yield start, texts[start:i]
            start, held = i, len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def hashed(letters: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every trigram of texts that ``trigrams`` would make of them, given as letters with single spaces.

    A trigram is three code points; each different one is hashed once.
    """
    padded = [f" {t} " if t else "" for t in letters]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in padded], np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, np.maximum(sizes - 2, 0))
    owner = np.repeat(np.arange(len(padded)), np.maximum(sizes - 2, 0))
    begun = np.cumsum(np.maximum(sizes - 2, 0)) - np.maximum(sizes - 2, 0)
    at = first + np.arange(len(owner)) - begun[owner]
    # Characters are numbered as they occur, so that a trigram is a small number and is looked up, not sorted.
    seen = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen)
    small, n = (np.cumsum(seen) - 1)[code], len(alphabet)
    gram = (small[at] * n + small[at + 1]) * n + small[at + 2]
    bucket = lambda k: zlib.crc32((chr(alphabet[k // n // n]) + chr(alphabet[k // n % n]) + chr(alphabet[k % n])).encode()) % buckets
    if n**3 <= _TABLE:
        table = np.zeros(max(n**3, 1), np.int64)
        table[gram] = 1
        used = np.flatnonzero(table)
        table[used] = [bucket(k) for k in used.tolist()]
        return owner, table[gram]
    used, where = np.unique(gram, return_inverse=True)
    return owner, np.array([bucket(k) for k in used.tolist()], np.int64)[where]


def learn(df: DataFrame, text: str = "text", language: str = "lang", buckets: int = BUCKETS) -> Profile:
    """Counts of every trigram of every text with a language, smoothed by one; ``buckets`` lines a language reach the driver.

    Trigrams are counted inside the task, some texts at a time; a line a language and bucket leaves it. The texts are read once.
    """
    known = df.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), _letters(F.col(text)).alias("letters"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for start, lot in _lots(batch.column(1).to_pylist()):
                owner, bucket = hashed(lot, buckets)
                keys, n = np.unique(of[start + owner] * buckets + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // buckets].tolist(), pa.string()), pa.array((keys % buckets).astype(np.int32)), pa.array(n.astype(np.int64))],
                                                 ["language", "bucket", "n"])

    counted = known.mapInArrow(count, "language string, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    # With more lines than this there are more languages than may be.
    lines = counted.limit(MOST_LANGUAGES * buckets + 1).collect()
    languages = {r["language"] for r in lines}
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    tables = {name: [0] * buckets for name in languages}
    for r in lines:
        tables[r["language"]][r["bucket"]] = r["n"]
    return Profile({name: _logs(table) for name, table in tables.items()}, buckets)


def _logs(counts: list[int]) -> list[int]:
    total = float(sum(counts) + len(counts))
    return [math.floor(1000 * math.log((n + 1.0) / total)) for n in counts]


def with_language(df: DataFrame, profile: Profile, text: str = "text", as_name: str = "language") -> DataFrame:
    """Add the likeliest language of the whole text, the first by code on a tie; NULL for a text without letters."""
    if not profile.tables:
        return df.withColumn(as_name, F.lit(None).cast("string"))
    names, buckets = sorted(profile.tables), profile.buckets
    says = np.array([profile.tables[n] for n in names], np.int64)

    @F.pandas_udf("string")
    def likeliest(letters: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for _, lot in _lots([t if isinstance(t, str) else None for t in letters]):
            owner, bucket = hashed(lot, buckets)
            size = np.bincount(owner, minlength=len(lot))
            # whole numbers, far below 2 ** 53, so the sums are exact
            scores = np.stack([np.bincount(owner, s[bucket], minlength=len(lot)) for s in says])
            out += [names[i] if n else None for i, n in zip(scores.argmax(0).tolist(), size.tolist(), strict=True)]
        return pd.Series(out, dtype=object)

    return df.withColumn(as_name, likeliest(_letters(F.col(text))))
