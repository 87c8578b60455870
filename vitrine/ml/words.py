"""Review text to labelled tokens and TF-IDF weights."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import rules, text
from vitrine.ml import lemma
from vitrine.session import durable

# The functions below travel to the workers with each job, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vocabulary bounds and shortest review.
MIN_DOCS, MAX_SHARE, VOCABULARY, MIN_WORDS = 7, 0.8, 2000, 3
# Label names by code.
LABELS = ("Negative", "Positive")

#: Terms that a task counts at a time.
_LINES = 200_000
#: Words by which pairs are chosen, at most, as a multiple of the vocabulary's size.
_KNOWN = 8

TERMS_SQL = r"""SELECT *, get(transform(array(regexp_extract_all({column}, '(?U)\\b\\w\\w+\\b', 0)), w -> concat(w,
    if(size(w) > 1, transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])), slice(w, 1, 0)))), 0) AS terms FROM __THIS__"""


def labelled(df: DataFrame, text_column: str = "review_text", score: str = "review_score") -> DataFrame:
    return df.filter(F.col(text_column).isNotNull()).select(score, text_column)


def prepared(df: DataFrame, keep: Sequence[str] = (), text_column: str = "review_text", score: str = "review_score") -> DataFrame:
    """Clean text with its sentiment; words are counted before cleaning."""
    long_enough = df.filter(F.col(text_column).isNotNull() & text.has_words(F.col(text_column), MIN_WORDS))
    # A filter on a generated column is not pushed below it, so the text is cleaned once.
    clean = F.explode_outer(F.array(text.clean_for_model(F.col(text_column)))).alias("review_text")
    return long_enough.select(*keep, clean, rules.sentiment_of(F.col(score)).alias("sentiment")).filter(F.length("review_text") > 0)


def with_label(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """Alphabetical codes: 0 Negative, 1 Positive."""
    return df.withColumn("label", F.when(F.col(sentiment) == LABELS[1], 1.0).when(F.col(sentiment) == LABELS[0], 0.0))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """Code of each distinct label in sorted order."""
    from vitrine.operators.impute import ordinal_codes

    return ordinal_codes(df, column).select(F.col(column).alias("label_name"), "code")


def terms(column: str) -> Column:
    """Words of two or more letters or digits, then the pairs of neighbours."""
    words = F.regexp_extract_all(F.col(column), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return text.bound(words, lambda w: F.concat(w, F.when(
        F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1]))).otherwise(F.slice(w, 1, 0))))


def content_words(column: str, stop_words: Sequence[str] = lemma.CLOSED_CLASSES, kept: Sequence[str] = ("não",), shortest: int = 3) -> Column:
    """Dictionary forms of the words of open classes, without stop words (save the kept ones) and without short words."""
    found = F.split(F.btrim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " ")), " ")
    dropped = [w for w in stop_words if w not in kept]
    open_class = F.filter(found, lambda w: ~w.isin(dropped) & (F.length(w) >= shortest))
    return F.array_join(F.transform(open_class, lambda w: lemma.lemma(w)), " ")


def _words(column: str) -> Column:
    """The words of ``terms`` between single spaces, which no word holds."""
    return F.array_join(F.regexp_extract_all(F.col(column), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), " ")


def _listed(words: str) -> list[str]:
    """What ``terms`` gives for a text, from its words."""
    w = words.split(" ") if words else []
    return [*w, *map(" ".join, zip(w, w[1:]))]


def _single(words: str) -> list[str]:
    return words.split(" ") if words else []


def _pairs(known: frozenset[str] | None) -> Callable[[str], list[str]]:
    """Lists the pairs of neighbours of a text; with ``known``, only those of two known words."""

    def listed(words: str) -> list[str]:
        w = _single(words)
        return [f"{a} {b}" for a, b in zip(w, w[1:]) if known is None or a in known and b in known]

    return listed


def _counted(rows: DataFrame, doc: str) -> DataFrame:
    """Uses of each term in each row of ``doc`` and ``words``, as ``_words`` gives them; lines leave the task ``_LINES`` at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, uses = [], [], []

            def lines() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(uses, pa.int64())], [doc, "term", "tf"])

            for i, words in enumerate(batch.column(1)):
                found = Counter(_listed(words.as_py() or ""))
                at.extend([i] * len(found))
                names.extend(found)
                uses.extend(found.values())
                if len(at) >= _LINES:
                    yield lines()
                    at, names, uses = [], [], []
            if at:
                yield lines()

    return rows.mapInArrow(count, f"`{doc}` {rows.schema[doc].dataType.simpleString()}, term string, tf bigint")


def term_counts(df: DataFrame, doc: str, column: str = "review_text") -> DataFrame:
    """Occurrences of each term in each document, one line per (document, term).

    Terms are counted inside their row, which is all for a document of one row, so neither a table of terms is held nor a term shuffled.
    Only the rows of documents that come several times meet by document and term. Those are found by their ids, from words written durably,
    so that no text is read or cleaned twice.
    """
    rows = durable(df.select(doc, _words(column).alias("words")))
    several = durable(rows.groupBy(doc).count().filter("count > 1").select(F.col(doc).alias("_several")))
    if several.isEmpty():
        return _counted(rows, doc)
    same = F.col(doc).eqNullSafe(F.col("_several"))
    met = _counted(rows.join(several, same, "left_semi"), doc).groupBy(doc, "term").agg(F.sum("tf").alias("tf"))
    return _counted(rows.join(several, same, "left_anti"), doc).union(met)


def tallied(df: DataFrame, column: str = "review_text", fold: str | None = None, words: Column | None = None, listed: Callable[[str], list[str]] = _listed) -> DataFrame:
    """Uses of each term (``use``) and texts that hold it (``doc``), and the texts under no term; several lines a term, to be added up.

    A task counts its texts in a table that leaves it whenever it holds ``_LINES`` terms. Texts that are NULL do not count.
    ``words`` holds what ``_words`` gives where that is there already; ``listed`` gives the terms of them that are counted.
    """
    rows = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), (_words(column) if words is None else words).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def lines() -> pa.RecordBatch:
            found = [(f, t, n, docs[t]) for f, (use, docs, _) in held.items() for t, n in use.items()]
            found += [(f, None, 0, texts) for f, (_, _, texts) in held.items()]
            columns = [list(c) for c in zip(*found)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["fold", "term", "use", "doc"])

        for batch in batches:
            for f, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words is None:
                    continue
                here = held.setdefault(f, [Counter(), Counter(), 0])
                found = listed(words)
                here[0].update(found)
                here[1].update(set(found))
                here[2] += 1
                if sum(len(use) for use, _, _ in held.values()) >= _LINES:
                    yield lines()
        if held:
            yield lines()

    return rows.mapInArrow(count, "fold int, term string, use bigint, doc bigint")


def vocabulary(df: DataFrame, column: str = "review_text", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, size: int = VOCABULARY) -> DataFrame:
    """Most frequent terms within the document-share bounds, ties by term, with smoothed inverse document frequency.

    A pair of neighbours is used no more often, and in no more texts, than either of its words. So words are counted first, and then
    only the pairs of words that come in enough texts and as often as the last word that ``size`` words alone would let in. These words
    come to the driver, unless ties make them more than ``_KNOWN`` times ``size``: then the pairs of all words are counted.

    Uses and documents are counted in one shuffle, merged map-side. Documents are also counted under no term. Words and totals of
    frequent terms are written durably, so that the texts are read and cleaned once.
    """
    rows = durable(df.select(_words(column).alias("words")))

    def totals(listed: Callable[[str], list[str]]) -> DataFrame:
        found = tallied(rows, words=F.col("words"), listed=listed).groupBy("term").agg(F.sum("doc").alias("df"), F.sum("use").alias("tf"))
        return durable(found.filter(F.col("term").isNull() | (F.col("df") >= min_docs)))

    single = totals(_single)
    docs = single.agg(F.max(F.when(F.col("term").isNull(), F.struct("df", "tf"))).alias("d")).first()["d"]
    within = F.col("term").isNotNull() & (F.col("df") >= min_docs) & (F.col("df") <= max_share * F.lit(docs["df"] if docs else None).cast("bigint"))
    first = F.col("tf").desc(), F.col("term")
    leading = single.filter(within).orderBy(*first).limit(size).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    least = leading["tf"] if leading["n"] >= size else 0
    known = [r["term"] for r in single.filter(F.col("term").isNotNull() & (F.col("tf") >= least)).select("term").limit(_KNOWN * size + 1).collect()]
    both = single.union(totals(_pairs(frozenset(known) if len(known) <= _KNOWN * size else None)))
    kept = both.filter(within).withColumn("_docs", F.lit(docs["df"] if docs else None).cast("bigint"))
    idf = F.log((1 + F.col("_docs")) / (1 + F.col("df"))) + 1
    return kept.orderBy(*first).limit(size).select("term", "df", "tf", idf.alias("idf"))


def tfidf(df: DataFrame, doc: str, column: str = "review_text", **bounds) -> DataFrame:
    """Unit-length TF-IDF weights, one line per (document, vocabulary term).

    Terms are looked up, counted, weighted and normalised inside their row; lines leave it last, and nothing but the vocabulary is
    shuffled. Its lines, at most its size limit, come to the driver. Each row is a document of its own.
    """
    idf = {r["term"]: r["idf"] for r in vocabulary(df, column, **bounds).collect()}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, weights = [], [], []
            for i, words in enumerate(batch.column(1).to_pylist()):
                found = sorted((t, n * idf[t]) for t, n in Counter(_listed(words or "")).items() if t in idf)
                length = math.sqrt(sum(w * w for _, w in found))
                at += [i] * len(found)
                names += [t for t, _ in found]
                weights += [w / length for _, w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(weights, pa.float64())], [doc, "term", "weight"])

    return df.select(doc, _words(column).alias("words")).mapInArrow(weigh, f"`{doc}` {df.schema[doc].dataType.simpleString()}, term string, weight double")


def vectorizer(train: DataFrame, column: str = "review_text", out: str = "features", **bounds) -> list:
    """Fitted pipeline stages from text to unit-length TF-IDF vectors.

    Only the vocabulary (at most its size limit) comes to the driver.
    """
    return vectorizer_of(vocabulary(train, column, **bounds).collect(), column, out)


def vectorizer_of(known: Sequence, column: str = "review_text", out: str = "features") -> list:
    """The same stages from a vocabulary already learnt: rows with ``term`` and ``idf``."""
    listed = SQLTransformer(statement=TERMS_SQL.replace("{column}", column))
    counted = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="terms", outputCol="term_counts")
    weighted = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="term_counts", outputCol="term_weights")
    return [listed, counted, weighted, Normalizer(p=2.0, inputCol="term_weights", outputCol=out)]
