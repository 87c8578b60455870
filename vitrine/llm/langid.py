"""Language identification by nearest centroid."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import bounded_sample, fold_of
from vitrine.llm.features import count_grams, groups_of

ORDERS = (1, 2, 3)
BITS = 12


@dataclass(frozen=True)
class Centroids:
    """``centres`` (unit rows), the language of each, the least cosine that each accepts, and the weights of n-grams."""

    centres: np.ndarray
    languages: list[str]
    least: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        if not len(self.centres):
            return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        near = unit_vectors(texts, self.weights) @ self.centres.T
        best = near.argmax(1)
        cosine = near[np.arange(len(texts)), best]
        return [self.languages[i] for i in best], np.clip(cosine, 0, 1), cosine >= self.least[best]


_OTHER = re.compile(r"[\W\d_]+")


def _words_only(text: str) -> str:
    """Lower case, every run of other characters than letters as one space: marks say little about a language."""
    return _OTHER.sub(" ", text.lower())


def unit_vectors(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; the term count goes in by its logarithm."""
    grams = np.log1p(count_grams([_words_only(t) for t in texts], ORDERS, BITS)) * weights
    return grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the first centre is nearest to the mean, each next one the vector farthest from those chosen."""
    mean = vectors.mean(0)
    chosen = [int(np.argmax(vectors @ mean))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centres = vectors[chosen]
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[owner == i].sum(0) if (owner == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (vectors @ centres.T).argmax(1)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(texts: list[str], languages: list[str], per_language: int = 4, slack: float = 0.5) -> Centroids:
    """Cluster the texts of each language. A centroid accepts cosines down to ``slack`` times the lowest 1 % of its own members."""
    if not texts:
        return Centroids(np.zeros((0, 1 << BITS), np.float32), [], np.zeros(0), np.ones(1 << BITS, np.float32))
    seen = np.zeros(1 << BITS)
    for some in groups_of(texts, 256):
        seen += (count_grams([_words_only(t) for t in some], ORDERS, BITS) > 0).sum(0)
    weights = np.log((1 + len(texts)) / (1 + seen)).astype(np.float32) + 1
    vectors = np.concatenate([unit_vectors(some, weights) for some in groups_of(texts, 256)])
    centres, names, least = [], [], []
    for language in sorted(set(languages)):
        own = vectors[[x == language for x in languages]]
        found, owner = _clusters(own, per_language)
        for i, centre in enumerate(found):
            near = own[owner == i] @ centre
            centres.append(centre)
            names.append(language)
            least.append(slack * float(np.quantile(near, 0.01)) if len(near) else 1.0)
    return Centroids(np.stack(centres).astype(np.float32), names, np.array(least), weights)


def fit_documents(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = 600) -> Centroids:
    """Learn from ``text`` and ``lang`` outside the held-out fold.

    Bound: about ``per_language`` texts of each language (null texts, and those without a letter, teach nothing).
    """
    rows = docs.filter(F.col("lang").isNotNull() & (fold_of("doc_id", folds) != held_out))
    picked = bounded_sample(rows.select("doc_id", "lang", "text"), "doc_id", "lang", per_language).collect()
    taught = sorted((r.doc_id is None, r.doc_id or 0, r.lang, r.text) for r in picked if _has_letter(r.text))
    return fit([t[3] for t in taught], [t[2] for t in taught])


def predict(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``accepted`` (near enough to that centroid).

    A null text, one without a letter, and any text under a model that was taught nothing get ``und``, 0 and not accepted. Columns of the
    three names are replaced, the others pass through; repeated rows are judged each; equal cosines go to the language first in order.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            names, scores, accepted = [], [], []
            for some in groups_of(column, 256):
                texts = some.to_pylist()
                lettered = [_has_letter(t) for t in texts]
                found, cosine, near = model.predict([t or "" for t in texts])
                for ok, name, c, a in zip(lettered, found, cosine.tolist(), near.tolist(), strict=True):
                    ok = ok and name is not None
                    names.append(name if ok else "und")
                    scores.append(float(c) if ok else 0.0)
                    accepted.append(bool(a) and ok)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["lang_pred", "score", "accepted"])

    found = docs.withColumn("_found", nearest(F.col(text)))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "accepted")}).drop("_found")
