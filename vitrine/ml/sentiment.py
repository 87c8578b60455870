"""Sentiment classifier: split, search, training, metrics, scoring."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.functions import numbers
from vitrine.ml import search as search_, words
from vitrine.operators.ordered import tile_of
from vitrine.operators.placed import numbered, running_totals
from vitrine.session import durable

# Seed, test share, folds and search ranges.
SEED, TEST_SHARE, FOLDS, TRIALS = 30, 0.2, 5, 50
LOGISTIC = {"C": search_.Range(0.01, 10.0, log=True), "max_iter": search_.Range(1000, 3000, step=1), "class_weight": ("balanced", None)}
FEATURES = {"max_features": search_.Range(500, 2500, step=500)}
BAYES = {"var_smoothing": search_.Range(1e-12, 1e-6, log=True)}
# Fixed value: relative change at which fitting stops.
TOLERANCE = 1e-4


def _shuffle_key(doc: str, seed: int) -> Column:
    return F.concat_ws("/", F.md5(F.concat_ws(":", F.lit(seed), F.col(doc).cast("string"))), F.col(doc).cast("string"))


def _parts(df: DataFrame, doc: str, label: str, seed: int, part: Column) -> Column:
    """Part of each row, where ``part`` tells it from the row's place ``_no`` of ``_of`` in a seeded order within its label.

    Only label and key are written durably, so that ``df`` is computed once for them, and ordered
    (in a distributed way); what comes to the driver is the last key of each part, one line per
    label and part. The wide rows are never moved: comparing a row's key with those lines gives its part.
    """
    keys = durable(df.select(F.col(label).alias("_label"), _shuffle_key(doc, seed).alias("_key")))
    placed = numbered(keys, ["_key"], ["_label"], "_no", "_of")
    ends = placed.groupBy("_label", part.alias("_part")).agg(F.max("_key").alias("_end")).collect()
    key, out = _shuffle_key(doc, seed), F.lit(None).cast("int")
    for row in sorted(ends, key=lambda r: (str(r["_label"]), -r["_part"])):
        out = F.when(F.col(label).eqNullSafe(F.lit(row["_label"])) & (key <= row["_end"]), row["_part"]).otherwise(out)
    return out


def split(df: DataFrame, doc: str, label: str = "label", share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Mark exactly the given share of each label as test rows."""
    part = F.when(F.col("_no") <= F.round(F.col("_of") * F.lit(share)), 0).otherwise(1)
    return df.withColumn("is_test", _parts(df, doc, label, seed, part) == 0)


def folded(df: DataFrame, doc: str, label: str = "label", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Fold number 0..folds-1, even within each label."""
    return df.withColumn("fold", _parts(df, doc, label, seed, tile_of(F.col("_no"), F.col("_of"), folds) - 1))


def _weighted(df: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, int]:
    """Row weights, and the row count; one line per label comes to the driver."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    if balanced:
        for value, n in sizes.items():
            weight = F.when(F.col(label) == value, total / (len(sizes) * n)).otherwise(weight)
    return df.withColumn("weight", weight), total


def logistic(train: DataFrame, C: float = 1.0, max_iter: int = 1000, class_weight: str | None = None, label: str = "label", features: str = "features",
             tol: float = TOLERANCE):
    """Fit L2 logistic regression whose penalty equals strength ``C`` on the summed loss."""
    rows, n = _weighted(train, label, class_weight == "balanced")
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (C * n), elasticNetParam=0.0,
                               maxIter=max_iter, tol=tol, standardization=False).fit(rows)
    # The training summary holds on to the session, which tasks cannot be sent once anything in it was observed.
    model._java_obj.setSummary(train.sparkSession.sparkContext._jvm.scala.Option.empty())
    return model


def naive_bayes(train: DataFrame, label: str = "label", features: str = "features"):
    return NaiveBayes(modelType="gaussian", featuresCol=features, labelCol=label).fit(train)


def train(rows: DataFrame, params: dict, **bounds) -> PipelineModel:
    stages = words.vectorizer(rows, **bounds)
    shaped = rows
    for stage in stages:
        shaped = stage.transform(shaped)
    shaped = shaped.select("label", "features").hint("rebalance").persist()
    try:
        model = logistic(shaped, params.get("C", 1.0), params.get("max_iter", 1000), params.get("class_weight"))
    finally:
        shaped.unpersist()
    return PipelineModel(stages=[*stages, model])


# ---------------------------------------------------------------- metrics

def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, names: Sequence[str] = words.LABELS, label: str = "label", prediction: str = "prediction") -> DataFrame:
    cells = confusion(predictions, label, prediction)
    out = cells.groupBy("label").agg(*[F.coalesce(F.sum(F.when(F.col("prediction") == i, F.col("n"))), F.lit(0)).alias(f"predicted_{n.lower()}")
                                       for i, n in enumerate(names)])
    return out.withColumn("actual", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label") + 1)).drop("label")


def _class_scores(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per-class precision, recall, F1 and support as columns of one row; undefined values are 0."""
    n, y, p = F.col("n"), F.col("label"), F.col("prediction")
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("double")
    sums = [F.sum("n").cast("double").alias("all"), total(y == p).alias("right")]
    for i in range(len(names)):
        sums += [total((y == i) & (p == i)).alias(f"tp{i}"), total(p == i).alias(f"said{i}"), total(y == i).alias(f"was{i}")]
    row = cells.agg(*sums)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for i in range(len(names)):
        row = row.withColumns({f"precision{i}": zero(numbers.ratio(F.col(f"tp{i}"), F.col(f"said{i}"))), f"recall{i}": zero(numbers.ratio(F.col(f"tp{i}"), F.col(f"was{i}"))),
                               f"f1{i}": zero(numbers.ratio(2 * F.col(f"tp{i}"), F.col(f"said{i}") + F.col(f"was{i}")))})
    return row


def metrics(predictions: DataFrame, names: Sequence[str] = words.LABELS, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Weighted F1, macro F1, accuracy and per-class scores, all from one confusion count."""
    row = _class_scores(confusion(predictions, label, prediction), names)
    k = range(len(names))
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    out = [pair("weighted_f1", sum((F.col(f"f1{i}") * F.col(f"was{i}") for i in k), F.lit(0.0)) / F.col("all")),
           pair("macro_f1", sum((F.col(f"f1{i}") for i in k), F.lit(0.0)) / len(names)), pair("accuracy", F.col("right") / F.col("all"))]
    for i, name in enumerate(names):
        out += [pair(f"{name}_{m}", F.col(f"{m}{i}")) for m in ("precision", "recall", "f1")]
    return row.select(F.inline(F.array(*out)))


def report(predictions: DataFrame, names: Sequence[str] = words.LABELS, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Classification report: one row per class with its support."""
    row = _class_scores(confusion(predictions, label, prediction), names)
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("class_name"), F.col(f"precision{i}").alias("precision"), F.col(f"recall{i}").alias("recall"),
                                                  F.col(f"f1{i}").alias("f1"), F.col(f"was{i}").cast("bigint").alias("support")) for i, n in enumerate(names)])))


def roc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Points of the ROC curve, best score first, one per distinct score."""
    merged = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    run = running_totals(merged, {"pos": "tp", "neg": "fp"}, [(score, "desc")], totals_as={"pos": "_p", "neg": "_n"})
    return run.select(score, "pos", "neg", "tp", "fp", numbers.ratio(F.col("tp"), F.col("_p")).alias("tpr"), numbers.ratio(F.col("fp"), F.col("_n")).alias("fpr"))


def auc(points: DataFrame) -> DataFrame:
    """Area under the curve from its points (trapezoids, so ties count half)."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return points.agg((area / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))


def leaderboard(spark: SparkSession, scored: dict[str, DataFrame]) -> DataFrame:
    parts = [auc(roc(df)).select(F.lit(name).alias("model"), "auc") for name, df in scored.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.col("auc").desc())


# ---------------------------------------------------------------- search

_RESULT = "model string, trial int, C double, max_iter int, class_weight string, var_smoothing double, max_features int, scores array<double>, mean_f1 double, objective double"


def search(rows: DataFrame, spaces: dict[str, search_.Space], trials: int = TRIALS, seed: int = SEED, at_once: int = 10, size: int = words.VOCABULARY,
           categories: Sequence[str] = (), amounts: Sequence[str] = (), flags: Sequence[str] = (), text: str | None = "review_text", folds: int = FOLDS,
           **bounds) -> DataFrame:
    """Macro F1 of every trial on every fold, best objective first; ``rows`` has label, fold and the named columns.

    ``spaces`` gives, by model (``logistic``, ``naive_bayes``), what its trials choose from. All models share the packed rows; everything a
    pipeline learns is learnt without the fold it is judged on.
    """
    kept = rows.select("label", "fold", *categories, *amounts, *flags, *([text] if text else [])).persist()
    largest = max([size, *[int(s["max_features"].high) for s in spaces.values() if "max_features" in s]])
    prepared = search_.prepare(kept, folds, largest, categories, amounts, flags, text, **bounds)
    packed = search_.blocks(kept, prepared, text)
    try:
        found = [(model, t) for model, space in spaces.items() for t in search_.run(packed, prepared, model, space, trials, seed, at_once, size)]
    finally:
        packed.unpersist()
        kept.unpersist()
    lines = [(model, t["trial"], t.get("C"), t.get("max_iter"), (t["class_weight"] or "none") if "class_weight" in t else None, t.get("var_smoothing"), t["max_features"],
              t["scores"], float(np.mean(t["scores"])), t["objective"]) for model, t in found]
    return rows.sparkSession.createDataFrame(lines, _RESULT).orderBy(F.col("objective").desc(), "model", "trial")


def fold_moments(rows: DataFrame, features: Sequence[str], folds: int = FOLDS, label: str = "label", fold: str = "fold") -> DataFrame:
    """Number, sum and sum of squares of each feature among the training rows of every fold and label, with mean and variance.

    For features that no fold learns. One grouped pass over all rows; a fold's training rows are all rows less its own.
    """
    kept = [e for f in features for e in (F.sum(f).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{f}"))]
    per = rows.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n"), *kept)
    names = ["n", *[f"{k}_{f}" for f in features for k in ("s", "q")]]
    less = lambda name, i: (F.sum(name) - F.coalesce(F.sum(F.when(F.col(fold) == i, F.col(name))), F.lit(0))).alias(f"{name}_{i}")
    wide = per.groupBy(label).agg(*[less(name, i) for name in names for i in range(folds)])
    line = lambda i, f: F.struct(F.lit(i).alias("held_out"), F.lit(f).alias("feature"), F.col(f"n_{i}").alias("n"), F.col(f"s_{f}_{i}").cast("double").alias("total"),
                                 F.col(f"q_{f}_{i}").cast("double").alias("square"))
    long = wide.select(label, F.inline(F.array(*[line(i, f) for i in range(folds) for f in features])))
    mean = numbers.ratio(F.col("total"), F.col("n"))
    return long.withColumns({"mean": mean, "variance": numbers.ratio(F.col("square"), F.col("n")) - mean * mean})


# ---------------------------------------------------------------- scoring and storage

def scored(model: PipelineModel, df: DataFrame, names: Sequence[str] = words.LABELS) -> DataFrame:
    """Label name and confidence of each row; a code without a name is 'Unknown'."""
    code = F.col("prediction").cast("int")
    known = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, n)])
    return model.transform(df).select(*df.columns, F.coalesce(F.try_element_at(known, code), F.lit("Unknown")).alias("sentiment_label"),
                                      F.array_max(vector_to_array("probability")).alias("confidence"))


def save(model: PipelineModel, path: str, names: Sequence[str] = words.LABELS) -> None:
    model.write().overwrite().save(posixpath.join(path, "pipeline"))
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({str(i): n for i, n in enumerate(names)}),)], "value string").coalesce(1).write.mode("overwrite").text(posixpath.join(path, "labels"))


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    names = json.loads(spark.read.text(posixpath.join(path, "labels")).first()["value"])
    return PipelineModel.load(posixpath.join(path, "pipeline")), [names[k] for k in sorted(names, key=int)]


def importance(model: PipelineModel, top: int = 20) -> DataFrame:
    """Terms with the largest coefficients; both lists are bounded by the vocabulary."""
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    weights = model.stages[-1].coefficients.toArray().tolist()
    return _top_features(list(zip(vocabulary, weights)), top)


def coefficients(names: Sequence[str], model, top: int = 20) -> DataFrame:
    """Named features with the largest coefficients of a logistic model."""
    return _top_features(list(zip(names, model.coefficients.toArray().tolist(), strict=True)), top)


def mean_difference(names: Sequence[str], means, top: int = 20) -> DataFrame:
    """Features whose class means differ most (Gaussian model)."""
    matrix = means.toArray()
    return _top_features([(n, abs(float(a - b))) for n, a, b in zip(names, matrix[1], matrix[0])], top)


def _top_features(pairs: list[tuple[str, float]], top: int) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.abs("importance").desc(), "feature").limit(top)
