"""Feature pipeline that mixes categories, amounts, flags and review text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from vitrine.ml import words


def complete_rows(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Without the given columns, and without rows that lack any value."""
    return df.drop(*drop).dropna("any")


def flags_as_numbers(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags})


def mixed_pipeline(train: DataFrame, categories: Sequence[str], amounts: Sequence[str], flags: Sequence[str], text_column: str | None = "review_text",
                   **bounds) -> PipelineModel:
    """Fitted stages: one-hot without the first category, robust-scaled amounts, 0/1 flags, TF-IDF text.

    Sorting categories backwards and dropping the last leaves out the alphabetically
    first one. ``train`` has its flags as numbers already.
    """
    shaped = Pipeline(stages=[
        StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_vec" for c in categories], dropLast=True),
        VectorAssembler(inputCols=list(amounts), outputCol="amounts"),
        RobustScaler(inputCol="amounts", outputCol="amounts_scaled", withCentering=True, withScaling=True, relativeError=0.0),
    ]).fit(train)
    stages = list(shaped.stages)
    inputs = [f"{c}_vec" for c in categories] + ["amounts_scaled", *flags]
    if text_column:
        stages += words.vectorizer(train, text_column, "text_vec", **bounds)
        inputs.append("text_vec")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages=stages)


def feature_names(model: PipelineModel, categories: Sequence[str], amounts: Sequence[str], flags: Sequence[str]) -> list[str]:
    """The name of each place of ``features``: category=value, amount, flag, then the terms of the text if it takes part."""
    labels = model.stages[0].labelsArray
    names = [f"{c}={value}" for c, values in zip(categories, labels, strict=True) for value in list(values)[:-1]]
    terms = next((s.vocabulary for s in model.stages if hasattr(s, "vocabulary")), [])
    return [*names, *amounts, *flags, *terms]
