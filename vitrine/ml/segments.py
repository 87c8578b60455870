"""Customer segments: scaled behaviour, K-means, principal components, named profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from vitrine.functions import numbers

# Segment profiles as published (scaled monetary, delivery time, recency, review score, gave review).
PROFILE_FEATURES = ("monetary", "avg_delivery_time", "recency", "review_score", "gave_review")
PROFILES = {
    "Champions": (0.98, 0.33, -0.35, 0.74, 0.70),
    "Frustrated Critics": (0.13, 0.75, -0.03, -1.85, 0.71),
    "Dormant Advocates": (-0.33, 0.08, 1.05, 0.71, 0.71),
    "Silent Disengaged": (-0.03, 0.01, 0.02, -0.65, -1.40),
    "Promising Newcomers": (-0.56, -0.80, -0.77, 0.75, 0.71),
}


def behaviour(rfm: DataFrame, fact_orders: DataFrame) -> DataFrame:
    """RFM features plus mean score and share of orders with a written review, per customer."""
    reviews = fact_orders.filter(F.col("order_status") == "delivered").groupBy("customer_unique_id").agg(
        numbers.ratio(F.sum("review_score"), F.count("review_score")).alias("review_score"),
        numbers.ratio(F.count("review_text"), F.count(F.lit(1))).alias("gave_review"))
    both = rfm.join(reviews, "customer_unique_id")
    return both.select("customer_unique_id", *[F.col(c).cast("double").alias(c) for c in
                                               ("recency", "frequency", "monetary", "avg_delivery_time", "category_diversity", "review_score", "gave_review")]).dropna()


def fit_segments(df: DataFrame, features: Sequence[str] = PROFILE_FEATURES, k: int = 5, seed: int = 42, components: int = 3) -> PipelineModel:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster"),
        PCA(k=components, inputCol="scaled", outputCol="components"),
    ]).fit(df)


def named_clusters(model: PipelineModel) -> dict[int, str]:
    """Match cluster centres to the published profiles with the least total distance (five by five)."""
    centres = [c.tolist() for c in model.stages[2].clusterCenters()]
    gap = lambda c, p: sum((a - b) ** 2 for a, b in zip(c, p))
    names = list(PROFILES)
    if len(centres) > len(names):
        raise ValueError(f"there are {len(names)} published profiles, so at most that many clusters can be named")
    best = min(permutations(names, len(centres)), key=lambda order: sum(gap(c, PROFILES[n]) for c, n in zip(centres, order)))
    return dict(enumerate(best))


def segmented(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Each customer with cluster, segment name and component scores."""
    names = named_clusters(model)
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = vector_to_array("components")
    return model.transform(df).select(*df.columns, "cluster", lookup[F.col("cluster")].alias("segment"), "scaled",
                                      *[parts[i].alias(f"pc{i + 1}") for i in range(model.stages[3].getK())])


def profile_matrix(customers: DataFrame, features: Sequence[str] = PROFILE_FEATURES) -> DataFrame:
    """Mean scaled value of each feature per segment, with its size."""
    scaled = vector_to_array("scaled")
    return customers.groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("customers"), *[F.avg(scaled[i]).alias(f) for i, f in enumerate(features)])


def explained(model: PipelineModel) -> list[float]:
    return model.stages[3].explainedVariance.toArray().tolist()
