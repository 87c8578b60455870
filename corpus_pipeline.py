"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, folder of the given tables), works on all documents that the one before kept, and returns a DataFrame;
all but the last return the columns of ``docs``. Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import ngram_join, packing, quality_classifier, toxicity
from vitrine.llm.common import ship, table
from vitrine.session import scratch_path


def _whole(docs: DataFrame) -> DataFrame:
    """The text beside the untouched row, so that what a scorer adds cannot clash with a column of ``docs``."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from labelled documents of ``docs`` outside the held-out fold; a null
    or empty text holds nothing toxic and stays."""
    model = toxicity.fit_documents(docs, table(spark, folder, "labels"))
    return toxicity.score(_whole(docs), model).filter("predicted = 0").select("_row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality model does not reject, learnt in the same way. A null or empty text shows no poor n-gram and has the
    score of the bias."""
    model = quality_classifier.fit_documents(docs, table(spark, folder, "labels"))
    return quality_classifier.score(_whole(docs), model).filter("predicted = 1").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-copies: that with the smallest id. Texts without a word are copies of nothing. Rows with the
    same id are one document and stay or go together; rows without an id cannot be named and stay."""
    ids = ngram_join.similar_documents(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = ids.filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where the tokens of each document lie in sequences of at most 2048."""
    return packing.pack(docs, carry_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality_classifier", drop_poor), ("ngram_join", drop_copies), ("packing", pack),
]

#: Learnt models decide, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
