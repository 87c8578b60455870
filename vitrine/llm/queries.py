"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import (
    bpe, html_extraction, langid, merkle, near_vectors, ngram_join, oracle_sql, packing, quality_classifier, quality_rules, resampling, sharding,
    token_counts as counting, toxicity,
)
from vitrine.llm.common import fold_of, ship, table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged, _ = quality_rules.apply_rules(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), carry_ids=False)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit_documents(docs))
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = toxicity.score(docs, toxicity.fit_documents(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = counting.token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = table(spark, folder, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.place(sized, sharding.even_tree(8), grown=sharding.even_tree(9))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality_classifier.score(docs, quality_classifier.fit_documents(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_proofs(table(spark, folder, "documents"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_embedding_dedup, op3_packing, op4_language_id, op5_toxicity, op6_token_counts, op7_ngram_join, op8_sharding,
        op9_bpe, op10_quality_classifier, op11_merkle_manifest, op12_importance_resampling, op13_html_extraction,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return query(spark, folder)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


def oracles() -> dict[str, str]:
    """SQL of the operators that it can express; ``tests/llm`` holds the others against a brute-force version or a library."""
    return {"op11_merkle_manifest": oracle_sql.MERKLE, "op12_importance_resampling": oracle_sql.RESAMPLING}
