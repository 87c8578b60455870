"""What several operators of this package need: table access, folds, bounded samples, durable rows."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.session import durable as durable  # noqa: PLC0414  re-exported for the operators

#: The tokenizer that contracts of this package name.
TOKENIZER = "byte_bpe_50k.json"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor on their path: its code goes with the application."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    reach = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]}
    if root in reach or "site-packages" in root.parts or context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1].name
    context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp()) / package), "zip", root, package))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold_of(key: str, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, key: str, group: str, per_group: int, groups: int = 512) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, picked by a hash of ``key``, at most twice as many in all.

    ``group`` must be a label column with at most ``groups`` values (checked); its counts are the only thing sent to the driver.
    The pick depends on the keys alone. The hard bound only matters when one key is repeated.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(groups + 1).collect()
    if len(counts) > groups:
        raise ValueError(f"{group} has more than {groups} values")
    if not counts:
        return rows.limit(0)
    share = F.lit(1.0)
    for value, n in counts:
        share = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(min(1.0, per_group / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(place < share).limit(2 * per_group * len(counts))


def agreed(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``_id`` and ``_label`` of the ids outside the held-out fold; null ids and labels, and ids whose labels disagree, are left out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
    one = known.groupBy("doc_id").agg(F.min(label).alias("_label"), F.max(label).alias("_other")).filter("_label = _other")
    return one.select(F.col("doc_id").alias("_id"), "_label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, text: str = "text") -> DataFrame:
    """``_id``, ``_label`` and ``_text`` of about ``per_class`` documents of each label value.

    The ids are picked first and, being at most twice ``per_class`` a label, broadcast, so that no text is shuffled.
    """
    picked = bounded_sample(agreed(labels, label, folds, held_out), "_id", "_label", per_class)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text")
