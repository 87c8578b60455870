"""Tables, views, record export and the catalogue."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


#: Published snapshots kept for readers that resolved the table a moment ago; hours after which an unpublished one counts as left behind.
KEEP, STALE_HOURS = 2, 24


def _list(spark: SparkSession, path: str) -> list:
    fs, folder = _fs(spark, path)
    return list(fs.listStatus(folder)) if fs.exists(folder) else []


def _names(spark: SparkSession, path: str) -> list[str]:
    return sorted(f.getPath().getName() for f in _list(spark, path))


def _touch(spark: SparkSession, path: str) -> None:
    fs, file = _fs(spark, path)
    fs.create(file, False).close()


def current_snapshot(spark: SparkSession, base: str, name: str) -> str | None:
    """Folder of the newest published snapshot. A pointer's name holds its number and the snapshot, so seeing it is reading it whole."""
    pointers = _names(spark, posixpath.join(base, name, "_pointers"))
    return posixpath.join(base, name, "_snapshots", pointers[-1].split(".", 1)[1]) if pointers else None


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table as it is now. The snapshot is resolved once: a replacement meanwhile changes nothing for this frame.

    It stays readable through ``KEEP`` - 1 further replacements; :func:`pinned` keeps it for longer. A table that was never replaced is
    read from the folder of its name.
    """
    snapshot = current_snapshot(spark, base, name)
    if snapshot is None:
        _recover(spark, base, name)
    return spark.read.parquet(snapshot or posixpath.join(base, name))


@contextmanager
def pinned(spark: SparkSession, base: str, name: str) -> Iterator[DataFrame]:
    """The table as it is now, safe from clean-up until the block ends, however often it is replaced."""
    while True:
        snapshot = current_snapshot(spark, base, name)
        if snapshot is None:
            raise FileNotFoundError(f"{name} has no published snapshot")
        pin = posixpath.join(base, name, "_pins", f"{posixpath.basename(snapshot)}.{uuid.uuid4().hex}")
        _touch(spark, pin)
        fs, folder = _fs(spark, snapshot)
        if fs.exists(folder):
            break
        fs.delete(_fs(spark, pin)[1], False)  # cleaned up between the look and the pin; look again
    try:
        yield spark.read.parquet(snapshot)
    finally:
        fs.delete(_fs(spark, pin)[1], False)


def clean_up(spark: SparkSession, base: str, name: str, keep: int = KEEP, stale_hours: float = STALE_HOURS) -> list[str]:
    """Delete snapshots that neither the newest ``keep`` pointers nor a pin name; the names deleted.

    Pointers go before their snapshots, so a listed pointer among the newest always has its snapshot. A snapshot without a pointer may be
    one in writing and stays until it is ``stale_hours`` old.
    """
    folder = posixpath.join(base, name)
    pointers = _names(spark, posixpath.join(folder, "_pointers"))
    pins = {p.split(".", 1)[0] for p in _names(spark, posixpath.join(folder, "_pins"))}
    named, fresh = {p.split(".", 1)[1]: p for p in pointers}, {p.split(".", 1)[1] for p in pointers[-keep:]}
    fs, gone, oldest = _fs(spark, folder)[0], [], (time.time() - stale_hours * 3600) * 1000
    for status in _list(spark, posixpath.join(folder, "_snapshots")):
        snapshot = status.getPath().getName()
        if snapshot in fresh or snapshot in pins or (snapshot not in named and status.getModificationTime() > oldest):
            continue
        if snapshot in named:
            fs.delete(_fs(spark, posixpath.join(folder, "_pointers", named[snapshot]))[1], False)
        fs.delete(status.getPath(), True)
        gone.append(snapshot)
    return sorted(gone)


def _recover(spark: SparkSession, base: str, name: str) -> None:
    """Put a table of the layout without pointers back if a replacement broke off between two renames."""
    fs, target = _fs(spark, posixpath.join(base, name))
    _, previous = _fs(spark, posixpath.join(base, f"_previous_{name}"))
    if not fs.exists(target) and fs.exists(previous) and not fs.rename(previous, target):
        raise IOError(f"cannot put the previous {name} back")


def read_query(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """SQL over the catalogue, with given frames reachable as ``{name}``."""
    return spark.sql(statement, **frames)


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str, low, high, parts: int, **options) -> DataFrame:
    """Parallel read of a database table, one range of ``split_on`` per task."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .options(partitionColumn=split_on, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()
    )


def replace_table(df: DataFrame, base: str, name: str, partition_by: str | None = None, sort_by: str | None = None) -> int:
    """Full refresh of one table; returns the rows written.

    Rows go to a snapshot folder of their own; once they are complete, one empty file, the pointer, publishes them. There is no moment
    without a table, nothing is renamed, and a job that fails or is killed leaves the previous table in place. Of two that publish at the
    same time one is the newest; both are whole. The count comes from the write itself, not from a second pass. ``sort_by`` orders the rows
    of each file, without a shuffle, so that later filters on that column skip row groups.
    """
    spark = df.sparkSession
    folder, snapshot = posixpath.join(base, name), uuid.uuid4().hex
    seen = Observation(f"rows_{name}")
    df = df.sortWithinPartitions(sort_by) if sort_by else df
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(posixpath.join(folder, "_snapshots", snapshot))
    pointers = _names(spark, posixpath.join(folder, "_pointers"))
    number = int(pointers[-1].split(".", 1)[0]) + 1 if pointers else 1
    _touch(spark, posixpath.join(folder, "_pointers", f"{number:012d}.{snapshot}"))
    clean_up(spark, base, name)
    return int(seen.get["rows"])


def define_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def list_views(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Names of registered views (optionally only those asked for)."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables() if names is None or t.name in names]
    return spark.createDataFrame(sorted(rows), "view_name string, kind string")


def list_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """One row per column of the named tables or views."""
    rows = [(n, i + 1, f.name, f.dataType.simpleString()) for n in names for i, f in enumerate(spark.table(n).schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def as_records(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One JSON record per row, absent values kept as null."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record")
    return (df.orderBy(*order_by) if order_by else df).select(record)


def export_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
