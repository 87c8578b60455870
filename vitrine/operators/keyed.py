"""Per-key picks and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    The rank filter lets Spark cut every key to ``n`` rows inside each map task before
    the shuffle, so a key holding much of the table stays cheap. ``order`` should end
    in a unique column, else ties are arbitrary.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_place", place).filter(F.col("_place") <= n)
    return out.withColumnRenamed("_place", rank_as) if rank_as else out.drop("_place")


def leaders(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that tie for first place per key."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def with_share(df: DataFrame, value: str, keys: Sequence[str] = (), as_name: str = "share_pct", digits: int = 2) -> DataFrame:
    """Percent of the key's total, for a frame that is already aggregated and small."""
    total = F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return df.withColumn(as_name, F.round(F.col(value).cast("double") / total.cast("double") * 100, digits))


def dense_series(df: DataFrame, key: str, wanted: DataFrame, fills: dict) -> DataFrame:
    """Every wanted key once, zero (or another fill) where ``df`` has no row."""
    return wanted.join(df, key, "left").fillna(fills)


def moving_average(df: DataFrame, order: str, value: str, width: int = 7, as_name: str = "moving_avg") -> DataFrame:
    """Trailing mean over ``width`` rows of a per-day series; NULL until the window is full.

    The series has one row per day, so its length is bounded by the calendar.
    """
    along = Window.partitionBy(F.lit(0)).orderBy(order)
    full = F.row_number().over(along) >= width
    mean = F.avg(F.coalesce(F.col(value), F.lit(0.0))).over(along.rowsBetween(1 - width, 0))
    return df.withColumn(as_name, F.when(full, mean))
