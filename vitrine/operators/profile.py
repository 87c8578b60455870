"""Table profiling: nulls, duplicates, summaries, histograms, box statistics, densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import numbers
from vitrine.operators.ordered import exact_quantiles

# Quartiles and whisker reach.
QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5


def null_report(df: DataFrame) -> DataFrame:
    """Per column: type, rows, non-null and null counts, null percent. One pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("row_count"),
                     F.col(f.name).alias("non_null"), (F.col("_rows") - F.col(f.name)).alias("null_count"),
                     F.coalesce(numbers.percent(F.col("_rows") - F.col(f.name), F.col("_rows"), 2), F.lit(0.0)).alias("null_pct"))
            for f in df.schema]
    return counts.select(F.inline(F.array(*rows)))


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Surplus rows that repeat a whole row, and that repeat a key (NULL keys compare equal)."""
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_key = whole.groupBy(*key).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    return per_key.agg(F.sum("_n").alias("row_count"), F.sum(F.col("_n") - F.col("_rows")).alias("exact_duplicates"),
                       F.sum(F.col("_n") - 1).alias("key_duplicates"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles per numeric column."""
    stats = df.agg(*[agg(F.col(c).cast("double")).alias(f"{c}__{name}") for c in columns
                     for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    long = stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in ("mean", "std", "min", "max")])
                                           for c in columns])))
    return long.join(exact_quantiles(df, columns, QUARTILES), "column_name")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends (outermost values within 1.5 IQR) and outlier count per group."""
    quartiles = exact_quantiles(df, [value], QUARTILES, [group]).drop("column_name")
    merged = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_copies"))
    limits = quartiles.select(F.col(group).alias("_g"), "p25", "p50", "p75", "n",
                              (F.col("p25") - WHISKER * (F.col("p75") - F.col("p25"))).alias("_low"),
                              (F.col("p75") + WHISKER * (F.col("p75") - F.col("p25"))).alias("_high"))
    inside = F.col("_x").between(F.col("_low"), F.col("_high"))
    return merged.join(limits, F.col(group).eqNullSafe(F.col("_g"))).groupBy(group, "n", "p25", "p50", "p75").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_copies"))), F.lit(0)).alias("outliers"))


def iqr_flagged(df: DataFrame, value: str, as_name: str = "is_outlier") -> DataFrame:
    """Flag values more than 1.5 IQR outside the quartiles; the fences are one scalar each."""
    fences = exact_quantiles(df, [value], (0.25, 0.75)).select(
        F.struct((F.col("p25") - WHISKER * (F.col("p75") - F.col("p25"))).alias("low"),
                 (F.col("p75") + WHISKER * (F.col("p75") - F.col("p25"))).alias("high")).alias("f")).scalar()
    x = F.col(value).cast("double")
    return df.withColumn(as_name, F.coalesce((x < fences["low"]) | (x > fences["high"]), F.lit(False)))


def histogram(df: DataFrame, value: str, bins: int = 50, log_scale: bool = False) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed; empty bins count 0. Two scans, one for the ends and one
    that counts bins inside the map task."""
    x = F.col(value).cast("double")
    values = df.filter(x > 0 if log_scale else x.isNotNull()).select((F.log10(x) if log_scale else x).alias("_x"))
    ends = values.agg(F.struct(F.min("_x").alias("low"), F.max("_x").alias("high")).alias("e")).scalar()
    width = (F.col("_ends.high") - F.col("_ends.low")) / bins
    slot = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_ends.low")) / F.nullif(width, F.lit(0.0)))))
    counted = values.withColumn("_ends", ends).groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_ends", ends)
    return frame.join(counted, "bin", "left").select(
        "bin", (F.col("_ends.low") + F.col("bin") * width).alias("from_value"), (F.col("_ends.low") + (F.col("bin") + 1) * width).alias("to_value"),
        F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, value: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) times the sample deviation.

    Equal values are merged first; each distinct value adds to every grid point inside
    the map task, so what is shuffled is one line per grid point and task.
    """
    x = F.col(value).cast("double")
    merged = df.filter(x.isNotNull()).select(x.alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_copies"))
    shape = df.filter(x.isNotNull()).agg(F.struct(
        F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n"),
        (F.stddev_samp(x) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h")).alias("s")).scalar()
    spread = merged.withColumn("_s", shape).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_s.low") + F.col("point") * (F.col("_s.high") - F.col("_s.low")) / (points - 1)
    z = (at - F.col("_x")) / F.col("_s.h")
    pull = F.col("_copies") * F.exp(-0.5 * z * z) / (F.col("_s.n") * F.col("_s.h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.select("point", at.alias("at_value"), pull.alias("_pull")).groupBy("point", "at_value").agg(F.sum("_pull").alias("density"))


def frequencies(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Value counts of several columns in one pass, NULLs left out, optionally the top n of each."""
    from vitrine.operators.keyed import first_per_key

    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = pairs.filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else first_per_key(counts, ["column_name"], [F.col("n").desc(), F.col("value")], top)


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Counts of ``rows`` by the given values of ``columns``, zero where absent, with row total."""
    wide = df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(n) for v, n in zip(values, names)])
    return wide.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def buyers_by_year(fact_orders: DataFrame, years: Sequence[int], customer: str = "customer_unique_id", key: str = "purchase_date_key") -> DataFrame:
    """One-time and repeat customers of the wanted years, zero where a year has none."""
    from vitrine.operators.keyed import dense_series

    wanted = fact_orders.sparkSession.createDataFrame([(int(y),) for y in years], "year int")
    per_customer = fact_orders.filter(F.col(customer).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.floor(F.col(key) / 10000).cast("int").alias("year"), customer).agg(F.count(F.lit(1)).alias("orders"))
    split = per_customer.groupBy("year").agg(F.count_if(F.col("orders") == 1).alias("one_time"), F.count_if(F.col("orders") > 1).alias("repeat_buyers"))
    full = dense_series(split, "year", wanted, {"one_time": 0, "repeat_buyers": 0})
    total = F.col("one_time") + F.col("repeat_buyers")
    return full.select("year", "one_time", "repeat_buyers", total.alias("total_customers"), numbers.percent(F.col("repeat_buyers"), total, 1).alias("repeat_pct"))


def delay_against_score(fact_orders: DataFrame, longest: int = 100, boundary: float = 3.5) -> DataFrame:
    """Mean score and count per delivery time and late flag, long delays left out."""
    kept = fact_orders.filter((F.col("delivery_days_actual") <= longest) & F.col("review_score").isNotNull())
    out = kept.groupBy("delivery_days_actual", "is_late_delivery").agg(F.sum("review_score").alias("_s"), F.count(F.lit(1)).alias("n"))
    mean = numbers.ratio(F.col("_s"), F.col("n"))
    return out.select("delivery_days_actual", "is_late_delivery", "n", mean.alias("mean_score"), (mean > boundary).alias("above_boundary"))


def value_checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows meet each named condition, all counted in one pass."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n")) for n in conditions])))
