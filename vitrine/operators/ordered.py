"""Order-dependent results over groups of any size.

A plain window over few groups (or none) sends each group to one task. For numbering, rows
are range-partitioned on (group, order), sorted and written durably; each task then knows
the places of its own rows, and only one line of totals per (group, partition) is combined
across tasks. Use it for frames that must not be computed twice; ``placed`` numbers all
others without writing. Quantiles are found by counting, without any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.session import durable

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _laid_out(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in global order with ``_part`` and ``_at`` (a place that grows along the partition)."""
    keys = [*[F.col(g).asc() for g in group], *order, F.col("_tie")]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _PART_BITS))
    )
    return durable(placed)


def _with_totals(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach, per (group, partition), the first place and what came before in the group.

    The totals have at most one line per partition plus one per group.
    """
    sums = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")]
    per_part = rows.groupBy(*group, "_part").agg(*sums)
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    columns = [
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_n").over(within).alias("_group_rows"),
    ]
    totals = per_part.select(*columns)
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(totals, match).drop("_p", *[f"_g{i}" for i in range(len(group))])


def _place() -> Column:
    return F.col("_rows_before") + F.col("_at") - F.col("_first") + 1


_SCRATCH = ("_at", "_part", "_first", "_rows_before", "_group_rows")


def numbered(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), as_name: str = "row_no",
             count_as: str | None = None) -> DataFrame:
    """Dense 1-based numbers along ``order`` within each group (or over the whole frame)."""
    out = _with_totals(_laid_out(df, group, order), group)
    out = out.withColumn(as_name, _place())
    if count_as:
        out = out.withColumn(count_as, F.col("_group_rows"))
    return out.drop(*_SCRATCH)


def tile_of(place: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a row's place: the first ``rows mod tiles`` tiles hold one row more."""
    small = F.floor(rows / tiles)
    extra = rows % tiles
    in_large = extra * (small + 1)
    return F.when(place <= in_large, F.ceil(place / (small + 1))).otherwise(
        extra + F.ceil((place - in_large) / F.greatest(small, F.lit(1)))
    ).cast("int")


#: Bins of a round, and rounds, of the search for a quantile.
_BINS, _ROUNDS = 4096, 2


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Which of ``_BINS`` equal parts of [low, high] holds ``x``; halved, so that the width of the range is always a number."""
    bounded = lambda c: F.greatest(F.least(c, F.lit(1.7e308)), F.lit(-1.7e308)) / 2
    share = (bounded(x) - bounded(low)) / F.nullif(bounded(high) - bounded(low), F.lit(0.0))
    return F.least(F.coalesce(F.floor(share * _BINS), F.lit(0)), F.lit(_BINS - 1)).cast("int")


def _within(values: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value beside the span that holds it; the spans of one group do not overlap.

    Spans go to the values, not values to their group's task: a group (often the only one) has a line a wanted place at most.
    """
    named = F.broadcast(spans.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}))
    same = (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return values.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _holding(counted: DataFrame, part: Sequence[str], along: str, places: Column) -> DataFrame:
    """Lines of ``counted`` (number ``_n``) that hold a wanted place, with ``_before`` and their ``_places``."""
    so_far = Window.partitionBy(*part).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
    inside = F.filter(places, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))
    return placed.withColumn("_places", inside).filter(F.size("_places") > 0)


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, one row per (group, column), exact and without sorting or copying the rows.

    Values are counted in bins between their least and greatest; the next round counts only what lies in the bins that hold a wanted
    place, between the values that occur there. What is left after the rounds is merged by value and counted up. Each round is one scan with
    map-side counts; a line a bin is shuffled. Counts carry plain numbers only, as a list among them would have every value sorted first.
    NaN counts as infinity.
    """
    values = df.select(*group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))).alias("_x")) for c in columns]))).filter("_x IS NOT NULL")
    keys = [*group, "column_name"]
    spot = lambda n, p: (n - 1) * F.lit(float(p))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(spot(F.col("_all"), p)), F.ceil(spot(F.col("_all"), p))) for p in points])))
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    spans = whole.select(*keys, "_low", "_high", "_all", F.lit(0).cast("long").alias("_before"))
    held = [F.max(c).alias(c) for c in ("_before", "_all")]
    for _ in range(_ROUNDS):
        bins = _within(values, spans, keys).groupBy(*keys, F.col("_low").alias("_span"), _bin(F.col("_x"), F.col("_low"), F.col("_high")).alias("_bin"))
        counted = bins.agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), *held)
        spans = _holding(counted, [*keys, "_span"], "_bin", places).select(*keys, "_low", "_high", "_all", "_before")
    merged = _within(values, spans, keys).groupBy(*keys, F.col("_low").alias("_span"), "_x").agg(F.count(F.lit(1)).alias("_n"), *held)
    found = _holding(merged, [*keys, "_span"], "_x", places).select(*keys, "_all", "_x", F.explode("_places").alias("_place"))
    at = lambda place: F.max(F.when(F.col("_place") == place, F.col("_x")))
    ends = [e for i, p in enumerate(points) for e in (at(F.floor(spot(F.col("_all"), p))).alias(f"_lo{i}"), at(F.ceil(spot(F.col("_all"), p))).alias(f"_hi{i}"))]
    table = found.groupBy(*keys).agg(F.max("_all").alias("n"), *ends)
    outs = []
    for i, p in enumerate(points):
        here = spot(F.col("n"), p)
        # equal ends need no way between them, which infinity would not survive
        outs.append(F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (here - F.floor(here))).alias(f"p{round(p * 100)}"))
    return table.select(*keys, "n", *outs)
