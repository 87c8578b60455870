"""Places, running sums and tiles in order within groups of any size, without writing anything.

Boundaries between parts of the order are taken once, from a bounded sample, and become literals. A row's part is then a function of the
row alone: a lost executor computes the same part again, and the totals of all parts agree with the rows they were counted from. Only the
totals, one line a group and part, are combined across parts; rows are ordered within their part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vitrine.operators.ordered import tile_of

#: Sampled rows a part.
_SAMPLED = 32

Order = Sequence[str | tuple[str, str]]


def _named(order: Order) -> list[tuple[str, bool]]:
    """Column and whether it descends, from ``"name"`` or ``("name", "desc")``."""
    out = []
    for o in order:
        name, way = (o, "asc") if isinstance(o, str) else o
        if way not in ("asc", "desc"):
            raise ValueError(f"{name} is to be ordered {way}")
        out.append((name, way == "desc"))
    return out


def _falling(column: Column, kind: T.DataType) -> Column:
    """What ascends where ``column`` descends."""
    if isinstance(kind, T.StringType | T.BinaryType):
        # hexadecimal digits turned round; the end of a text comes after all of them
        return F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(column)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(column).cast("decimal(20,0)")
    if isinstance(kind, T.BooleanType):
        return -column.cast("int")
    return -column if isinstance(kind, T.FractionalType) else -column.cast("decimal(20,0)")


def _key(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    """A struct that sorts as the order does: NULL first where it ascends, last where it descends."""
    fields = []
    for i, (name, down) in enumerate(order):
        column = F.col(name)
        if down:
            fields += [column.isNull().alias(f"n{i}"), _falling(column, df.schema[name].dataType).alias(f"k{i}")]
        else:
            fields.append(column.alias(f"k{i}"))
    return F.struct(*fields)


def _boundaries(df: DataFrame, order: Sequence[tuple[str, bool]], parts: int) -> list:
    """Keys that cut the order into about equal parts; the sample is that of the rows with the least hashes, so it does not depend on chance.

    At most ``_SAMPLED`` keys a part reach the driver.
    """
    columns = sorted({n for n, _ in order})
    picked = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(_SAMPLED * parts)
    keys = [r[0] for r in picked.select(_key(df, order).alias("key")).orderBy("key").collect()]
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def _part(key: Column, kinds: T.StructType, cuts: list, first: int = 0) -> Column:
    """Number of the part that holds ``key``, by halving."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cuts[middle], kinds.fields, strict=True)])
    return F.when(key <= cut, _part(key, kinds, cuts[:middle], first)).otherwise(_part(key, kinds, cuts[middle + 1 :], first + middle + 1))


def _in_parts(df: DataFrame, order: Order, group: Sequence[str], values: Sequence[str], parts: int | None) -> tuple[DataFrame, list[Column]]:
    """Rows with ``_part`` and, for their group, the rows and sums before the part and in all; and the order within a part."""
    along = _named(order)
    whole = [(g, False) for g in group] + along
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = _key(df, whole)
    kinds = df.select(key.alias("k")).schema["k"].dataType
    rows = df.withColumn("_part", _part(key, kinds, _boundaries(df, whole, parts)))
    totals = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_v{i}") for i, v in enumerate(values)])
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a line a part
    before = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"), F.sum("_n").over(within).alias("_group_rows")]
    for i in range(len(values)):
        columns += [F.sum(f"_v{i}").over(before).alias(f"_before{i}"), F.sum(f"_v{i}").over(within).alias(f"_total{i}")]
    match = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    joined = rows.join(totals.select(*columns), match).drop("_p", *[f"_g{i}" for i in range(len(group))])
    return joined, [F.col(n).desc() if down else F.col(n).asc() for n, down in along]


_SCRATCH = ("_part", "_rows_before", "_group_rows")


def numbered(df: DataFrame, order: Order, group: Sequence[str] = (), as_name: str = "row_no", count_as: str | None = None, parts: int | None = None) -> DataFrame:
    """1-based places along ``order`` within each group (or over the whole frame).

    End the order in a unique column: rows that tie are numbered in no fixed order, and all lie in one part. ``df`` must give the same rows
    each time it is computed.
    """
    out, along = _in_parts(df, order, group, (), parts)
    out = out.withColumn(as_name, F.col("_rows_before") + F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*along)))
    return (out.withColumn(count_as, F.col("_group_rows")) if count_as else out).drop(*_SCRATCH)


def running_totals(df: DataFrame, values: dict[str, str], order: Order, group: Sequence[str] = (), totals_as: dict[str, str] | None = None,
                   parts: int | None = None) -> DataFrame:
    """Running sums along ``order`` within each group: ``values`` maps a column to the name of its running sum, ``totals_as`` to the name of
    its group total."""
    names = list(values)
    out, along = _in_parts(df, order, group, names, parts)
    here = Window.partitionBy(*group, "_part").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for i, v in enumerate(names):
        so_far, before = F.sum(v).over(here), F.col(f"_before{i}")
        added[values[v]] = F.when(before.isNull(), so_far).otherwise(before + F.coalesce(so_far, F.lit(0)))
        if totals_as and v in totals_as:
            added[totals_as[v]] = F.col(f"_total{i}")
    scratch = [f"_{kind}{i}" for kind in ("before", "total") for i in range(len(names))]
    return out.select("*", *[c.alias(n) for n, c in added.items()]).drop(*_SCRATCH, *scratch)


def tiled(df: DataFrame, tiles: int, order: Order, group: Sequence[str] = (), as_name: str = "tile", parts: int | None = None) -> DataFrame:
    """NTILE over each group."""
    out = numbered(df, order, group, "_no", "_of", parts)
    return out.withColumn(as_name, tile_of(F.col("_no"), F.col("_of"), tiles)).drop("_no", "_of")
