"""Date keys, calendar parts and tolerant timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_key(moment: Column) -> Column:
    """Day as a yyyymmdd integer."""
    return (F.year(moment) * 10000 + F.month(moment) * 100 + F.dayofmonth(moment)).cast("int")


def key_to_date(key: Column) -> Column:
    """yyyymmdd integer as a date; NULL when it names no day."""
    return F.try_to_date(key.cast("string"), "yyyyMMdd")


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.date_diff(end, start)


def parsed_moment(text: Column) -> Column:
    """Text as a wall-clock timestamp; NULL when it does not parse."""
    return text.try_cast("timestamp_ntz")


def calendar_parts(day: Column) -> list[Column]:
    return [
        date_key(day).alias("date_key"),
        day.alias("full_date"),
        F.year(day).cast("short").alias("year_number"),
        F.quarter(day).cast("short").alias("quarter_number"),
        F.month(day).cast("short").alias("month_number"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
    ]


def iso_text(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))
