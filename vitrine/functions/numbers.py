"""Safe numeric casts, guarded ratios and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"
DASH = "—"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def safe_int(text: Column) -> Column:
    return text.try_cast("int")


def safe_money(text: Column) -> Column:
    return text.try_cast(MONEY)


def safe_flag(text: Column) -> Column:
    """'true' / 'false' in any case, or a whole number (0 is false); anything else is NULL."""
    word = F.lower(F.trim(text))
    return F.when(word == "true", True).when(word == "false", False).otherwise(word.try_cast("int") != 0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL when whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    out = ratio(part, whole) * 100
    return out if digits is None else F.round(out, digits)


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def whole(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def parsed_percent(text: Column) -> Column:
    return F.replace(F.btrim(text), F.lit("%"), F.lit("")).try_cast("double")


def currency_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("R$ "), F.format_number(value.cast("double"), 2)), F.lit(DASH))


def _percent_text(value: Column, sign: str) -> Column:
    value = value.cast("double")
    text = F.when(value == F.floor(value), F.format_string(f"%{sign}d%%", value.cast("bigint"))).otherwise(
        F.format_string(f"%{sign}.1f%%", value)
    )
    return F.when(value.isNull(), DASH).otherwise(text)


def percent_text(value: Column) -> Column:
    return _percent_text(value, "")


def signed_percent_text(value: Column) -> Column:
    return _percent_text(value, "+")


def score_text(value: Column) -> Column:
    return F.coalesce(F.concat(fixed(value, 2), F.lit(" / 5")), F.lit(DASH))


def marker_size(count: Column) -> Column:
    """Map marker diameter: square root of half the count, held between 15 and 50."""
    return F.greatest(F.lit(15.0), F.least(F.lit(50.0), F.sqrt(count / 2)))


def jittered(value: Column, spread: float = 0.15, seed: int = 42) -> Column:
    return value + F.randn(seed) * spread
