"""Business rules: status sets, bands, flags, intents and languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Order states that do not count as a sale.
NOT_A_SALE = ("created", "approved", "canceled", "unavailable")
# States left out of the daily trend and of the review average.
NOT_CONFIRMED = ("created", "approved")
# States left out of the customer count.
NOT_A_CUSTOMER = ("canceled", "unavailable")
# States left out of the item revenue series.
NOT_IN_SERIES = ("created", "approved", "canceled")

# Words that set the tone of a card, tested in this order.
POSITIVE_WORDS = "improved|increased|healthy|strong|good|excellent|stable"
NEGATIVE_WORDS = "declined|decreased|critical|high|negative|risk"

# Bounding box of the country.
LATITUDES = (-33.75, 5.27)
LONGITUDES = (-73.98, -34.79)

# Words that mark a question answerable by a query.
QUERY_WORDS = (
    r"top|average|avg|count|sum|total|trend|breakdown|revenue|orders?|sellers?|customers?|products?|"
    r"categories|states?|delivery|churn|review|rating|monthly|yearly|by region|by state|per|rank"
)
# Words that mark a question about the platform itself.
PLATFORM_WORDS = (
    r"who founded|history|when was|dataset|schema|tables?|columns?|founded|mission|business model"
)


def is_sale(status: Column, excluded: Sequence[str] = NOT_A_SALE) -> Column:
    return ~status.isin(list(excluded))


def late_flag(delivered: Column, promised: Column) -> Column:
    """NULL while undelivered, else whether delivery came after the promise."""
    return F.when(delivered.isNotNull(), F.coalesce(delivered > promised, F.lit(False)))


def unpaid_flag(paid: Column) -> Column:
    return F.coalesce(paid <= 0, F.lit(False))


def sentiment_of(score: Column) -> Column:
    return F.when(score >= 4, "Positive").otherwise("Negative")


def tone_of(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.rlike(POSITIVE_WORDS), "positive").when(lowered.rlike(NEGATIVE_WORDS), "negative").otherwise("neutral")


def inside_country(latitude: Column, longitude: Column) -> Column:
    return latitude.between(*LATITUDES) & longitude.between(*LONGITUDES)


def outside_country(latitude: Column, longitude: Column) -> Column:
    """True only where a known coordinate lies outside."""
    return F.coalesce(~latitude.between(*LATITUDES), F.lit(False)) | F.coalesce(~longitude.between(*LONGITUDES), F.lit(False))


def intent_of(message: Column, platform: str = "vitrine") -> Column:
    """Route a message: about the platform, answerable by a query, or neither."""
    about = rf"(?iU)\b(what is {platform}|about {platform}|{PLATFORM_WORDS})\b"
    asks = rf"(?iU)\b({QUERY_WORDS})\b"
    return F.when(message.rlike(about), "platform_info").when(message.rlike(asks), "sql").otherwise("general")


def passes_language_gate(guess: Column, text: Column, wanted: str = "pt") -> Column:
    """Keep the wanted language; text no language can be told for passes from five characters on."""
    return F.when(guess.isNotNull(), guess == wanted).otherwise(F.length(F.btrim(text)) >= 5)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """First of the candidate names that is a column of ``df``."""
    for name in candidates:
        if name in df.columns:
            return name
    raise KeyError(f"none of {', '.join(candidates)} is a column")
