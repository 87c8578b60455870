"""Typed, cleaned tables from the raw landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import dates, numbers, text
from vitrine.operators.keyed import first_per_key
from vitrine.operators.placed import numbered

LOADED = "load_date_timestamp"


def stamped(df: DataFrame, stamp: bool = True) -> DataFrame:
    """Add the time of the load."""
    return df.withColumn(LOADED, F.current_timestamp()) if stamp else df


def clean_reviews(raw: DataFrame, stamp: bool = True) -> DataFrame:
    """Latest row per review, score as integer, both texts repaired."""
    latest = first_per_key(raw, ["review_id"], [F.col("review_creation_date").desc(), F.col("order_id"), F.col("review_answer_timestamp").desc()])
    return stamped(latest.select(
        "review_id",
        "order_id",
        numbers.safe_int(F.col("review_score")).alias("review_score"),
        text.repair_review(F.col("review_comment_title")).alias("review_comment_title"),
        text.repair_review(F.col("review_comment_message")).alias("review_comment_message"),
        dates.parsed_moment(F.col("review_creation_date")).alias("review_creation_date"),
        dates.parsed_moment(F.col("review_answer_timestamp")).alias("review_answer_timestamp"),
    ), stamp)


def clean_customers(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.select(
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        text.hyphens_to_spaces(F.col("customer_city")).alias("customer_city"),
        F.upper("customer_state").alias("customer_state"),
    ), stamp)


def clean_deals(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.select(
        "mql_id", "seller_id", "sdr_id", "sr_id",
        dates.parsed_moment(F.col("won_date")).alias("won_date"),
        text.underscores_to_spaces(F.col("business_segment")).alias("business_segment"),
        text.underscores_to_spaces(F.col("lead_type")).alias("lead_type"),
        "lead_behaviour_profile",
        numbers.safe_flag(F.col("has_company")).alias("has_company"),
        numbers.safe_flag(F.col("has_gtin")).alias("has_gtin"),
        text.undo_date_mangling(F.col("average_stock")).alias("average_stock"),
        "business_type",
        numbers.safe_int(F.col("declared_product_catalog_size")).alias("declared_product_catalog_size"),
        numbers.safe_int(F.col("declared_monthly_revenue")).alias("declared_monthly_revenue"),
    ), stamp)


def clean_leads(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.select(
        "mql_id",
        dates.parsed_moment(F.col("first_contact_date")).alias("first_contact_date"),
        "landing_page_id",
        text.underscores_to_spaces(F.col("origin")).alias("origin"),
    ), stamp)


def clean_geolocation(raw: DataFrame, keep_spaces: bool = False, stamp: bool = True) -> DataFrame:
    """One row per (zip prefix, state): mean coordinates and one representative city name."""
    state = F.upper("geolocation_state")
    mean = lambda name: F.avg(F.col(name).try_cast("decimal(18,10)")).cast("decimal(18,10)").alias(name)
    merged = raw.groupBy("geolocation_zip_code_prefix", state.alias("geolocation_state")).agg(
        mean("geolocation_lat"), mean("geolocation_lng"), F.min(F.lower(F.trim("geolocation_city"))).alias("_city"))
    tidy = merged.withColumn("_tidy", text.tidy_geo_city(F.col("_city"), keep_spaces))
    return stamped(tidy.select(
        "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
        text.judged_geo_city(F.col("_tidy"), F.col("geolocation_state")).alias("geolocation_city"),
        "geolocation_state",
    ), stamp)


def clean_order_items(raw: DataFrame, stamp: bool = True, with_key: bool = True) -> DataFrame:
    """Typed items; the key numbers them by order and by item id compared as text ('10' before '2')."""
    rows = numbered(raw, ["order_id", "order_item_id", "product_id", "seller_id"],
                    as_name="order_item_key") if with_key else raw.withColumn("order_item_key", F.lit(None).cast("bigint"))
    return stamped(rows.select(
        "order_id",
        numbers.safe_int(F.col("order_item_id")).alias("order_item_number"),
        "order_item_key", "product_id", "seller_id",
        dates.parsed_moment(F.col("shipping_limit_date")).alias("shipping_limit_date"),
        numbers.safe_money(F.col("price")).alias("price"),
        numbers.safe_money(F.col("freight_value")).alias("freight_value"),
    ), stamp)


def clean_payments(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.select(
        "order_id",
        numbers.safe_int(F.col("payment_sequential")).alias("payment_sequential"),
        text.underscores_to_spaces(F.col("payment_type")).alias("payment_type"),
        numbers.safe_int(F.col("payment_installments")).alias("payment_installments"),
        numbers.safe_money(F.col("payment_value")).alias("payment_value"),
    ), stamp)


def clean_orders(raw: DataFrame, stamp: bool = True) -> DataFrame:
    moments = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"]
    return stamped(raw.select(
        "order_id", "customer_id",
        # The status that is renamed.
        F.when(F.col("order_status") == "unavailable", "out of stock").otherwise(F.col("order_status")).alias("order_status"),
        *[dates.parsed_moment(F.col(m)).alias(m) for m in moments],
    ), stamp)


def clean_translation(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.select(*[text.underscores_to_spaces(F.col(c)).alias(c)
                                 for c in ("product_category_name", "product_category_name_english")]), stamp)


def clean_products(raw: DataFrame, stamp: bool = True) -> DataFrame:
    counts = [c for c in raw.columns if c not in ("product_id", "product_category_name")]
    return stamped(raw.select(
        "product_id",
        text.underscores_to_spaces(F.col("product_category_name")).alias("product_category_name"),
        *[numbers.safe_int(F.col(c)).alias(c) for c in counts],
    ), stamp)


def clean_sellers(raw: DataFrame, stamp: bool = True) -> DataFrame:
    return stamped(raw.withColumn("_tidy", text.tidy_seller_city(F.col("seller_city"))).select(
        "seller_id", "seller_zip_code_prefix",
        text.judged_seller_city(F.col("_tidy")).alias("seller_city"),
        F.upper("seller_state").alias("seller_state"),
    ), stamp)


#: Cleaning job of each raw table, in load order.
JOBS = {
    "order_reviews": clean_reviews,
    "customers": clean_customers,
    "closed_deals": clean_deals,
    "marketing_qualified_leads": clean_leads,
    "geolocation": clean_geolocation,
    "order_items": clean_order_items,
    "order_payments": clean_payments,
    "orders": clean_orders,
    "category_translation": clean_translation,
    "products": clean_products,
    "sellers": clean_sellers,
}
