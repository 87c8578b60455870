"""Star schema from the cleaned tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.functions import dates, rules
from vitrine.operators.keyed import first_per_key

# Default bounds of the calendar.
CALENDAR = (dt.date(2015, 1, 1), dt.date(2020, 12, 31))


def build_dim_date(spark: SparkSession, first: dt.date = CALENDAR[0], last: dt.date = CALENDAR[1]) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_day"))
    return days.select(*dates.calendar_parts(F.col("_day")))


def calendar_over(df: DataFrame, day: Column) -> DataFrame:
    """Calendar that spans the days found in a table."""
    bounds = df.agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    days = bounds.select(F.explode(F.sequence("_first", "_last")).alias("_day"))
    return days.select(*dates.calendar_parts(F.col("_day")))


def build_dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    names = translation.select("product_category_name", F.col("product_category_name_english").alias("category_name_en"))
    return products.join(names, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("category_name_pt"),
        "category_name_en",
        F.col("product_name_length").cast("short").alias("name_length"),
        F.col("product_description_length").alias("description_length"),
        F.col("product_photos_qty").cast("short").alias("photo_count"),
        F.col("product_weight_g").alias("weight_g"),
        F.col("product_length_cm").cast("short").alias("length_cm"),
        F.col("product_height_cm").cast("short").alias("height_cm"),
        F.col("product_width_cm").cast("short").alias("width_cm"),
        (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")).cast("decimal(18,2)").alias("volume_cm3"),
    )


def build_dim_customers(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """One row per person (the smallest customer id), located by zip prefix and state."""
    people = first_per_key(customers, ["customer_unique_id"], [F.col("customer_id")])
    places = geolocation.groupBy(
        F.col("geolocation_zip_code_prefix").alias("zip_code"), F.col("geolocation_state").alias("state")
    ).agg(F.avg("geolocation_lat").cast("decimal(9,6)").alias("latitude"), F.avg("geolocation_lng").cast("decimal(9,6)").alias("longitude"))
    return people.select(
        "customer_unique_id", F.col("customer_zip_code_prefix").alias("zip_code"),
        F.col("customer_city").alias("city"), F.col("customer_state").alias("state"),
    ).join(places, ["zip_code", "state"], "left").select("customer_unique_id", "zip_code", "city", "state", "latitude", "longitude")


def build_dim_sellers(sellers: DataFrame, deals: DataFrame, geolocation: DataFrame) -> DataFrame:
    """Sellers with the facts of their latest deal; a seller with a deal came from marketing."""
    won = first_per_key(deals.filter("seller_id is not null"), ["seller_id"], [F.col("won_date").desc(), F.col("mql_id")]).select(
        "seller_id", "business_segment", "business_type", "lead_type",
        F.col("lead_behaviour_profile").alias("behaviour_profile"),
        F.col("declared_product_catalog_size").alias("catalog_size"),
        "declared_monthly_revenue", F.lit(True).alias("_won"),
    )
    places = geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_code"), F.col("geolocation_state").alias("state"),
        F.col("geolocation_lat").cast("decimal(9,6)").alias("latitude"), F.col("geolocation_lng").cast("decimal(9,6)").alias("longitude"),
    )
    based = sellers.select("seller_id", F.col("seller_zip_code_prefix").alias("zip_code"), F.col("seller_city").alias("city"),
                           F.col("seller_state").alias("state"))
    return based.join(won, "seller_id", "left").join(places, ["zip_code", "state"], "left").select(
        "seller_id", "zip_code", "city", "state", "latitude", "longitude", "business_segment", "business_type", "lead_type",
        "behaviour_profile", "catalog_size", "declared_monthly_revenue", F.coalesce("_won", F.lit(False)).alias("came_from_marketing"))


def payments_per_order(payments: DataFrame) -> DataFrame:
    """Total paid and the type of the largest payment (then the first in sequence), in one aggregate."""
    largest = F.max_by("payment_type", F.struct(
        F.col("payment_value"), (-F.col("payment_sequential")).alias("earlier"), F.col("payment_type").alias("name")))
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").cast("decimal(12,2)").alias("total_payment"), largest.alias("primary_payment_type"))


def build_fact_orders(orders: DataFrame, customers: DataFrame, dim_customers: DataFrame, reviews: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders of known customers with latest review, payments and delivery facts.

    Reviews and payments are cut to one row per order before the join, so both sides
    meet on a unique key.
    """
    known = customers.select("customer_id", "customer_unique_id").join(dim_customers.select("customer_unique_id"), "customer_unique_id", "left_semi")
    latest = first_per_key(reviews, ["order_id"], [F.col("review_creation_date").desc(), F.col("review_id")]).select(
        "order_id", F.col("review_score").cast("short").alias("review_score"), F.col("review_comment_message").alias("review_text"))
    return (
        orders.join(known, "customer_id").join(latest, "order_id", "left").join(payments_per_order(payments), "order_id", "left").select(
            "order_id", "customer_unique_id",
            dates.date_key(F.col("order_purchase_timestamp")).alias("purchase_date_key"),
            "order_status", "total_payment", "primary_payment_type", "review_score", "review_text",
            dates.days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")).alias("delivery_days_actual"),
            rules.late_flag(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")).alias("is_late_delivery"),
            rules.unpaid_flag(F.col("total_payment")).alias("is_invalid_payment"),
        )
    )


def build_fact_order_items(items: DataFrame, orders: DataFrame, dim_products: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    """Items whose order, product and seller are all known."""
    bought = orders.select("order_id", "order_purchase_timestamp", "order_delivered_customer_date")
    return (
        items.join(dim_products.select("product_id"), "product_id", "left_semi")
        .join(dim_sellers.select("seller_id"), "seller_id", "left_semi")
        .join(bought, "order_id")
        .select(
            "order_item_key", "order_id", "product_id", "seller_id",
            dates.date_key(F.col("order_purchase_timestamp")).alias("purchase_date_key"),
            "order_purchase_timestamp", "order_delivered_customer_date", "price", "freight_value",
            (F.col("price") + F.col("freight_value")).cast("decimal(12,2)").alias("total_item_value"),
        )
    )


def build_fact_funnel(leads: DataFrame, deals: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    """Leads with their deal; a seller id unknown to the dimension becomes NULL, the conversion stays."""
    known = dim_sellers.select("seller_id", F.lit(True).alias("_known"))
    won = deals.select("mql_id", "seller_id", "won_date", "sdr_id", "sr_id").join(known, "seller_id", "left")
    return leads.join(won, "mql_id", "left").select(
        "mql_id",
        F.when(F.col("_known"), F.col("seller_id")).alias("seller_id"),
        dates.date_key(F.col("first_contact_date")).alias("first_contact_date_key"),
        dates.date_key(F.col("won_date")).alias("won_date_key"),
        F.col("origin").alias("lead_origin"), "landing_page_id", "sdr_id", "sr_id",
        F.col("seller_id").isNotNull().alias("is_converted"),
        dates.days_between(F.col("first_contact_date"), F.col("won_date")).alias("days_to_close"),
    )
