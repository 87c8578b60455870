"""Landing files: all-string reads of the eleven raw CSV sources."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, types as T

# Raw tables and their columns, in file order.
COLUMNS = {
    "closed_deals": ("mql_id", "seller_id", "sdr_id", "sr_id", "won_date", "business_segment", "lead_type", "lead_behaviour_profile",
        "has_company", "has_gtin", "average_stock", "business_type", "declared_product_catalog_size", "declared_monthly_revenue"),
    "customers": ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"),
    "marketing_qualified_leads": ("mql_id", "first_contact_date", "landing_page_id", "origin"),
    "order_reviews": ("review_id", "order_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date",
        "review_answer_timestamp"),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"),
    "order_payments": ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
    "products": ("product_id", "product_category_name", "product_name_length", "product_description_length", "product_photos_qty",
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"),
    "sellers": ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    "category_translation": ("product_category_name", "product_category_name_english"),
    "geolocation": ("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"),
    "orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date"),
}

# System folder each table lands in.
FOLDERS = {
    "closed_deals": "CRM", "customers": "CRM", "marketing_qualified_leads": "CRM", "order_reviews": "CRM",
    "order_items": "ERP1", "order_payments": "ERP1", "products": "ERP1", "sellers": "ERP1", "category_translation": "ERP1",
    "geolocation": "ERP2", "orders": "ERP2",
}

#: Tables whose quoted fields may hold line breaks.
MULTI_LINE = {"order_reviews"}


def schema_of(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in COLUMNS[table]])


def read_raw(spark: SparkSession, table: str, base: str, files: dict[str, str] | None = None) -> DataFrame:
    """One raw table as strings. ``base`` may be any folder or object-store URI Spark can reach.

    Only the review file is read with ``multiLine`` (its fields may span lines); such a file is
    not splittable, so large review feeds should land as many part files in one folder.
    """
    path = (files or {}).get(table, f"{FOLDERS[table]}/{table}.csv")
    reader = spark.read.schema(schema_of(table)).option("header", True).option("quote", '"').option("escape", '"')
    if table in MULTI_LINE:
        reader = reader.option("multiLine", True)
    return reader.csv(posixpath.join(base, path))


def read_local_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Developer read: header row, inferred types unless a schema is given; a missing file is an error at once."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
