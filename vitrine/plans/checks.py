"""Constraint checks Spark does not enforce: keys, references, row counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Primary key of each star table.
PRIMARY_KEYS = {
    "dim_date": "date_key", "dim_products": "product_id", "dim_customers": "customer_unique_id", "dim_sellers": "seller_id",
    "fact_orders": "order_id", "fact_order_items": "order_item_key", "fact_marketing_funnel": "mql_id",
}
# References (table, column, referenced table, referenced column).
REFERENCES = [
    ("fact_orders", "customer_unique_id", "dim_customers", "customer_unique_id"),
    ("fact_orders", "purchase_date_key", "dim_date", "date_key"),
    ("fact_order_items", "product_id", "dim_products", "product_id"),
    ("fact_order_items", "seller_id", "dim_sellers", "seller_id"),
    ("fact_order_items", "purchase_date_key", "dim_date", "date_key"),
    ("fact_order_items", "order_id", "fact_orders", "order_id"),
    ("fact_marketing_funnel", "seller_id", "dim_sellers", "seller_id"),
    ("fact_marketing_funnel", "first_contact_date_key", "dim_date", "date_key"),
    ("fact_marketing_funnel", "won_date_key", "dim_date", "date_key"),
]


def key_check(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows, NULL keys and surplus rows of repeated keys."""
    per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("repeated_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(key).alias("key_name"), "row_count", "null_keys", "repeated_keys")


def reference_check(df: DataFrame, table: str, column: str, target: DataFrame, target_table: str, target_column: str) -> DataFrame:
    """Non-NULL values with no match. Values are merged before the join, so a frequent one is looked up once."""
    used = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count(F.lit(1)).alias("_n"))
    lost = used.join(target.select(F.col(target_column).alias("_ref")), "_ref", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("lost_values"), F.coalesce(F.sum("_n"), F.lit(0)).alias("lost_rows")).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(target_table).alias("references_table"), "lost_values", "lost_rows")


def check_keys(tables: dict[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    parts = [key_check(tables[t], t, k) for t, k in PRIMARY_KEYS.items() if t in tables and (names is None or t in names)]
    return reduce(DataFrame.unionByName, parts)


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [reference_check(tables[t], t, c, tables[r], r, rc) for t, c, r, rc in REFERENCES if t in tables and r in tables]
    return reduce(DataFrame.unionByName, parts)


def compare_counts(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """Source against target row count in one line."""
    sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(F.lit(0), F.lit(1)))
    return sides.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows")).select(
        F.lit(table).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("agrees"))
