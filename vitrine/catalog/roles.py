"""The given tables in the roles of the marketplace, once as DataFrames and once as SQL.

Money is cast to two decimals before it is summed; dates stay dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vitrine.functions import dates, numbers, rules
from vitrine.plans import gold
from vitrine.session import spread

CALENDAR = (dt.date(1995, 1, 1), dt.date(2024, 12, 31))


class Market:
    """Role tables built from one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dim_date(self) -> DataFrame:
        return gold.build_dim_date(self.spark, *CALENDAR)

    def dim_products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category_name_en"),
                                         F.col("p_brand").alias("brand"), F.col("p_size").alias("weight_g"))

    def dim_sellers(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
        return self.table("supplier").join(nation, "s_nationkey").select(
            F.col("s_suppkey").alias("seller_id"), "state", (F.col("s_acctbal") >= 5000).alias("came_from_marketing"))

    def dim_customers(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
        return self.table("customer").join(nation, "c_nationkey").select(
            F.col("c_custkey").alias("customer_unique_id"), "state", F.col("c_mktsegment").alias("city"),
            F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 3900) / 100.0 - 33.5).alias("latitude"),
            F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 3800) / 100.0 - 73.5).alias("longitude"))

    def orders_only(self) -> DataFrame:
        """Order facts that need no items."""
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "shipped").otherwise("canceled")
        return o.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_unique_id"),
            dates.date_key(F.col("o_orderdate")).alias("purchase_date_key"), F.col("o_orderdate").alias("purchased"), status.alias("order_status"),
            numbers.money(F.col("o_totalprice")).alias("total_payment"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("review_score"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("review_text"))

    def fact_orders(self) -> DataFrame:
        arrived = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("delivered"))
        late = rules.late_flag(F.col("delivered"), F.col("purchased") + F.expr("INTERVAL 365 DAYS"))
        return self.orders_only().join(arrived, "order_id", "left").select(
            "order_id", "customer_unique_id", "purchase_date_key", "order_status", "total_payment", "review_score", "review_text",
            dates.days_between(F.col("purchased"), F.col("delivered")).alias("delivery_days_actual"), late.alias("is_late_delivery"))

    def payments(self) -> DataFrame:
        paid = numbers.money(F.col("l_extendedprice")) * (1 - numbers.money(F.col("l_discount")))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("payment_sequential"), F.col("l_returnflag").alias("payment_type"),
            numbers.money(paid).alias("payment_value"))

    def fact_order_items(self) -> DataFrame:
        price = numbers.money(F.col("l_extendedprice"))
        freight = numbers.money(price * numbers.money(F.col("l_tax")))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            price.alias("price"), freight.alias("freight_value"), numbers.money(price + freight).alias("total_item_value"))

    def fact_marketing_funnel(self) -> DataFrame:
        """A lead is a sign-up; it is won by the same user's first purchase within a day.

        Both kinds of event are laid in one ordered stream per (user, day), a purchase also
        in the day before its own, so no pairs are formed and a busy user is spread over days.
        """
        e = self.table("events").filter(F.col("event_type").isin("signup", "purchase")).select(
            "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
        day = F.to_date("ts")
        days = F.when(F.col("event_type") == "purchase", F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))
        later = Window.partitionBy("user_id", "_day").orderBy(F.col("ts").desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
        bought = F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(later)
        e = e.withColumn("_day", F.explode(days))
        leads = e.withColumn("_won", bought).filter("event_type = 'signup'")
        won = F.when(F.col("_won") <= F.col("ts") + F.expr("INTERVAL 1 DAY"), F.col("_won"))
        return leads.select(
            F.col("event_id").alias("mql_id"), F.when(won.isNotNull(), F.col("user_id")).alias("seller_id"),
            dates.date_key(F.col("ts")).alias("first_contact_date_key"), dates.date_key(won).alias("won_date_key"),
            F.concat(F.lit("origin "), (F.col("k") % 5).cast("string")).alias("lead_origin"),
            F.concat(F.lit("rep "), (F.col("user_id") % 10).cast("string")).alias("sdr_id"),
            won.isNotNull().alias("is_converted"), dates.days_between(F.col("ts"), won).alias("days_to_close"))

    def reviews(self) -> DataFrame:
        """Documents with their quality label as a score: 5 good, 1 bad. Texts without a label are not dealt out."""
        labels = self.table("labels").select("doc_id", "quality")
        return spread(self.table("documents").join(labels, "doc_id")).select(
            "doc_id", "lang", F.col("text").alias("review_text"), F.when(F.col("quality") == 1, 5).otherwise(1).alias("review_score"))



ROLES = {
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS SMALLINT) AS year_number,
        CAST(quarter(d) AS SMALLINT) AS quarter_number, CAST(month(d) AS SMALLINT) AS month_number, monthname(d) AS month_name, dayname(d) AS day_name,
        dayofweek(d) IN (0, 6) AS is_weekend
        FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS d)""",
    "dim_products": "SELECT p_partkey AS product_id, p_type AS category_name_en, p_brand AS brand, p_size AS weight_g FROM part",
    "dim_sellers": "SELECT s_suppkey AS seller_id, n_name AS state, s_acctbal >= 5000 AS came_from_marketing FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "dim_customers": """SELECT c_custkey AS customer_unique_id, n_name AS state, c_mktsegment AS city,
        CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 3900 AS DOUBLE) / 100.0 - 33.5 END AS latitude,
        CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 3800 AS DOUBLE) / 100.0 - 73.5 END AS longitude
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fact_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS purchase_date_key,
        CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
        CAST(o_totalprice AS DECIMAL(12,2)) AS total_payment, CAST(left(o_orderpriority, 1) AS INTEGER) AS review_score,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS review_text,
        CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(delivered AS DATE)) AS INTEGER) AS delivery_days_actual,
        delivered > o_orderdate + INTERVAL 365 DAY AS is_late_delivery
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "payments": """SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag AS payment_type,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS payment_value FROM lineitem""",
    "fact_order_items": """SELECT order_id, product_id, seller_id, price, freight_value, CAST(price + freight_value AS DECIMAL(12,2)) AS total_item_value
        FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS freight_value FROM lineitem)""",
    "fact_marketing_funnel": """SELECT event_id AS mql_id, CASE WHEN won IS NOT NULL THEN user_id END AS seller_id,
        CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS first_contact_date_key, CAST(strftime(won, '%Y%m%d') AS INTEGER) AS won_date_key,
        'origin ' || CAST(k % 5 AS VARCHAR) AS lead_origin, 'rep ' || CAST(user_id % 10 AS VARCHAR) AS sdr_id, won IS NOT NULL AS is_converted,
        CAST(date_diff('day', CAST(ts AS DATE), CAST(won AS DATE)) AS INTEGER) AS days_to_close
        FROM (SELECT s.event_id, any_value(s.user_id) AS user_id, any_value(s.ts) AS ts, any_value(CAST(json_extract_string(s.props, '$.k') AS INTEGER)) AS k, min(p.ts) AS won
              FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase'
                AND (p.ts > s.ts OR (p.ts = s.ts AND p.event_id > s.event_id)) AND p.ts <= s.ts + INTERVAL 1 DAY
              WHERE s.event_type = 'signup' GROUP BY s.event_id)""",
    "reviews": "SELECT doc_id, lang, text AS review_text, CASE WHEN quality = 1 THEN 5 ELSE 1 END AS review_score FROM documents JOIN labels USING (doc_id)",
}


def with_roles(sql: str, names: list[str]) -> str:
    """Put the named roles in front of a statement, joining its own WITH list if it has one."""
    sql = sql.strip()
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({ROLES[n]})" for n in names)
    return f"WITH {head},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head}\n{sql}"
