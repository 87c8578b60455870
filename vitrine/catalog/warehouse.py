"""Star-schema builders and constraint checks on cleaned tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.catalog.registry import query
from vitrine.operators.placed import numbered
from vitrine.plans import checks, gold

# ---------------------------------------------------------------- cleaned tables


def _products(m):
    size = F.col("p_size")
    return m.table("part").select(
        F.col("p_partkey").alias("product_id"), F.when(size % 9 != 0, F.col("p_type")).alias("product_category_name"), size.alias("product_name_length"),
        (size * 10).alias("product_description_length"), (size % 5).alias("product_photos_qty"), size.alias("product_weight_g"), size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"), F.when(size % 4 != 0, size + 2).alias("product_width_cm"))


def _translation(m):
    return m.table("part").filter("p_type <> 'PROMO'").select(F.col("p_type").alias("product_category_name"), F.concat("p_type", F.lit(" en")).alias("product_category_name_english")).distinct()


def _places(m):
    """One row per (zip prefix, state)."""
    nation = m.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return m.table("supplier").join(nation, "s_nationkey").groupBy((F.col("s_suppkey") % 10).alias("geolocation_zip_code_prefix"), F.col("n_name").alias("geolocation_state")).agg(
        F.min(-(F.col("s_suppkey") % 30)).cast("decimal(18,10)").alias("geolocation_lat"), F.max(-(F.col("s_suppkey") % 40)).cast("decimal(18,10)").alias("geolocation_lng"))


_PLACES_SQL = """places AS (SELECT s_suppkey % 10 AS zip, n_name AS state, min(-(s_suppkey % 30)) AS lat, max(-(s_suppkey % 40)) AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def _customers(m):
    nation = m.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return m.table("customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("customer_id"), F.floor(F.col("c_custkey") / 2).alias("customer_unique_id"), (F.col("c_custkey") % 10).alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"))


def _deals(m):
    return m.table("events").filter("event_type = 'purchase'").select(
        (F.col("event_id") - 1).alias("mql_id"), F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("seller_id"), F.concat(F.lit("rep "), (F.col("user_id") % 10).cast("string")).alias("sdr_id"),
        F.lit("sr").alias("sr_id"), F.col("ts").alias("won_date"), F.concat(F.lit("seg "), (F.col("event_id") % 4).cast("string")).alias("business_segment"), F.lit("reseller").alias("business_type"),
        F.lit("online").alias("lead_type"), F.lit("cat").alias("lead_behaviour_profile"), F.col("event_id").cast("int").alias("declared_product_catalog_size"), F.lit(0).alias("declared_monthly_revenue"))


def _sellers(m):
    nation = m.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return m.table("supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("seller_id"), (F.col("s_suppkey") % 10).alias("seller_zip_code_prefix"), F.lit("x").alias("seller_city"), F.col("n_name").alias("seller_state"))


def _orders(m):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    return m.table("orders").select(
        key.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), day.alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") != "P", F.expr("timestampadd(DAY, cast(o_orderkey % 40 AS INT), o_orderdate)")).alias("order_delivered_customer_date"),
        (day + F.expr("INTERVAL 20 DAYS")).alias("order_estimated_delivery_date"))


_ORDERS_SQL = """tidy AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_orderdate AS bought,
CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS delivered, o_orderdate + INTERVAL 20 DAY AS promised FROM orders)"""


def _reviews(m):
    return m.table("events").select(F.col("event_id").alias("review_id"), (F.col("event_id") * 7 % 9001).alias("order_id"), (F.col("event_id") % 5 + 1).cast("int").alias("review_score"),
                                    F.col("event_type").alias("review_comment_message"), F.col("ts").alias("review_creation_date"))


# ---------------------------------------------------------------- dimensions and facts


@query("g01_dim_date", """WITH d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders))
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS SMALLINT) AS year_number, CAST(quarter(d) AS SMALLINT) AS quarter_number,
CAST(month(d) AS SMALLINT) AS month_number, monthname(d) AS month_name, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend FROM d""")
def g01(m):
    return gold.calendar_over(m.table("orders"), F.to_date("o_orderdate"))


@query("g02_dim_products", """SELECT p_partkey AS product_id, c AS category_name_pt, CASE WHEN c <> 'PROMO' THEN c || ' en' END AS category_name_en, CAST(p_size AS SMALLINT) AS name_length, p_size * 10 AS description_length,
CAST(p_size % 5 AS SMALLINT) AS photo_count, p_size AS weight_g, CAST(CASE WHEN p_size % 4 <> 0 THEN p_size * (p_size + 1) * (p_size + 2) END AS DECIMAL(18,2)) AS volume_cm3
FROM (SELECT *, CASE WHEN p_size % 9 <> 0 THEN p_type END AS c FROM part)""")
def g02(m):
    return gold.build_dim_products(_products(m), _translation(m)).drop("length_cm", "height_cm", "width_cm")


@query("g03_dim_customers", f"""WITH {_PLACES_SQL}, p AS (SELECT c_custkey // 2 AS customer_unique_id, c_custkey % 10 AS zip_code, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey
QUALIFY row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) = 1)
SELECT customer_unique_id, zip_code, city, p.state, CAST(lat AS DECIMAL(9,6)) AS latitude, CAST(lng AS DECIMAL(9,6)) AS longitude FROM p LEFT JOIN places ON zip = zip_code AND places.state = p.state""")
def g03(m):
    return gold.build_dim_customers(_customers(m), _places(m))


@query("g04_dim_sellers", f"""WITH {_PLACES_SQL}, d AS (SELECT user_id, 'seg ' || CAST(event_id % 4 AS VARCHAR) AS seg, CAST(event_id AS INTEGER) AS size FROM events WHERE event_type = 'purchase' AND event_id % 6 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1)
SELECT s_suppkey AS seller_id, s_suppkey % 10 AS zip_code, n_name AS state, CAST(lat AS DECIMAL(9,6)) AS latitude, CAST(lng AS DECIMAL(9,6)) AS longitude, seg AS business_segment, size AS catalog_size,
user_id IS NOT NULL AS came_from_marketing FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN d ON user_id = s_suppkey LEFT JOIN places ON zip = s_suppkey % 10 AND places.state = n_name""")
def g04(m):
    return gold.build_dim_sellers(_sellers(m), _deals(m), _places(m)).select("seller_id", "zip_code", "state", "latitude", "longitude", "business_segment", "catalog_size", "came_from_marketing")


@query("g05_fact_orders", f"""WITH {_ORDERS_SQL}, r AS (SELECT event_id * 7 % 9001 AS order_id, CAST(event_id % 5 + 1 AS SMALLINT) AS review_score, event_type AS review_text FROM events
QUALIFY row_number() OVER (PARTITION BY event_id * 7 % 9001 ORDER BY ts DESC, event_id) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY payment_value DESC, payment_sequential, payment_type DESC) AS rn FROM payments),
p AS (SELECT order_id, CAST(sum(payment_value) AS DECIMAL(12,2)) AS total_payment, max(CASE WHEN rn = 1 THEN payment_type END) AS primary_payment_type FROM k GROUP BY 1)
SELECT t.order_id, customer_id // 2 AS customer_unique_id, CAST(strftime(bought, '%Y%m%d') AS INTEGER) AS purchase_date_key, order_status, total_payment, primary_payment_type, review_score, review_text,
CAST(date_diff('day', CAST(bought AS DATE), CAST(delivered AS DATE)) AS INTEGER) AS delivery_days_actual, delivered > promised AS is_late_delivery, coalesce(total_payment <= 0, FALSE) AS is_invalid_payment
FROM tidy t JOIN customer ON c_custkey = customer_id LEFT JOIN r USING (order_id) LEFT JOIN p USING (order_id)""", "payments")
def g05(m):
    customers = _customers(m)
    return gold.build_fact_orders(_orders(m), customers, gold.build_dim_customers(customers, _places(m)), _reviews(m), m.payments())


_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"]


@query("g06_fact_order_items", f"""WITH {_ORDERS_SQL}, i AS (SELECT row_number() OVER (ORDER BY {', '.join(_ITEM)}) AS order_item_key, * FROM lineitem),
v AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS freight_value FROM i)
SELECT order_item_key, order_id, l_partkey AS product_id, l_suppkey AS seller_id, CAST(strftime(bought, '%Y%m%d') AS INTEGER) AS purchase_date_key, delivered AS order_delivered_customer_date, price, freight_value,
CAST(price + freight_value AS DECIMAL(12,2)) AS total_item_value FROM v JOIN tidy ON order_id = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def g06(m):
    raw = numbered(m.table("lineitem").select(*_ITEM), _ITEM, as_name="order_item_key")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    items = raw.select("order_item_key", F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), price.alias("price"),
                       (price * F.col("l_tax").cast("decimal(12,2)")).cast("decimal(12,2)").alias("freight_value"))
    sellers = m.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("seller_id"))
    return gold.build_fact_order_items(items, _orders(m), m.dim_products().filter("weight_g > 10"), sellers).drop("order_purchase_timestamp")


@query("g07_fact_funnel", """WITH d AS (SELECT event_id - 1 AS mql_id, CASE WHEN event_id % 6 <> 0 THEN user_id END AS seller_id, ts AS won, 'rep ' || CAST(user_id % 10 AS VARCHAR) AS sdr_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id AS mql_id, s_suppkey AS seller_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS first_contact_date_key, CAST(strftime(won, '%Y%m%d') AS INTEGER) AS won_date_key, event_type AS lead_origin, d.sdr_id,
d.seller_id IS NOT NULL AS is_converted, CAST(date_diff('day', CAST(ts AS DATE), CAST(won AS DATE)) AS INTEGER) AS days_to_close
FROM events e LEFT JOIN d ON d.mql_id = e.event_id LEFT JOIN supplier ON s_suppkey = d.seller_id""")
def g07(m):
    leads = m.table("events").select(F.col("event_id").alias("mql_id"), F.col("ts").alias("first_contact_date"), F.lit("page").alias("landing_page_id"), F.col("event_type").alias("origin"))
    return gold.build_fact_funnel(leads, _deals(m), _sellers(m)).drop("landing_page_id", "sr_id")


# ---------------------------------------------------------------- checks


def _star(m):
    items = m.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_key"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"))
    return {"dim_products": m.dim_products(), "dim_customers": m.dim_customers(), "dim_sellers": m.dim_sellers(), "fact_orders": m.orders_only(), "fact_order_items": items,
            "fact_marketing_funnel": m.fact_marketing_funnel()}


_KEY_SQL = "SELECT '{t}' AS table_name, '{k}' AS key_name, count(*) AS row_count, count(*) - count({e}) AS null_keys, count({e}) - count(DISTINCT {e}) AS repeated_keys FROM {f}"


@query("q01_key_checks", " UNION ALL ".join(_KEY_SQL.format(t=t, k=k, e=e, f=f) for t, k, e, f in [
    ("dim_products", "product_id", "p_partkey", "part"), ("dim_customers", "customer_unique_id", "c_custkey", "customer"), ("dim_sellers", "seller_id", "s_suppkey", "supplier"),
    ("fact_orders", "order_id", "o_orderkey", "orders"), ("fact_order_items", "order_item_key", "l_orderkey * 10 + l_linenumber", "lineitem"),
    ("fact_marketing_funnel", "mql_id", "event_id", "(SELECT event_id FROM events WHERE event_type = 'signup')")]))
def q01(m):
    return checks.check_keys(_star(m))


_REF_SQL = "SELECT '{t}' AS table_name, '{c}' AS column_name, '{r}' AS references_table, count(DISTINCT {c}) AS lost_values, count(*) AS lost_rows FROM {f} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {g})"


@query("q02_reference_checks", " UNION ALL ".join(_REF_SQL.format(t=t, c=c, r=r, f=f, k=k, g=g) for t, c, r, f, k, g in [
    ("fact_orders", "customer_unique_id", "dim_customers", "fact_orders", "c_custkey", "customer"), ("fact_order_items", "product_id", "dim_products", "fact_order_items", "p_partkey", "part"),
    ("fact_order_items", "seller_id", "dim_sellers", "fact_order_items", "s_suppkey", "supplier"), ("fact_order_items", "order_id", "fact_orders", "fact_order_items", "o_orderkey", "orders"),
    ("fact_marketing_funnel", "seller_id", "dim_sellers", "fact_marketing_funnel", "s_suppkey", "supplier")]), "fact_orders fact_order_items fact_marketing_funnel")
def q02(m):
    return checks.check_references(_star(m))


@query("q03_row_counts", "SELECT 'fact_order_items' AS table_name, CAST(count(*) AS BIGINT) AS source_rows, count(*) FILTER (p_size > 10) AS target_rows, count(*) = count(*) FILTER (p_size > 10) AS agrees FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def q03(m):
    known = m.dim_products().filter("weight_g > 10").select("product_id")
    items = m.fact_order_items()
    return checks.compare_counts(items, items.join(known, "product_id", "left_semi"), "fact_order_items")
