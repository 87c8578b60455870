"""Projection, join, aggregate, window, sort, set and scalar operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from vitrine.catalog.hashing import CRC_TABLES, crc
from vitrine.catalog.registry import query
from vitrine.functions import dates, numbers, rules, text
from vitrine.ml import language
from vitrine.operators import keyed, placed
from vitrine.operators.profile import cross_tab, frequencies
from vitrine.plans import gold
from vitrine.session import scratch_path
from vitrine.sources import bronze, store

# ---------------------------------------------------------------- sources and sinks


@query("s01_csv_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS order_status FROM orders""")
def s01(m):
    """Write the orders as landing files, read them back as strings."""
    path = scratch_path(m.spark, "landing")
    cols = [F.lit("") if c not in ("order_id", "customer_id", "order_status") else F.col(c) for c in bronze.COLUMNS["orders"]]
    o = m.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"))
    o.select(*[c.cast("string").alias(n) for c, n in zip(cols, bronze.COLUMNS["orders"])]).write.option("header", True).csv(path)
    return bronze.read_raw(m.spark, "orders", path, {"orders": ""}).select("order_id", "customer_id", "order_status")


@query("s02_multiline_csv", """SELECT CAST(doc_id AS VARCHAR) AS review_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents""")
def s02(m):
    """Write whole documents as quoted fields with line breaks, read them back."""
    path = scratch_path(m.spark, "reviews")
    names = list(bronze.COLUMNS["order_reviews"])
    filled = {"review_id": F.col("doc_id").cast("string"), "review_comment_message": F.col("text")}
    m.table("documents").select(*[filled.get(n, F.lit("x")).alias(n) for n in names]).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = bronze.read_raw(m.spark, "order_reviews", path, {"order_reviews": ""})
    message = F.col("review_comment_message")
    return back.select("review_id", F.length(message).cast("bigint").alias("n_chars"), F.md5(message).alias("text_md5"))


@query("s04_full_refresh", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def s04(m):
    """Replace a table twice; the second load leaves no rows of the first."""
    base = scratch_path(m.spark, "lake")
    store.replace_table(m.table("part"), base, "part")
    store.replace_table(m.table("part"), base, "part")
    return store.read_table(m.spark, base, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("s06_query_read", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s06(m):
    return store.read_query(m.spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus", orders=m.table("orders"))


@query("s12_define_view", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def s12(m):
    store.define_view(m.dim_customers().groupBy(F.col("state").alias("n_name")).agg(F.count(F.lit(1)).alias("customers")), "market_sizes")
    return m.spark.table("market_sizes")


@query("s15_records", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","big_customer":' || coalesce(CAST(c AS VARCHAR), 'null') || '}' AS record
FROM nation LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS c FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey""")
def s15(m):
    big = m.table("customer").filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_custkey").alias("big_customer"))
    return store.as_records(m.table("nation").select("n_nationkey", "n_name").join(big, "n_nationkey", "left"))


# ---------------------------------------------------------------- projection, filter, predicate


@query("p01_projection", "SELECT p_partkey AS product_id, p_type AS category_name_en, p_brand AS brand FROM part")
def p01(m):
    return m.dim_products().select("product_id", "category_name_en", "brand")


@query("p02_safe_casts", """SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS whole_text, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS first_char,
TRY_CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS DECIMAL(12,2)) AS money, CASE WHEN left(o_orderpriority, 1) IN ('1','2','3','4','5') THEN TRUE END AS flag FROM orders""")
def p02(m):
    first = F.left("o_orderpriority", F.lit(1))
    return m.table("orders").select("o_orderkey", numbers.safe_int(F.col("o_orderpriority")).alias("whole_text"), numbers.safe_int(first).alias("first_char"),
                                    numbers.safe_money(numbers.money(F.col("o_totalprice")).cast("string")).alias("money"), numbers.safe_flag(first).alias("flag"))


@query("p03_safe_timestamps", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS moment FROM orders""")
def p03(m):
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("string")).otherwise(F.col("o_orderpriority"))
    return m.table("orders").select("o_orderkey", dates.parsed_moment(raw).alias("moment"))


@query("p04_strict_casts", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS DECIMAL(12,2)) AS money, CAST(o_orderdate AS DATE) AS day FROM orders")
def p04(m):
    return m.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"), numbers.money(F.col("o_totalprice")).alias("money"),
                                    F.col("o_orderdate").cast("date").alias("day"))


@query("p05_value_remap", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1-5' WHEN 1 THEN '5-20' ELSE CAST(p_size AS VARCHAR) END AS stock FROM part""")
def p05(m):
    mangled = F.when(F.col("p_size") % 4 == 0, "5-Jan").when(F.col("p_size") % 4 == 1, "20-May").otherwise(F.col("p_size").cast("string"))
    return m.table("part").select("p_partkey", text.undo_date_mangling(mangled).alias("stock"))


@query("p06_bands", """SELECT c_custkey, CASE WHEN b >= 5000 THEN 'high' WHEN b >= 0 THEN 'low' WHEN b IS NULL THEN 'unknown' ELSE 'debt' END AS band
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer)""")
def p06(m):
    b = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return m.table("customer").select("c_custkey", F.when(b >= 5000, "high").when(b >= 0, "low").when(b.isNull(), "unknown").otherwise("debt").alias("band"))


@query("p07_late_flag", "SELECT order_id, is_late_delivery FROM fact_orders", "fact_orders")
def p07(m):
    return m.fact_orders().select("order_id", "is_late_delivery")


@query("p08_flags", """SELECT c_custkey, coalesce(c_acctbal <= 0, FALSE) AS unpaid, n IS NOT NULL AS has_orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def p08(m):
    n = m.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return m.table("customer").join(n, "c_custkey", "left").select("c_custkey", rules.unpaid_flag(F.col("c_acctbal")).alias("unpaid"), F.col("n").isNotNull().alias("has_orders"))


@query("p09_in_lists", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('P') AND left(o_orderpriority, 1) IN ('1', '5')")
def p09(m):
    return m.table("orders").filter(~F.col("o_orderstatus").isin("P") & F.left("o_orderpriority", F.lit(1)).isin("1", "5")).select("o_orderkey", "o_orderstatus")


@query("p10_ranges", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'")
def p10(m):
    return m.table("orders").filter((F.col("o_totalprice").between(100000, 200000)) & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                                    & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("p11_null_tests", "SELECT is_late_delivery IS NULL AS unknown, count(*) AS n, count(review_text) AS with_text FROM fact_orders GROUP BY 1", "fact_orders")
def p11(m):
    return m.fact_orders().groupBy(F.col("is_late_delivery").isNull().alias("unknown")).agg(F.count(F.lit(1)).alias("n"), F.count("review_text").alias("with_text"))


@query("p12_patterns", r"""SELECT doc_id, text LIKE '%@%' AS has_at, regexp_matches(text, '[0-9]') AS has_digit, p LIKE '% the%' AS has_word
FROM (SELECT doc_id, text, lower(text) AS p FROM documents)""")
def p12(m):
    t = F.col("text")
    return m.table("documents").select("doc_id", t.like("%@%").alias("has_at"), t.rlike("[0-9]").alias("has_digit"), F.lower(t).like("% the%").alias("has_word"))


@query("p13_guarded_ratio", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE)
/ nullif(CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_discount AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE), 0) AS r FROM lineitem GROUP BY 1, 2""")
def p13(m):
    off = F.when(F.col("l_linestatus") == "O", numbers.money(F.col("l_discount"))).otherwise(F.lit(0))
    return m.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(numbers.ratio(F.sum(numbers.money(F.col("l_tax"))), F.sum(off)).alias("r"))


@query("p14_defaults", "SELECT order_id, coalesce(delivery_days_actual, 0) AS days, coalesce(review_text, '') AS review FROM fact_orders", "fact_orders")
def p14(m):
    return m.fact_orders().select("order_id", F.coalesce("delivery_days_actual", F.lit(0)).alias("days"), F.coalesce("review_text", F.lit("")).alias("review"))


@query("p15_literals", "SELECT 'Total' AS kpi_name, 'BRL' AS context_name, count(*) AS kpi_value FROM orders")
def p15(m):
    return m.table("orders").agg(F.count(F.lit(1)).alias("kpi_value")).select(F.lit("Total").alias("kpi_name"), F.lit("BRL").alias("context_name"), "kpi_value")


@query("p16_arithmetic", "SELECT order_id, product_id, price, freight_value, total_item_value FROM fact_order_items", "fact_order_items")
def p16(m):
    return m.fact_order_items().select("order_id", "product_id", "price", "freight_value", "total_item_value")


@query("p17_mask", """SELECT customer_unique_id, CASE WHEN latitude BETWEEN -33.75 AND 5.27 AND longitude BETWEEN -73.98 AND -34.79 THEN latitude END AS latitude,
CASE WHEN latitude BETWEEN -33.75 AND 5.27 AND longitude BETWEEN -73.98 AND -34.79 THEN longitude END AS longitude
FROM (SELECT customer_unique_id, latitude * 1.5 AS latitude, longitude FROM dim_customers)""", "dim_customers")
def p17(m):
    from vitrine.operators.impute import without_foreign_places

    return without_foreign_places(m.dim_customers().select("customer_unique_id", (F.col("latitude") * 1.5).alias("latitude"), "longitude"))


@query("p18_fill", """SELECT order_id, coalesce(review_text, 'unknown') AS review_text, coalesce(delivery_days_actual, 0) AS delivery_days_actual FROM fact_orders""", "fact_orders")
def p18(m):
    return m.fact_orders().select("order_id", "review_text", "delivery_days_actual").fillna({"review_text": "unknown", "delivery_days_actual": 0})


@query("p19_dictionary", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'PROMO' THEN 'offer' ELSE 'unknown' END ELSE p_type END AS category FROM part""")
def p19(m):
    from vitrine.operators.impute import translated

    rows = m.table("part").select("p_partkey", F.col("p_type").alias("category_name_pt"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("category_name_en"))
    return translated(rows, {"ECONOMY": "budget", "PROMO": "offer"}).select("p_partkey", F.col("category_name_en").alias("category"))


@query("p20_valid_messages", "SELECT conv_id, turn, length(text) BETWEEN 10 AND 1000 AND trim(text) <> '' AND role IN ('user', 'assistant') AS is_valid FROM conversations")
def p20(m):
    return m.table("conversations").select("conv_id", "turn", (text.is_valid_request(F.col("text")) & F.col("role").isin("user", "assistant")).alias("is_valid"))


@query("p21_language_gate", rf"""WITH {CRC_TABLES},
l AS (SELECT doc_id, text, lang, doc_id % 4 = 2 AS held_out, trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) AS letters FROM documents),
c AS (SELECT doc_id, lang, held_out, list_filter(string_split(' ' || letters || ' ', ''), lambda x: x <> '') AS c FROM l WHERE length(letters) > 0),
g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(len(c) - 2), lambda i: c[i + 1] || c[i + 2] || c[i + 3])) AS gram FROM c),
coded AS (SELECT gram, {crc("gram")} % 8192 AS bucket FROM (SELECT DISTINCT gram FROM g), crc_table, hexes),
b AS (SELECT doc_id, bucket, count(*) AS n FROM g JOIN coded USING (gram) GROUP BY 1, 2),
seen AS (SELECT lang, bucket, count(*) AS n FROM g JOIN coded USING (gram) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
sums AS (SELECT lang, sum(n) + 8192 AS total FROM seen GROUP BY 1),
profile AS (SELECT lang, bucket, CAST(floor(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / total::DOUBLE)) AS BIGINT) AS says
    FROM sums CROSS JOIN (SELECT DISTINCT bucket FROM b) LEFT JOIN seen USING (lang, bucket)),
scored AS (SELECT doc_id, lang, CAST(sum(n * says) AS BIGINT) AS score FROM b JOIN profile USING (bucket) GROUP BY 1, 2),
best AS (SELECT doc_id, lang AS guess FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
SELECT doc_id, held_out, guess, CASE WHEN guess IS NOT NULL THEN guess = 'fr' ELSE length(trim(text)) >= 5 END AS passes FROM l LEFT JOIN best USING (doc_id)""")
def p21(m):
    """The profile is learnt from the languages of documents outside a held-out quarter and told for all."""
    docs = m.table("documents").withColumn("held_out", F.col("doc_id") % 4 == 2)
    told = language.with_language(docs, language.learn(docs.filter("not held_out")), "text", "guess")
    return told.select("doc_id", "held_out", "guess", rules.passes_language_gate(F.col("guess"), F.col("text"), "fr").alias("passes"))


@query("p22_intents", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(what is vitrine|about vitrine|%s)($|[^\p{L}\p{N}_])') THEN 'platform_info'
WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(%s)($|[^\p{L}\p{N}_])') THEN 'sql' ELSE 'general' END AS intent FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)"""
       % (rules.PLATFORM_WORDS, rules.QUERY_WORDS))
def p22(m):
    return m.table("conversations").select("conv_id", "turn", rules.intent_of(F.col("text")).alias("intent"))


@query("p23_first_column", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
def p23(m):
    o = m.table("orders")
    found = rules.first_present(o, ["purchase_date_key", "order_purchase_timestamp", "o_orderdate"])
    return o.groupBy(F.year(found).cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins


def _dated(m, fact="fact_orders"):
    days = F.broadcast(m.dim_date().select(F.col("date_key").alias("purchase_date_key"), "year_number"))
    return (m.fact_orders() if fact == "fact_orders" else m.orders_only()).join(days, "purchase_date_key")


@query("j01_date_join", "SELECT year_number, quarter_number, count(*) AS n FROM fact_orders JOIN dim_date ON date_key = purchase_date_key GROUP BY 1, 2", "fact_orders dim_date")
def j01(m):
    days = F.broadcast(m.dim_date().select(F.col("date_key").alias("purchase_date_key"), "year_number", "quarter_number"))
    return m.orders_only().join(days, "purchase_date_key").groupBy("year_number", "quarter_number").agg(F.count(F.lit(1)).alias("n"))


@query("j02_items_to_orders", "SELECT order_status, count(*) AS n, CAST(sum(price) AS DOUBLE) AS price FROM fact_order_items JOIN fact_orders USING (order_id) GROUP BY 1", "fact_order_items fact_orders")
def j02(m):
    return m.fact_order_items().join(m.orders_only().select("order_id", "order_status"), "order_id").groupBy("order_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("price"))


@query("j03_items_to_dims", """SELECT state, category_name_en, CAST(sum(total_item_value) AS DOUBLE) AS value FROM fact_order_items JOIN dim_products USING (product_id)
JOIN dim_sellers USING (seller_id) GROUP BY 1, 2""", "fact_order_items dim_products dim_sellers")
def j03(m):
    return m.fact_order_items().join(m.dim_products().select("product_id", "category_name_en"), "product_id").join(m.dim_sellers().select("seller_id", "state"), "seller_id").groupBy(
        "state", "category_name_en").agg(F.sum("total_item_value").cast("double").alias("value"))


@query("j04_known_only", "SELECT order_id, product_id FROM fact_order_items WHERE product_id IN (SELECT p_partkey FROM part WHERE p_size > 25)", "fact_order_items")
def j04(m):
    known = m.dim_products().filter("weight_g > 25").select("product_id")
    return m.fact_order_items().select("order_id", "product_id").join(known, "product_id", "left_semi")


@query("j05_lookup", "SELECT c_custkey, n, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j05(m):
    o = m.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last"))
    return m.table("customer").select("c_custkey").join(o, "c_custkey", "left")


@query("j06_composite_key", """SELECT c_custkey, c_nationkey, c_mktsegment, sellers FROM customer LEFT JOIN
(SELECT s_nationkey, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg, count(*) AS sellers FROM supplier GROUP BY 1, 2) ON s_nationkey = c_nationkey AND seg = c_mktsegment""")
def j06(m):
    s = m.table("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment")).agg(
        F.count(F.lit(1)).alias("sellers"))
    return m.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(s, ["c_nationkey", "c_mktsegment"], "left")


@query("j07_unknown_to_null", "SELECT event_id, s_suppkey AS seller_id FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def j07(m):
    s = m.table("supplier").select(F.col("s_suppkey").alias("seller_id"))
    e = m.table("events").select("event_id", "user_id")
    return e.join(s, e["user_id"] == s["seller_id"], "left").select("event_id", "seller_id")


@query("j08_left_on_first", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON o_custkey = c_custkey""")
def j08(m):
    last = keyed.first_per_key(m.table("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return m.table("customer").select("c_custkey").join(last.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")


@query("j09_prior_year", """WITH y AS (SELECT year_number, CAST(sum(total_payment) AS DOUBLE) AS paid FROM fact_orders JOIN dim_date ON date_key = purchase_date_key GROUP BY 1)
SELECT a.year_number, a.paid, b.paid AS prior_paid FROM y a LEFT JOIN y b ON b.year_number = a.year_number - 1""", "fact_orders dim_date")
def j09(m):
    y = _dated(m, "orders").groupBy("year_number").agg(F.sum("total_payment").cast("double").alias("paid"))
    from vitrine.plans.kpi import _prior

    return _prior(y, ["paid"])


@query("j10_prior_year_by_category", """WITH y AS (SELECT year_number, nullif(category_name_en, 'PROMO') AS category, CAST(sum(price) AS DOUBLE) AS revenue FROM fact_order_items JOIN fact_orders USING (order_id)
JOIN dim_date ON date_key = purchase_date_key JOIN dim_products USING (product_id) GROUP BY 1, 2)
SELECT a.year_number, a.category, a.revenue, b.revenue AS prior_revenue FROM y a LEFT JOIN y b ON b.category = a.category AND b.year_number = a.year_number - 1""",
       "fact_order_items fact_orders dim_date dim_products")
def j10(m):
    from vitrine.plans.kpi import _prior

    named = m.dim_products().select("product_id", F.nullif("category_name_en", F.lit("PROMO")).alias("category"))
    y = m.fact_order_items().join(_dated(m, "orders").select("order_id", "year_number"), "order_id").join(named, "product_id").groupBy("year_number", "category").agg(
        F.sum("price").cast("double").alias("revenue"))
    return _prior(y, ["revenue"], ["category"])


@query("j11_flag_pivot", """WITH s AS (SELECT year_number, came_from_marketing AS f, CAST(sum(total_item_value) AS DOUBLE) AS v FROM fact_order_items JOIN fact_orders USING (order_id)
JOIN dim_date ON date_key = purchase_date_key JOIN dim_sellers USING (seller_id) GROUP BY 1, 2)
SELECT a.year_number, a.v AS marketing, b.v AS organic FROM s a JOIN s b USING (year_number) WHERE a.f AND NOT b.f""", "fact_order_items fact_orders dim_date dim_sellers")
def j11(m):
    rows = m.fact_order_items().join(_dated(m, "orders").select("order_id", "year_number"), "order_id").join(m.dim_sellers(), "seller_id")
    won, v = F.col("came_from_marketing"), F.col("total_item_value")
    return rows.groupBy("year_number").agg(F.sum(F.when(won, v)).cast("double").alias("marketing"), F.sum(F.when(~won, v)).cast("double").alias("organic")).dropna()


@query("j12_latest_year", """SELECT review_score, count(*) AS n FROM fact_orders WHERE purchase_date_key // 10000 = (SELECT max(purchase_date_key // 10000) FROM fact_orders) GROUP BY 1""", "fact_orders")
def j12(m):
    o = m.orders_only()
    last = o.agg(F.max("purchase_date_key")).scalar()
    return o.filter(F.floor(F.col("purchase_date_key") / 10000) == F.floor(last / 10000)).groupBy("review_score").agg(F.count(F.lit(1)).alias("n"))


@query("j13_scalar_bound", "SELECT customer_unique_id, date_diff('day', max(d), (SELECT max(o_orderdate) FROM orders)) AS idle FROM (SELECT o_custkey AS customer_unique_id, o_orderdate AS d FROM orders) GROUP BY 1")
def j13(m):
    o = m.table("orders")
    last = o.agg(F.max("o_orderdate")).scalar()
    return o.groupBy(F.col("o_custkey").alias("customer_unique_id")).agg(F.max("o_orderdate").alias("_d")).select(
        "customer_unique_id", F.date_diff(last, F.col("_d")).cast("bigint").alias("idle"))


@query("j14_year_aggregates", """SELECT a.year_number, n, sellers FROM (SELECT year_number, count(*) AS n FROM fact_orders JOIN dim_date ON date_key = purchase_date_key GROUP BY 1) a
JOIN (SELECT year_number, count(DISTINCT seller_id) AS sellers FROM fact_order_items JOIN fact_orders USING (order_id) JOIN dim_date ON date_key = purchase_date_key GROUP BY 1) b USING (year_number)""",
       "fact_orders fact_order_items dim_date")
def j14(m):
    o = _dated(m, "orders")
    sellers = m.fact_order_items().select("order_id", "seller_id").join(o.select("order_id", "year_number"), "order_id").groupBy("year_number").agg(F.count_distinct("seller_id").alias("sellers"))
    return o.groupBy("year_number").agg(F.count(F.lit(1)).alias("n")).join(sellers, "year_number")


# ---------------------------------------------------------------- aggregates


@query("a01_group_by", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS price, CAST(min(l_quantity) AS DOUBLE) AS least,
max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2""")
def a01(m):
    return m.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(numbers.money(F.col("l_extendedprice"))).cast("double").alias("price"), F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a02_conditional_counts", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS delivered, count(*) FILTER (WHERE o_orderstatus = 'P') AS canceled FROM orders GROUP BY 1")
def a02(m):
    return m.table("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("delivered"), F.count_if(F.col("o_orderstatus") == "P").alias("canceled"))


@query("a03_distinct_count", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS sellers FROM lineitem GROUP BY 1")
def a03(m):
    return m.table("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("sellers"))


@query("a04_conditional_distinct", "SELECT year(o_orderdate) AS y, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS customers FROM orders GROUP BY 1")
def a04(m):
    return m.table("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count_distinct(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).alias("customers"))


@query("a05_conditional_mean", "SELECT order_status, avg(CASE WHEN is_late_delivery THEN review_score END) AS late_score FROM fact_orders GROUP BY 1", "fact_orders")
def a05(m):
    return m.fact_orders().groupBy("order_status").agg(F.avg(F.when(F.col("is_late_delivery"), F.col("review_score"))).alias("late_score"))


@query("a06_ratio_of_sums", "SELECT seller_id, round(CAST(sum(freight_value) AS DOUBLE) / nullif(CAST(sum(total_item_value) AS DOUBLE), 0) * 100, 2) AS freight_pct FROM fact_order_items GROUP BY 1", "fact_order_items")
def a06(m):
    return m.fact_order_items().groupBy("seller_id").agg(numbers.percent(F.sum("freight_value"), F.sum("total_item_value"), 2).alias("freight_pct"))


@query("a07_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def a07(m):
    return m.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("a08_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS paid FROM orders")
def a08(m):
    return m.table("orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.sum(numbers.money(F.col("o_totalprice"))).cast("double").alias("paid"))


@query("a09_two_level", """SELECT state, count(*) AS customers, max(n) AS most, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT customer_unique_id, count(*) AS n FROM fact_orders GROUP BY 1)
JOIN dim_customers USING (customer_unique_id) GROUP BY 1""", "fact_orders dim_customers")
def a09(m):
    n = m.orders_only().groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(m.dim_customers().select("customer_unique_id", "state"), "customer_unique_id").groupBy("state").agg(
        F.count(F.lit(1)).alias("customers"), F.max("n").alias("most"), F.sum("n").alias("orders"))


@query("a10_value_at_max", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY payment_value DESC, payment_sequential, payment_type DESC) AS rn FROM payments)
SELECT order_id, sum(payment_value)::DECIMAL(12,2) AS total_payment, max(CASE WHEN rn = 1 THEN payment_type END) AS primary_payment_type FROM r GROUP BY 1""", "payments")
def a10(m):
    return gold.payments_per_order(m.payments())


@query("a11_representative", "SELECT c_nationkey, min(c_mktsegment) AS first_segment, max(c_name) AS last_name FROM customer GROUP BY 1")
def a11(m):
    return m.table("customer").groupBy("c_nationkey").agg(F.min("c_mktsegment").alias("first_segment"), F.max("c_name").alias("last_name"))


@query("a12_mean_place", "SELECT state, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM dim_customers GROUP BY 1", "dim_customers")
def a12(m):
    return m.dim_customers().groupBy("state").agg(F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"))


@query("a13_sum_over_sum", """SELECT y, s, v, round(v / sum(v) OVER (PARTITION BY y) * 100, 4) AS pct FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)""")
def a13(m):
    per = m.table("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("s")).agg(F.sum(numbers.money(F.col("o_totalprice"))).cast("double").alias("v"))
    return keyed.with_share(per, "v", ["y"], "pct", 4)


@query("a14_frequencies", """SELECT 'p_type' AS column_name, p_type AS value, count(*) AS n FROM part GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_type) <= 3
UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 3""")
def a14(m):
    return frequencies(m.table("part"), ["p_type", "p_brand"], 3)


@query("a15_cross_tab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS delivered, count(*) FILTER (o_orderstatus = 'O') AS shipped, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS total FROM orders GROUP BY 1")
def a15(m):
    return cross_tab(m.table("orders"), "o_orderpriority", "o_orderstatus", ["F", "O"], ["delivered", "shipped"])


@query("a16_pivot_percent", """SELECT o_orderstatus, count(*) FILTER (p = '1') AS urgent, count(*) FILTER (p = '5') AS low, count(*) FILTER (p IN ('1', '5')) AS total,
round(CAST(count(*) FILTER (p = '1') AS DOUBLE) / count(*) FILTER (p IN ('1', '5')) * 100, 1) AS urgent_pct FROM (SELECT o_orderstatus, left(o_orderpriority, 1) AS p FROM orders) GROUP BY 1""")
def a16(m):
    o = m.table("orders").select("o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("p"))
    return cross_tab(o, "o_orderstatus", "p", ["1", "5"], ["urgent", "low"]).withColumn("urgent_pct", numbers.percent(F.col("urgent"), F.col("total"), 1))


@query("a17_state_rollup", """SELECT state, count(*) AS n, avg(review_score) AS mean, min(order_id) AS first_order, min_by(review_score, order_id) AS first_score FROM fact_orders JOIN dim_customers USING (customer_unique_id) GROUP BY 1""",
       "fact_orders dim_customers")
def a17(m):
    return m.orders_only().join(m.dim_customers().select("customer_unique_id", "state"), "customer_unique_id").groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.avg("review_score").alias("mean"), F.min("order_id").alias("first_order"), F.min_by("review_score", "order_id").alias("first_score"))


# ---------------------------------------------------------------- windows


@query("w01_latest_per_key", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def w01(m):
    o = m.table("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return keyed.first_per_key(o, ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey")])


@query("w02_first_per_key", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def w02(m):
    return keyed.first_per_key(m.table("customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], [F.col("c_custkey")])


_YEAR_TYPE = """SELECT year_number AS y, category_name_en AS c, sum(price) AS r FROM fact_order_items JOIN fact_orders USING (order_id) JOIN dim_date ON date_key = purchase_date_key
JOIN dim_products USING (product_id) GROUP BY 1, 2"""


def _year_type(m):
    return m.fact_order_items().select("order_id", "product_id", "price").join(_dated(m, "orders").select("order_id", "year_number"), "order_id").join(
        m.dim_products().select("product_id", "category_name_en"), "product_id").groupBy(F.col("year_number").alias("y"), F.col("category_name_en").alias("c")).agg(F.sum("price").alias("r"))


_YEAR_ROLES = "fact_order_items fact_orders dim_date dim_products"


@query("w03_row_number", f"SELECT y, c, CAST(r AS DOUBLE) AS r, row_number() OVER (PARTITION BY y ORDER BY r DESC, c) AS place FROM ({_YEAR_TYPE})", _YEAR_ROLES)
def w03(m):
    # One row per (year, category): the window input is bounded by the catalogue of categories.
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.col("r").desc(), "c"))
    return _year_type(m).select("y", "c", F.col("r").cast("double").alias("r"), place.cast("bigint").alias("place"))


@query("w04_rank", "SELECT y, s, n, rank() OVER (PARTITION BY y ORDER BY n DESC) AS place FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS s, count(*) // 50 AS n FROM orders GROUP BY 1, 2)")
def w04(m):
    per = m.table("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderpriority").alias("s")).agg(F.floor(F.count(F.lit(1)) / 50).alias("n"))
    return per.withColumn("place", F.rank().over(Window.partitionBy("y").orderBy(F.col("n").desc())).cast("bigint"))


@query("w05_ntile", """SELECT y, c, ntile(4) OVER (PARTITION BY y ORDER BY v, c) AS tile FROM (SELECT year(o_orderdate) AS y, o_custkey AS c, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v FROM orders GROUP BY 1, 2)""")
def w05(m):
    per = m.table("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_custkey").alias("c")).agg(F.sum(numbers.money(F.col("o_totalprice"))).alias("v"))
    return placed.tiled(per, 4, ["v", "c"], ["y"]).select("y", "c", F.col("tile").cast("bigint").alias("tile"))


@query("w06_running_sum", """SELECT y, p, CAST(sum(v) OVER (PARTITION BY y ORDER BY v DESC, p ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
FROM (SELECT year(o_orderdate) AS y, l_partkey AS p, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)""")
def w06(m):
    o = m.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("bigint").alias("y"))
    per = m.table("lineitem").select("l_orderkey", "l_partkey", numbers.money(F.col("l_extendedprice")).alias("price")).join(o, "l_orderkey").groupBy("y", F.col("l_partkey").alias("p")).agg(F.sum("price").alias("v"))
    return placed.running_totals(per, {"v": "running"}, [("v", "desc"), "p"], ["y"]).select("y", "p", F.col("running").cast("double").alias("running"))


@query("w07_group_totals", f"SELECT y, c, CAST(sum(r) OVER (PARTITION BY y) AS DOUBLE) AS total, count(*) OVER (PARTITION BY y) AS categories FROM ({_YEAR_TYPE})", _YEAR_ROLES)
def w07(m):
    w = Window.partitionBy("y")
    return _year_type(m).select("y", "c", F.sum("r").over(w).cast("double").alias("total"), F.count(F.lit(1)).over(w).alias("categories"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("w08_global_number", f"SELECT row_number() OVER (ORDER BY CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), {', '.join(_LINE[2:])}) AS order_item_key, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def w08(m):
    as_text = {f"{c}_text": F.col(c).cast("string") for c in _LINE[:2]}
    rows = m.table("lineitem").select(*_LINE).withColumns(as_text)
    return placed.numbered(rows, [*as_text, *_LINE[2:]], as_name="order_item_key").select("order_item_key", "l_orderkey", "l_linenumber", "l_partkey")


@query("w09_moving_average", """SELECT d, n, CASE WHEN row_number() OVER (ORDER BY d) >= 7 THEN avg(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS ma
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)""")
def w09(m):
    per = m.table("events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.moving_average(per, "d", "n", 7, "ma")


@query("w10_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def w10(m):
    return keyed.first_per_key(m.table("conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn").desc()], 10)


@query("w11_top_per_group", f"SELECT y, c, CAST(r AS DOUBLE) AS r FROM ({_YEAR_TYPE}) QUALIFY row_number() OVER (PARTITION BY y ORDER BY r DESC, c) = 1", _YEAR_ROLES)
def w11(m):
    return keyed.first_per_key(_year_type(m), ["y"], [F.col("r").desc(), F.col("c")]).withColumn("r", F.col("r").cast("double"))


@query("w12_shares", "SELECT o_orderstatus, n, round(CAST(n AS DOUBLE) / sum(n) OVER () * 100, 2) AS share_pct FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def w12(m):
    return keyed.with_share(m.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "n")


# ---------------------------------------------------------------- sorts, limits, sets, composition


@query("o01_order_by", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def o01(m):
    return m.table("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_type")


@query("o02_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def o02(m):
    return m.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5)


@query("o03_top_by_size", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 20")
def o03(m):
    return m.table("customer").select("c_custkey", "c_acctbal").orderBy(F.abs(F.col("c_acctbal") - 4500).desc(), "c_custkey").limit(20)


@query("o04_unique_values", "SELECT DISTINCT p_brand, p_type FROM part")
def o04(m):
    return m.table("part").select("p_brand", "p_type").distinct()


@query("o05_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def o05(m):
    return m.table("customer").orderBy("c_custkey").limit(5)


@query("u01_long_format", """SELECT 'orders' AS kpi_name, CAST(count(*) AS DOUBLE) AS kpi_value FROM orders UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders
UNION ALL SELECT 'paid', CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) FROM orders""")
def u01(m):
    one = m.table("orders").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.count_distinct("o_custkey").cast("double").alias("customers"),
                                F.sum(numbers.money(F.col("o_totalprice"))).cast("double").alias("paid"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kpi_name"), F.col(n).alias("kpi_value")) for n in ("orders", "customers", "paid")])))


@query("u02_calendar", """SELECT CAST(d AS DATE) AS full_date, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders))
LEFT JOIN (SELECT o_orderdate AS k, count(*) AS n FROM orders GROUP BY 1) ON k = d""")
def u02(m):
    o = m.table("orders").select(F.to_date("o_orderdate").alias("full_date"))
    days = gold.calendar_over(o, F.col("full_date")).select("full_date")
    return keyed.dense_series(o.groupBy("full_date").agg(F.count(F.lit(1)).alias("n")), "full_date", days, {"n": 0})


@query("u03_reindex", "SELECT y AS year, coalesce(n, 0) AS n FROM (SELECT unnest([1999, 2000, 2001, 2002]) AS y) LEFT JOIN (SELECT year(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1) ON k = y")
def u03(m):
    per = m.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.dense_series(per, "year", m.spark.createDataFrame([(y,) for y in (1999, 2000, 2001, 2002)], "year int"), {"n": 0})


@query("n01_chained_steps", """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_nationkey, sum(n) AS n FROM a JOIN customer ON c_custkey = o_custkey GROUP BY 1),
c AS (SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n FROM b JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT r_name, n FROM c JOIN region ON r_regionkey = n_regionkey""")
def n01(m):
    per_customer = m.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    per_nation = per_customer.join(m.table("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("n"))
    per_region = per_nation.join(m.table("nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey").groupBy("r_regionkey").agg(F.sum("n").alias("n"))
    return per_region.join(m.table("region").select("r_regionkey", "r_name"), "r_regionkey").select("r_name", "n")


@query("n02_derived_table", "SELECT most, count(*) AS customers FROM (SELECT o_custkey, count(*) AS most FROM orders GROUP BY 1) GROUP BY 1")
def n02(m):
    return m.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("most")).groupBy("most").agg(F.count(F.lit(1)).alias("customers"))


@query("n03_column_chain", "SELECT c_custkey, upper(replace(substr(c_name, 10), '0', 'o')) || '!' AS tag FROM customer")
def n03(m):
    return m.table("customer").withColumn("a", F.substr(F.col("c_name"), F.lit(10))).withColumn("b", F.replace("a", F.lit("0"), F.lit("o"))).select("c_custkey", F.concat(F.upper("b"), F.lit("!")).alias("tag"))


@query("n04_window_on_groups", """SELECT o_orderstatus, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY y)::BIGINT AS year_n FROM (SELECT o_orderstatus, year(o_orderdate) AS y FROM orders) GROUP BY 1, 2""")
def n04(m):
    per = m.table("orders").groupBy("o_orderstatus", F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("year_n", F.sum("n").over(Window.partitionBy("y")))


# ---------------------------------------------------------------- scalar functions


@query("f01_replace_chain", "SELECT doc_id, md5(replace(replace(replace(replace(text, 'é', 'e'), 'the', 'THE'), '.', ''), ',', ';')) AS h FROM documents")
def f01(m):
    out = text.swap_all(F.col("text"), [("é", "e"), ("the", "THE"), (".", ""), (",", ";")])
    return m.table("documents").select("doc_id", F.md5(out).alias("h"))


@query("f02_f03_case_trim", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, trim('  ' || p_name || ' ') AS t FROM part")
def f02(m):
    return m.table("part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"))


@query("f04_collapse_spaces", r"SELECT doc_id, md5(regexp_replace(replace(text, ',', '  '), ' +', ' ', 'g')) AS h FROM documents")
def f04(m):
    return m.table("documents").select("doc_id", F.md5(text.single_spaced(F.replace("text", F.lit(","), F.lit("  ")))).alias("h"))


@query("f05_blank_to_null", "SELECT doc_id, nullif(regexp_replace(text, '[a-zA-Z ]', '', 'g'), '') AS odd FROM documents")
def f05(m):
    return m.table("documents").select("doc_id", text.blank_to_null(F.regexp_replace("text", "[a-zA-Z ]", "")).alias("odd"))


@query("f06_separators", "SELECT n_nationkey, replace(n_name, '_', ' ') AS a, replace(replace(n_name, '_', '-'), '-', ' ') AS b FROM nation")
def f06(m):
    n = F.col("n_name")
    return m.table("nation").select("n_nationkey", text.underscores_to_spaces(n).alias("a"), text.hyphens_to_spaces(F.translate(n, "_", "-")).alias("b"))


@query("f07_char_codes", "SELECT doc_id, md5(replace(replace(text, chr(160), ' '), chr(8217), '')) AS h FROM documents")
def f07(m):
    return m.table("documents").select("doc_id", F.md5(F.translate("text", "\u00a0\u2019", " ")).alias("h"))


@query("f08_substrings", "SELECT c_custkey, left(c_name, 8) AS l, substr(c_name, 10) AS r, instr(c_name, '#') AS at, length(c_name) AS n FROM customer")
def f08(m):
    n = F.col("c_name")
    return m.table("customer").select("c_custkey", F.left(n, F.lit(8)).alias("l"), F.substr(n, F.lit(10)).alias("r"), F.instr(n, "#").cast("bigint").alias("at"), F.length(n).cast("bigint").alias("n"))


@query("f09_concat", "SELECT order_id, review_text || ' | ' || CAST(review_score AS VARCHAR) AS label FROM fact_orders", "fact_orders")
def f09(m):
    return m.orders_only().select("order_id", F.concat("review_text", F.lit(" | "), F.col("review_score").cast("string")).alias("label"))


@query("f10_alphabet_filter", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '(http|www)[^{text.WHITE}]+', '', 'g'), '[^a-z0-9{text.WHITE} áéíóúãõçñ]', '', 'g'), '[{text.WHITE}]+', ' ', 'g'))) AS h FROM documents")
def f10(m):
    return m.table("documents").select("doc_id", F.md5(text.clean_for_model(F.col("text"))).alias("h"))


@query("f11_word_count", f"SELECT doc_id, CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '[{text.WHITE}]+')) END AS n FROM (SELECT doc_id, regexp_replace(text, '^[{text.WHITE}]+|[{text.WHITE}]+$', '', 'g') AS b FROM documents)")
def f11(m):
    return m.table("documents").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n"))


@query("f12_zero_pad", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS zip FROM customer")
def f12(m):
    return m.table("customer").select("c_custkey", text.zero_padded(F.col("c_custkey"), 3).alias("zip"))


@query("f13_slug", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def f13(m):
    return m.table("documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("f14_date_key", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders")
def f14(m):
    return m.table("orders").select("o_orderkey", dates.date_key(F.col("o_orderdate")).alias("date_key"))


@query("f15_key_to_date", "SELECT order_id, CAST(strptime(CAST(purchase_date_key AS VARCHAR), '%Y%m%d') AS DATE) AS day FROM fact_orders", "fact_orders")
def f15(m):
    return m.orders_only().select("order_id", dates.key_to_date(F.col("purchase_date_key")).alias("day"))


@query("f16_days_between", "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def f16(m):
    o = m.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey").select(
        "l_orderkey", "l_linenumber", dates.days_between(F.col("o_orderdate"), F.col("l_shipdate")).cast("bigint").alias("days"))


@query("f17_calendar_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS SMALLINT) AS year_number, CAST(quarter(o_orderdate) AS SMALLINT) AS quarter_number, CAST(month(o_orderdate) AS SMALLINT) AS month_number,
monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name, dayofweek(o_orderdate) IN (0, 6) AS is_weekend FROM orders""")
def f17(m):
    return m.table("orders").select("o_orderkey", *dates.calendar_parts(F.to_date("o_orderdate"))[2:])


@query("f18_round", "SELECT p_partkey, round(CAST(p_retailprice AS DECIMAL(12,4)) / 8, 2)::DOUBLE AS half_up, CASE WHEN p_size % 4 IN (0, 1) THEN p_size // 2 ELSE (p_size + 1) // 2 END AS half_even FROM part")
def f18(m):
    halves = F.bround((F.col("p_size") / 2).cast("decimal(12,2)"), 0).cast("bigint")
    return m.table("part").select("p_partkey", F.round(F.col("p_retailprice").cast("decimal(12,4)").cast("double") / 8, 2).alias("half_up"), halves.alias("half_even"))


@query("f19_truncate", "SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS whole FROM customer")
def f19(m):
    return m.table("customer").select("c_custkey", F.col("c_acctbal").cast("int").alias("whole"))


@query("f20_abs", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer")
def f20(m):
    return m.table("customer").select("c_custkey", F.abs("c_acctbal").alias("size"))


@query("f21_display_text", """SELECT order_id, CASE WHEN p IS NULL THEN '—' ELSE 'R$ ' || format('{:,.2f}', p) END AS currency, printf('%.2f', CAST(review_score AS DOUBLE)) || ' / 5' AS score,
CASE WHEN d IS NULL THEN '—' ELSE printf('%+d%%', d) END AS change FROM (SELECT order_id, CAST(CASE WHEN order_id % 7 <> 0 THEN total_payment END AS DOUBLE) AS p, review_score, delivery_days_actual AS d FROM fact_orders)""", "fact_orders")
def f21(m):
    paid = F.when(F.col("order_id") % 7 != 0, F.col("total_payment"))
    return m.fact_orders().select("order_id", numbers.currency_text(paid).alias("currency"), numbers.score_text(F.col("review_score")).alias("score"),
                                  numbers.signed_percent_text(F.col("delivery_days_actual")).alias("change"))


@query("f22_percent_to_number", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS pct FROM part")
def f22(m):
    raw = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("% "))).otherwise(F.col("p_type"))
    return m.table("part").select("p_partkey", numbers.parsed_percent(raw).alias("pct"))


@query("f23_tone", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '%s') THEN 'positive' WHEN regexp_matches(lower(text), '%s') THEN 'negative' ELSE 'neutral' END AS tone FROM conversations"
       % (rules.POSITIVE_WORDS, rules.NEGATIVE_WORDS))
def f23(m):
    return m.table("conversations").select("conv_id", "turn", rules.tone_of(F.col("text")).alias("tone"))


@query("f24_sentiment", "SELECT order_id, CASE WHEN s >= 4 THEN 'Positive' ELSE 'Negative' END AS sentiment FROM (SELECT order_id, CASE WHEN order_id % 7 <> 0 THEN review_score END AS s FROM fact_orders)", "fact_orders")
def f24(m):
    return m.orders_only().select("order_id", rules.sentiment_of(F.when(F.col("order_id") % 7 != 0, F.col("review_score"))).alias("sentiment"))


@query("f25_jitter")
def f25(m):
    return m.orders_only().select("order_id", numbers.jittered(F.col("review_score")).alias("review_score_jitter"))


@query("f26_marker_size", "SELECT c_nationkey, greatest(15.0, least(50.0, sqrt(count(*) / 2)))::DOUBLE AS size FROM customer GROUP BY 1")
def f26(m):
    return m.table("customer").groupBy("c_nationkey").agg(numbers.marker_size(F.count(F.lit(1))).alias("size"))


@query("f27_iso_text", "SELECT order_id, coalesce(strftime(d, '%Y-%m-%d'), '') AS day FROM (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders)")
def f27(m):
    return m.table("orders").select(F.col("o_orderkey").alias("order_id"), dates.iso_text(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))).alias("day"))
