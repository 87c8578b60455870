"""Profiling, outlier and imputation queries; gaps are put in by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.catalog.registry import query
from vitrine.functions import numbers
from vitrine.operators import impute, profile
from vitrine.plans import imputed

# ---------------------------------------------------------------- profiling


def _gappy_customers(m):
    k = F.col("c_custkey")
    return m.table("customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_name")).alias("c_name"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


_GAPPY = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"


@query("e01_e02_e11_null_report", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS row_count, count({c}) AS non_null, count(*) - count({c}) AS null_count, round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS null_pct FROM {_GAPPY}"
    for c, t in [("c_custkey", "bigint"), ("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string")]))
def e01(m):
    return profile.null_report(_gappy_customers(m))


@query("e03_duplicates", """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS exact_duplicates,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS key_duplicates FROM lineitem""")
def e03(m):
    return profile.duplicate_report(m.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])


_MONEY_COLUMNS = ["price", "freight_value", "total_item_value"]


@query("e04_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75 FROM fact_order_items""" for c in _MONEY_COLUMNS), "fact_order_items")
def e04(m):
    out = profile.describe(m.fact_order_items().select(*_MONEY_COLUMNS), _MONEY_COLUMNS)
    return out.select("column_name", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


def _bins_sql(source: str, value: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {value} AS x FROM {source}), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM v WHERE x IS NOT NULL),
c AS (SELECT CAST(least({bins - 1}, floor((x - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM v, e WHERE x IS NOT NULL GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS from_value, round(lo + (b + 1) * w, 6) AS to_value, coalesce(n, 0) AS n FROM (SELECT unnest(range({bins})) AS b), e LEFT JOIN c ON bin = b"""


def _rounded_bins(df):
    return df.select("bin", "n", F.round("from_value", 6).alias("from_value"), F.round("to_value", 6).alias("to_value"))


@query("e05_histogram", _bins_sql("fact_orders", "CAST(delivery_days_actual AS DOUBLE)", 30), "fact_orders")
def e05(m):
    return _rounded_bins(profile.histogram(m.fact_orders(), "delivery_days_actual", 30))


@query("e05_log_histogram", _bins_sql("(SELECT * FROM fact_order_items WHERE price > 0)", "log10(CAST(price AS DOUBLE))", 50), "fact_order_items")
def e05_log(m):
    return _rounded_bins(profile.histogram(m.fact_order_items(), "price", 50, log_scale=True))


@query("e06_box_stats", """WITH q AS (SELECT review_score, count(x) AS n, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75 FROM (SELECT review_score, CAST(delivery_days_actual AS DOUBLE) AS x FROM fact_orders) GROUP BY 1)
SELECT q.review_score, n, p25, p50, p75, min(d) FILTER (d BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS whisker_low, max(d) FILTER (d BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS whisker_high,
count(*) FILTER (d NOT BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS outliers FROM q JOIN (SELECT review_score, CAST(delivery_days_actual AS DOUBLE) AS d FROM fact_orders WHERE delivery_days_actual IS NOT NULL) f USING (review_score)
GROUP BY 1, 2, 3, 4, 5""", "fact_orders")
def e06(m):
    return profile.box_stats(m.fact_orders(), "review_score", "delivery_days_actual")


@query("e07_frequencies", """SELECT 'order_status' AS column_name, order_status AS value, count(*) AS n FROM fact_orders GROUP BY 2 UNION ALL SELECT 'review_score', CAST(review_score AS VARCHAR), count(*) FROM fact_orders GROUP BY 2
UNION ALL SELECT 'is_late_delivery', CAST(is_late_delivery AS VARCHAR), count(*) FROM fact_orders WHERE is_late_delivery IS NOT NULL GROUP BY 2""", "fact_orders")
def e07(m):
    return profile.frequencies(m.fact_orders(), ["order_status", "review_score", "is_late_delivery"])


@query("e07_top_states", "SELECT 'state' AS column_name, state AS value, count(*) AS n FROM dim_customers GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10", "dim_customers")
def e07_top(m):
    return profile.frequencies(m.dim_customers(), ["state"], 10)


@query("e07_channel_by_outcome", "SELECT lead_origin, count(*) FILTER (NOT is_converted) AS lost, count(*) FILTER (is_converted) AS won, count(*) AS total FROM fact_marketing_funnel GROUP BY 1", "fact_marketing_funnel")
def e07_channel(m):
    return profile.cross_tab(m.fact_marketing_funnel(), "lead_origin", "is_converted", [False, True], ["lost", "won"])


@query("e08_buyers_by_year", """WITH c AS (SELECT purchase_date_key // 10000 AS y, customer_unique_id, count(*) AS k FROM fact_orders GROUP BY 1, 2), s AS (SELECT y, count(*) FILTER (k = 1) AS a, count(*) FILTER (k > 1) AS b FROM c GROUP BY 1)
SELECT t.year, coalesce(a, 0) AS one_time, coalesce(b, 0) AS repeat_buyers, coalesce(a + b, 0) AS total_customers, round(b::DOUBLE / nullif(a + b, 0) * 100, 1) AS repeat_pct FROM (SELECT unnest([1996, 1997, 1998, 2005]) AS year) t LEFT JOIN s ON y = t.year""", "fact_orders")
def e08(m):
    return profile.buyers_by_year(m.orders_only(), [1996, 1997, 1998, 2005])


@query("e09_price_outliers", """WITH q AS (SELECT quantile_cont(CAST(price AS DOUBLE), 0.25) AS a, quantile_cont(CAST(price AS DOUBLE), 0.75) AS b FROM fact_order_items)
SELECT order_id, product_id, price, CAST(price AS DOUBLE) < a - 1.5 * (b - a) OR CAST(price AS DOUBLE) > b + 1.5 * (b - a) AS is_price_outlier FROM fact_order_items, q""", "fact_order_items")
def e09(m):
    return profile.iqr_flagged(m.fact_order_items().select("order_id", "product_id", "price"), "price", "is_price_outlier")


@query("e10_value_checks", """SELECT 'zero_weight' AS check_name, count(*) FILTER (p_size % 10 = 0) AS n FROM part UNION ALL SELECT 'untranslated', count(*) FILTER (p_type = 'PROMO') FROM part""")
def e10(m):
    rows = m.table("part").select((F.col("p_size") % 10).alias("weight_g"), F.col("p_type").alias("category_name_pt"), F.nullif("p_type", F.lit("PROMO")).alias("category_name_en"))
    return profile.value_checks(rows, {"zero_weight": F.col("weight_g") == 0, "untranslated": F.col("category_name_pt").isNotNull() & F.col("category_name_en").isNull()})


@query("e12_density", """WITH v AS (SELECT CAST(delivery_days_actual AS DOUBLE) AS x, count(*) AS k FROM fact_orders WHERE delivery_days_actual IS NOT NULL GROUP BY 1),
s AS (SELECT min(delivery_days_actual)::DOUBLE AS lo, max(delivery_days_actual)::DOUBLE AS hi, count(delivery_days_actual) AS n, stddev_samp(CAST(delivery_days_actual AS DOUBLE)) * pow(count(delivery_days_actual)::DOUBLE, -0.2) AS h FROM fact_orders),
g AS (SELECT p, lo + p * (hi - lo) / 49 AS spot, n, h FROM s, (SELECT unnest(range(50)) AS p))
SELECT CAST(p AS INTEGER) AS point, round(spot, 6) AS at_value, round(sum(k * exp(-0.5 * ((spot - x) / h) * ((spot - x) / h)) / (n * h * sqrt(2 * pi()))), 10) AS density FROM g, v GROUP BY 1, 2""", "fact_orders")
def e12(m):
    out = profile.density(m.fact_orders(), "delivery_days_actual")
    return out.select("point", F.round("at_value", 6).alias("at_value"), F.round("density", 10).alias("density"))


@query("e13_delay_against_score", """SELECT delivery_days_actual, is_late_delivery, count(*) AS n, avg(review_score) AS mean_score, avg(review_score) > 3.5 AS above_boundary FROM fact_orders WHERE delivery_days_actual <= 100 GROUP BY 1, 2""", "fact_orders")
def e13(m):
    return profile.delay_against_score(m.fact_orders())


# ---------------------------------------------------------------- imputation


@query("i01_standard_place", """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip_code, coalesce(lower(seg), 'unknown') AS city, upper(n_name) AS state, coalesce(lower(seg), 'unknown') AS segment
FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer) JOIN nation ON c_nationkey = n_nationkey""")
def i01(m):
    seg = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    rows = m.table("customer").join(m.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(
        "c_custkey", F.col("c_custkey").alias("zip_code"), seg.alias("city"), F.lower("n_name").alias("state"), seg.alias("segment"))
    return impute.filled_text(impute.standard_place(rows, "unknown"), ["segment"])


@query("i02_foreign_places", """SELECT customer_unique_id, CASE WHEN ok THEN latitude END AS latitude, CASE WHEN ok THEN longitude END AS longitude FROM
(SELECT customer_unique_id, latitude + 3 AS latitude, longitude * 1.01 AS longitude, latitude + 3 BETWEEN -33.75 AND 5.27 AND longitude * 1.01 BETWEEN -73.98 AND -34.79 AS ok FROM dim_customers)""", "dim_customers")
def i02(m):
    rows = m.dim_customers().select("customer_unique_id", (F.col("latitude") + 3).alias("latitude"), (F.col("longitude") * 1.01).alias("longitude"))
    return impute.without_foreign_places(rows)


@query("i03_ordinal_codes", "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def i03(m):
    return impute.ordinal_codes(m.table("part"), "p_brand")


@query("i04_min_max", """WITH b AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS z FROM part) SELECT p_partkey, round((p_size - a) / (z - a), 9) AS p_size_scaled, round((p_size - a) / (z - a) * (z - a) + a, 6) AS back FROM part, b""")
def i04(m):
    scaled, ends = impute.min_max(m.table("part").select("p_partkey", "p_size"), ["p_size"])
    return scaled.select("p_partkey", F.round("p_size_scaled", 9).alias("p_size_scaled"), F.round(impute.unscaled(F.col("p_size_scaled"), ends, "p_size"), 6).alias("back"))


_KNN = ["p_type_encoded_scaled", "p_brand_encoded_scaled", "p_retailprice_scaled", "p_size_scaled"]


@query("i05_knn", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS s, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS t, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS b, p_retailprice AS r FROM part),
e AS (SELECT min(t) AS t0, max(t) - min(t) AS tw, min(b) AS b0, max(b) - min(b) AS bw, min(r) AS r0, max(r) - min(r) AS rw, min(s)::DOUBLE AS s0, (max(s) - min(s))::DOUBLE AS sw FROM p),
x AS (SELECT p_partkey, (t - t0) / tw AS t, (b - b0) / bw AS b, (r - r0) / rw AS r, (s - s0) / sw AS s, s0, sw FROM p, e),
d AS (SELECT q.p_partkey, d.s, round(sqrt((pow(q.t - d.t, 2) + pow(q.b - d.b, 2) + pow(q.r - d.r, 2)) * 4 / 3), 12) AS dist FROM x q, x d WHERE q.s IS NULL AND d.s IS NOT NULL),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY dist, s) <= 5),
w AS (SELECT p_partkey, CASE WHEN min(dist) = 0 THEN avg(s) FILTER (dist = 0) ELSE sum(s / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS s FROM k GROUP BY 1)
SELECT x.p_partkey, round(coalesce(x.s, w.s) * sw + s0, 6) AS p_size FROM x LEFT JOIN w USING (p_partkey)""")
def i05(m):
    part = m.table("part").select("p_partkey", "p_type", "p_brand", "p_retailprice", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    coded = impute.encoded(part, ["p_type", "p_brand"])
    scaled, ends = impute.min_max(coded, ["p_type_encoded", "p_brand_encoded", "p_retailprice", "p_size"])
    filled = impute.knn_filled(scaled, _KNN, "p_size_scaled")
    return filled.select("p_partkey", F.round(impute.unscaled(F.col("p_size_scaled"), ends, "p_size"), 6).alias("p_size"))


def _knn_sql(rows: str, key: str, categories: list[str], numbers: list[str], targets: list[str], outputs: str, k: int = 5) -> str:
    """Every row that lacks a target beside every row that has it."""
    columns = [*categories, *numbers]
    codes = ", ".join([f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END::DOUBLE AS {c}" for c in categories] + [f"{n}::DOUBLE AS {n}" for n in numbers])
    ends = ", ".join(f"min({c}) AS {c}_low, max({c}) - min({c}) AS {c}_wide" for c in columns)
    scaled = ", ".join(f"({c} - {c}_low) / CASE WHEN {c}_wide = 0 THEN 1 ELSE {c}_wide END AS {c}" for c in columns)
    total = " + ".join(f"coalesce(pow(q.{c} - d.{c}, 2), 0)" for c in columns)
    shared = " + ".join(f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in columns)
    pairs = " UNION ALL ".join(f"SELECT q.{key}, '{t}' AS target, d.{t} AS v, round(sqrt(({total}) * {len(columns)} / nullif({shared}, 0)), 12) AS dist FROM x q, x d "
                               f"WHERE q.{t} IS NULL AND d.{t} IS NOT NULL" for t in targets)
    back = ", ".join(f"coalesce(p.{t}::DOUBLE, coalesce(w_{t}, m_{t}) * CASE WHEN {t}_wide = 0 THEN 1 ELSE {t}_wide END + {t}_low) AS {t}" for t in targets)
    return f"""WITH p AS ({rows}), c AS (SELECT {key}, {codes} FROM p), e AS (SELECT {ends} FROM c), x AS (SELECT {key}, {scaled} FROM c, e),
m AS (SELECT {", ".join(f"avg({t}) AS m_{t}" for t in targets)} FROM x), d AS (SELECT * FROM ({pairs}) WHERE dist IS NOT NULL),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY {key}, target ORDER BY dist, v) <= {k}),
w AS (SELECT {key}, target, CASE WHEN min(dist) = 0 THEN avg(v) FILTER (dist = 0) ELSE sum(v / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS v FROM k GROUP BY 1, 2),
b AS (SELECT {key}, {", ".join(f"max(v) FILTER (target = '{t}') AS w_{t}" for t in targets)} FROM w GROUP BY 1),
r AS (SELECT p.{key}, {back} FROM p LEFT JOIN b USING ({key}), e, m)
SELECT {key}, {outputs} FROM r"""


# Measures of a part, some of them made from its key, with gaps of several kinds.
_MEASURES = {
    "category_name_pt": "CASE WHEN p_partkey % 19 <> 0 THEN p_type END", "category_name_en": "p_brand", "name_length": "CASE WHEN p_partkey % 11 <> 0 THEN length(p_name) END",
    "description_length": "CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 97 + 3 END", "photo_count": "CASE WHEN p_partkey % 11 <> 0 THEN p_size % 6 END",
    "weight_g": "CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END", "length_cm": "CASE WHEN p_partkey % 17 <> 0 THEN p_size END",
    "height_cm": "CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 41 END", "width_cm": "CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 7) % 53 END",
}
_WHOLE = ", ".join(f"round_even({c}, 0) AS {c}" for c in imputed.WHOLE_MEASURES)


@query("i05_product_measures", _knn_sql(
    "SELECT p_partkey AS product_id, " + ", ".join(f"{v} AS {n}" for n, v in _MEASURES.items()) + " FROM part", "product_id", ["category_name_pt", "category_name_en"],
    list(imputed.PRODUCT_MEASURES), list(imputed.PRODUCT_MEASURES),
    f"{_WHOLE}, " + ", ".join(f"round({c}, 6) AS {c}" for c in imputed.PRODUCT_MEASURES[3:]) + ", round(length_cm * height_cm * width_cm, 3) AS volume_cm3"))
def i05_products(m):
    rows = m.table("part").select(F.col("p_partkey").alias("product_id"), *[F.expr(v).alias(n) for n, v in _MEASURES.items()])
    done = imputed.complete_products(rows)
    return done.select("product_id", *imputed.WHOLE_MEASURES, *[F.round(c, 6).alias(c) for c in imputed.PRODUCT_MEASURES[3:]], F.round("volume_cm3", 3).alias("volume_cm3"))


_PLACES = {"city": "concat('city ', CAST(s_suppkey % 13 AS VARCHAR(20)))", "zip_code": "CAST(s_suppkey * 37 % 9999 AS VARCHAR(20))",
           "latitude": "CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS DOUBLE) + s_suppkey % 7 / 10.0 - 30 END",
           "longitude": "CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 11 AS DOUBLE) / 10.0 - 50 END"}


@query("i05_seller_places", _knn_sql(
    "SELECT s_suppkey AS seller_id, n_name AS state, " + ", ".join(f"{f'CAST({v} AS DOUBLE)' if n == 'zip_code' else v} AS {n}" for n, v in _PLACES.items())
    + " FROM supplier JOIN nation ON s_nationkey = n_nationkey", "seller_id", ["state", "city"], ["zip_code", "latitude", "longitude"], ["latitude", "longitude"],
    "round(latitude, 6) AS latitude, round(longitude, 6) AS longitude"))
def i05_sellers(m):
    nation = m.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    rows = m.table("supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("seller_id"), "state", *[F.expr(v).alias(n) for n, v in _PLACES.items()])
    return imputed.complete_sellers(rows).select("seller_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("i06_forest")
def i06(m):
    rows = impute.encoded(m.dim_customers(), ["state", "city"]).select("customer_unique_id", F.col("customer_unique_id").cast("double").alias("zip_number"), "state_encoded", "city_encoded", "latitude", "longitude")
    return impute.forest_filled(rows, ["zip_number", "state_encoded", "city_encoded", "latitude", "longitude"])


@query("i07_rounded_volume", "SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN p_size // 2 ELSE (p_size + 1) // 2 END AS photo_count, CAST(p_size * (p_size + 1) * 2 AS DOUBLE) AS volume_cm3 FROM part")
def i07(m):
    size = F.col("p_size").cast("double")
    return m.table("part").select("p_partkey", F.bround(numbers.money(size / 2), 0).cast("bigint").alias("photo_count"), (size * (size + 1) * 2).alias("volume_cm3"))
