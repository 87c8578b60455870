"""Dashboard page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.catalog import kpis
from vitrine.catalog.registry import query
from vitrine.plans import dashboards, kpi, legacy


def _inner(sql: str) -> str:
    """A WITH statement as a derived table."""
    return f"({sql})"


def _tone(column: str) -> str:
    return (f"CASE WHEN regexp_matches(lower({column}), 'improved|increased|healthy|strong|good|excellent|stable') THEN 'positive' "
            f"WHEN regexp_matches(lower({column}), 'declined|decreased|critical|high|negative|risk') THEN 'negative' ELSE 'neutral' END")


def _pct(value: str, sign: str = "") -> str:
    return f"CASE WHEN {value} IS NULL THEN '—' WHEN {value} = floor({value}) THEN printf('%{sign}d%%', CAST({value} AS BIGINT)) ELSE printf('%{sign}.1f%%', {value}) END"


@query("d01_overview_cards", f"""WITH v AS (SELECT * FROM {_inner(kpis._OVERVIEW_SQL)}), y AS (SELECT * FROM v WHERE year_number = (SELECT max(year_number) FROM v)),
c AS (SELECT *, CASE kpi_name WHEN 'Gross Merchandise Value (GMV)' THEN 'gmv' WHEN 'Late Delivery Rate' THEN 'late_delivery_rate' WHEN 'Average Order Value (AOV)' THEN 'aov' END AS k,
TRY_CAST(replace(context_value, '%', '') AS DOUBLE) AS g FROM y)
SELECT year_number, k AS card_key, CASE k WHEN 'gmv' THEN 'Total GMV' WHEN 'aov' THEN 'AOV' ELSE 'Late Delivery Rate' END AS label, kpi_value AS value,
CASE WHEN k = 'late_delivery_rate' THEN {_pct('kpi_value')} ELSE 'R$ ' || format('{{:,.2f}}', kpi_value) END AS display_value, context_name AS trend_label, coalesce(nullif(context_value, ''), context_meaning) AS trend_value,
{_tone('context_meaning')} AS trend_tone, kpi_meaning AS meaning FROM c WHERE k IS NOT NULL
UNION ALL SELECT year_number, 'yoy', 'YoY Revenue Growth', g, {_pct('g', '+')}, context_name, context_meaning, {_tone('context_meaning')}, 'Year-over-year GMV change' FROM c WHERE k = 'gmv'""", kpis._ALL)
def d01(m):
    """Every card comes from a KPI of the orders, so the items are not read."""
    return dashboards.overview_cards(kpi.overview_view(m.fact_orders(), None, m.dim_date()))


_LATEST = """WITH v AS (SELECT year_number, review_score FROM fact_orders JOIN dim_date ON date_key = purchase_date_key WHERE review_score IS NOT NULL AND order_status NOT IN ('created', 'approved')),
l AS (SELECT avg(review_score) AS avg_review_score, count(*) AS review_count FROM v WHERE year_number = (SELECT max(year_number) FROM v)) """


@query("d02_latest_review", _LATEST + "SELECT * FROM l", "fact_orders dim_date")
def d02(m):
    return dashboards.latest_review_score(m.orders_only(), m.dim_date())


@query("d02_review_card", _LATEST + """SELECT 'review_score' AS card_key, 'Avg Review Score' AS label, avg_review_score AS value, printf('%.2f', avg_review_score) || ' / 5' AS display_value,
'from ' || review_count || ' reviews' AS trend_value, 'neutral' AS trend_tone FROM l""", "fact_orders dim_date")
def d02_card(m):
    return dashboards.review_card(dashboards.latest_review_score(m.orders_only(), m.dim_date()))


@query("d03_daily_trend", """SELECT full_date, strftime(full_date, '%Y-%m-%d') AS date_text, count(order_id) AS total_orders, CAST(sum(total_payment) AS DOUBLE) AS daily_revenue FROM fact_orders JOIN dim_date ON date_key = purchase_date_key
WHERE year_number = 1998 AND order_status NOT IN ('created', 'approved') GROUP BY 1, 2""", "fact_orders dim_date")
def d03(m):
    return dashboards.daily_trend(m.orders_only(), m.dim_date(), 1998)


@query("d04_category_profitability", """SELECT category_name_en AS category, CAST(sum(price) AS DOUBLE) AS total_sales, count(DISTINCT order_id) AS units_sold,
round(CAST(sum(freight_value) AS DOUBLE) / nullif(CAST(sum(price) AS DOUBLE), 0) * 100, 2) AS freight_ratio_pct FROM fact_order_items JOIN dim_products USING (product_id) GROUP BY 1 HAVING sum(price) > 5000""",
       "fact_order_items dim_products")
def d04(m):
    return dashboards.category_profitability(m.fact_order_items(), m.dim_products())


@query("d05_value_density", """SELECT category_name_en, avg(weight_g) AS x, CAST(sum(price) AS DOUBLE) / count(*) AS y, CAST(sum(price) AS DOUBLE) AS size FROM fact_order_items
JOIN (SELECT product_id, weight_g, nullif(category_name_en, 'PROMO') AS category_name_en FROM dim_products) USING (product_id) WHERE category_name_en IS NOT NULL GROUP BY 1""", "fact_order_items dim_products")
def d05(m):
    return dashboards.value_density(m.fact_order_items(), m.dim_products().withColumn("category_name_en", F.nullif("category_name_en", F.lit("PROMO"))))


@query("d06_revenue_by_category", "SELECT category_name_en AS category, CAST(sum(price) AS DOUBLE) AS revenue FROM fact_order_items JOIN dim_products USING (product_id) GROUP BY 1", "fact_order_items dim_products")
def d06(m):
    return dashboards.revenue_by_category(m.fact_order_items(), m.dim_products())


@query("d07_item_revenue_series", """WITH s AS (SELECT full_date AS date, CAST(sum(price) AS DOUBLE) AS revenue, sum(price) AS exact FROM fact_order_items JOIN fact_orders USING (order_id) JOIN dim_date ON date_key = purchase_date_key
WHERE order_status NOT IN ('created', 'approved', 'canceled') GROUP BY 1)
SELECT date, revenue, CASE WHEN row_number() OVER w >= 7 THEN round(CAST(sum(exact) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / 7, 4) END AS moving_avg FROM s WINDOW w AS (ORDER BY date)""",
       "fact_order_items fact_orders dim_date")
def d07(m):
    return dashboards.item_revenue_series(m.fact_order_items(), m.orders_only(), m.dim_date()).withColumn("moving_avg", F.round("moving_avg", 4))


@query("d08_funnel_stages", f"""WITH {kpis._L_FUN}, s AS (SELECT 1 AS stage_no, 'MQL' AS stage, n AS value, n FROM f UNION ALL SELECT 2, 'Sellers Acquired', s, n FROM f UNION ALL SELECT 3, 'Unconverted', u, n FROM f)
SELECT stage_no, stage, value, round(value::DOUBLE / nullif(n, 0) * 100, 2) AS pct_of_first FROM s""", "fact_marketing_funnel")
def d08(m):
    return dashboards.funnel_stages(m.fact_marketing_funnel())


@query("d09_top_origins", "SELECT lead_origin AS state, count(DISTINCT mql_id) AS leads FROM fact_marketing_funnel WHERE lead_origin IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "fact_marketing_funnel")
def d09(m):
    return dashboards.top_origins(m.fact_marketing_funnel())


_POINTS = """p AS (SELECT latitude, longitude, CAST(review_score AS DOUBLE) AS review_score, state AS customer_state FROM fact_orders JOIN dim_customers USING (customer_unique_id)
WHERE review_score IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)"""


@query("d10_customer_points", f"WITH {_POINTS} SELECT * FROM p", "fact_orders dim_customers")
def d10(m):
    return dashboards.customer_points(m.orders_only(), m.dim_customers())


@query("d10_state_rollup", f"""WITH {_POINTS} SELECT customer_state AS state, count(*) AS customer_count, avg(review_score) AS avg_score, min(latitude) AS latitude, arg_min(longitude, latitude * 1000000 + longitude) AS longitude,
greatest(15.0, least(50.0, sqrt(count(*) / 2)))::DOUBLE AS marker_size FROM p GROUP BY 1""", "fact_orders dim_customers")
def d10_rollup(m):
    return dashboards.state_rollup(dashboards.customer_points(m.orders_only(), m.dim_customers()))


@query("d11_review_distribution", "SELECT review_score, count(*) FILTER (NOT is_late_delivery) AS on_time_count, count(*) FILTER (is_late_delivery) AS late_count FROM fact_orders WHERE review_score IS NOT NULL GROUP BY 1", "fact_orders")
def d11(m):
    return dashboards.review_distribution(m.fact_orders())


def _slots(inner: str, slots: dict[str, str], extra: str = "") -> str:
    names = " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in slots.items())
    return f"SELECT * FROM (SELECT {extra}CASE kpi_name {names} END AS slot, kpi_name, kpi_value, context_name, context_value, context_meaning FROM {_inner(inner)}) WHERE slot IS NOT NULL"


@query("d12_sales_slots", _slots(kpis._SALES_SQL, {"Top Revenue Category": "top_category", "Highest Freight Burden": "freight_ratio", "Lowest Customer Satisfaction": "lowest_satisfaction",
                                                   "Top Seller State (Revenue)": "top_seller_state", "Product Revenue Concentration": "concentration"}, "year_number, "), kpis._SALES_ROLES)
def d12_sales(m):
    view = kpi.sales_view(m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_products(), m.dim_sellers())
    return dashboards.page_slots(view, "sales", ["year_number"])


@query("d12_marketing_slots", f"SELECT * FROM (WITH {kpis._L_FUN} " + kpis._set("f", [
    ("Total MQLs", "n", "Source", "'Marketing Qualified Leads'", "Total unique leads generated"), ("Sellers Acquired", "s", "Status", "'Converted'", "Total sellers onboarded from MQL funnel"),
    ("Funnel Conversion Rate", "c", "Metric", "'%'", "Percentage of MQLs converting to sellers"), ("Average Days to Close", "round(d, 1)", "Metric", "'days'", "Mean sales cycle duration"),
    ("Unconverted Leads", "u", "Status", "'In Funnel'", "Leads not yet converted to sellers")]) +
    ") JOIN (VALUES ('Total MQLs', 'total_mqls'), ('Sellers Acquired', 'sellers'), ('Funnel Conversion Rate', 'conversion'), ('Average Days to Close', 'time_close'), ('Unconverted Leads', 'unconverted')) t(kpi_name, slot) USING (kpi_name)",
    "fact_marketing_funnel")
def d12_marketing(m):
    return dashboards.page_slots(legacy.marketing_set(m.fact_marketing_funnel()), "marketing")


@query("d12_customer_slots", _slots(kpis._CUSTOMER_SQL, {"Repeat Customer Rate": "repeat"}, "year_number, "), kpis._CUSTOMER_ROLES)
def d12_customer(m):
    return dashboards.page_slots(kpi.customer_view(m.fact_orders(), m.dim_customers(), m.dim_date()), "customer", ["year_number"])


@query("d13_rfm", """SELECT customer_unique_id, CAST(date_diff('day', strptime(CAST(max(purchase_date_key) AS VARCHAR), '%Y%m%d'), (SELECT strptime(CAST(max(purchase_date_key) AS VARCHAR), '%Y%m%d') FROM fact_orders)) AS INTEGER) AS recency,
count(DISTINCT order_id) AS frequency, CAST(sum(price + freight_value) AS DOUBLE) AS monetary, CAST(trunc(avg(delivery_days_actual)) AS INTEGER) AS avg_delivery_time, count(DISTINCT category_name_en) AS category_diversity
FROM fact_orders JOIN dim_customers USING (customer_unique_id) JOIN fact_order_items USING (order_id) JOIN dim_products USING (product_id) WHERE order_status = 'delivered' GROUP BY 1""",
       "fact_orders fact_order_items dim_products dim_customers")
def d13(m):
    return dashboards.rfm(m.fact_orders(), m.fact_order_items(), m.dim_products(), m.dim_customers())
