"""Year-scoped and all-time KPI queries."""

from __future__ import annotations

from vitrine.catalog.registry import query
from vitrine.plans import kpi, legacy

# ---------------------------------------------------------------- check SQL

_SALE = "order_status NOT IN ('created', 'approved', 'canceled', 'unavailable')"

_YEARS = f"""yr AS (SELECT year_number, CAST(coalesce(sum(total_payment) FILTER ({_SALE}), 0) AS DOUBLE) AS gmv, count(*) FILTER ({_SALE}) AS sales, count(*) FILTER (order_status = 'delivered') AS dn,
count(*) FILTER (order_status = 'delivered' AND is_late_delivery) AS ln, count(*) FILTER (order_status = 'delivered' AND review_score >= 4) AS up, count(*) FILTER (order_status = 'delivered' AND review_score <= 2) AS down,
count(*) FILTER (order_status = 'canceled') AS cn, count(*) AS n, count(DISTINCT customer_unique_id) FILTER (order_status NOT IN ('canceled', 'unavailable')) AS buyers
FROM fact_orders JOIN dim_date ON date_key = purchase_date_key GROUP BY 1),
yy AS (SELECT a.*, CASE WHEN b.gmv > 0 THEN round((a.gmv - b.gmv) / b.gmv * 100, 1) END AS pct, a.gmv / nullif(a.sales, 0) AS aov, b.gmv / nullif(b.sales, 0) AS paov
FROM yr a LEFT JOIN yr b ON b.year_number = a.year_number - 1)"""

_ROW = "year_number, '{name}' AS kpi_name, CAST({value} AS DOUBLE) AS kpi_value, '{meaning}' AS kpi_meaning, '{logic}' AS sql_calculation_logic, '{label}' AS context_name, {detail} AS context_value, {verdict} AS context_meaning"


def _select(source: str, **parts: str) -> str:
    return f"SELECT {_ROW.format(**parts)} FROM {source}"


_NONE = "CAST(NULL AS VARCHAR)"
_SOLD = f"""sold AS (SELECT i.*, year_number, review_score, order_status FROM fact_order_items i JOIN fact_orders USING (order_id) JOIN dim_date ON date_key = purchase_date_key WHERE {_SALE})"""
_SELL = "sy AS (SELECT year_number, count(DISTINCT seller_id) AS sellers, round(CAST(sum(freight_value) AS DOUBLE) / nullif(CAST(sum(total_item_value) AS DOUBLE), 0) * 100, 2) AS fp FROM sold GROUP BY 1)"

# KPI names and labels in the check SQL of the four families below are those that results must carry.
_OVERVIEW = {
    "gmv": _select("yy", name="Gross Merchandise Value (GMV)", value="round(gmv, 2)", meaning="Total transaction value processed", logic="SUM(total_payment)", label="YoY Growth", detail="printf('%.1f', pct) || '%'",
                   verdict="CASE WHEN pct >= 20 THEN 'Strong growth' WHEN pct >= 0 THEN 'Marginal growth' WHEN pct IS NULL THEN 'No prior year comparison' ELSE 'Decline' END"),
    "aov": _select("yy", name="Average Order Value (AOV)", value="round(aov, 2)", meaning="Average order value", logic="SUM/COUNT", label="AOV Change", detail="printf('%.2f', round(aov - paov, 2)) || ' BRL'",
                   verdict="CASE WHEN aov > paov THEN 'AOV increased' WHEN aov < paov THEN 'AOV decreased' ELSE 'Stable AOV' END"),
    "late": _select("yy", name="Late Delivery Rate", value="round(ln::DOUBLE / nullif(dn, 0) * 100, 2)", meaning="Late delivery percentage (Delivered only)", logic="is_late / delivered_orders", label="Customer Impact",
                    detail=_NONE, verdict="CASE WHEN ln::DOUBLE / nullif(dn, 0) * 100 > 10 THEN 'High late rate' ELSE 'Healthy' END"),
    "nps": _select("yy", name="Platform NPS Proxy", value="round((up - down)::DOUBLE / nullif(dn, 0) * 100, 1)", meaning="Customer satisfaction proxy", logic="Promoters - Detractors", label="Sentiment", detail=_NONE,
                   verdict="CASE WHEN (up - down)::DOUBLE / nullif(dn, 0) * 100 >= 30 THEN 'Good' WHEN (up - down)::DOUBLE / nullif(dn, 0) * 100 >= 0 THEN 'Neutral' ELSE 'Negative' END"),
    "cancel": _select("yy", name="Order Cancellation Rate", value="round(cn::DOUBLE / nullif(n, 0) * 100, 2)", meaning="Canceled orders percentage", logic="canceled / all_system_orders", label="Revenue Risk", detail=_NONE,
                      verdict="CASE WHEN cn::DOUBLE / nullif(n, 0) * 100 > 2 THEN 'Moderate cancellation rate' ELSE 'Low cancellation rate' END"),
    "sellers": _select("(SELECT * FROM yy JOIN sy USING (year_number))", name="Active Sellers", value="sellers", meaning="Number of active sellers", logic="COUNT(seller_id)", label="Revenue per Seller",
                       detail="'R$' || printf('%.0f', round(gmv / sellers, 0))", verdict="'Seller base size'"),
    "freight": _select("(SELECT * FROM yy JOIN sy USING (year_number))", name="Freight Cost Ratio", value="fp", meaning="Freight cost % of revenue", logic="freight / total_item_value", label="Logistics efficiency",
                       detail=_NONE, verdict="CASE WHEN fp > 15 THEN 'High freight cost' ELSE 'Healthy freight level' END"),
    "customers": _select("yy", name="Total Unique Customers", value="buyers", meaning="Unique customers per year", logic="COUNT(customer_unique_id)", label="Retention Insight", detail=_NONE, verdict="'Customer base size'"),
}
_ALL = "fact_orders fact_order_items dim_date"


def _overview(which: str) -> str:
    return f"WITH {_YEARS}, {_SOLD}, {_SELL} {_OVERVIEW[which]}"


@query("k01_gmv_yoy", _overview("gmv"), _ALL)
def k01(m):
    return kpi.overview_kpi("gmv", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k02_average_order_value", _overview("aov"), _ALL)
def k02(m):
    return kpi.overview_kpi("aov", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k03_late_rate", _overview("late"), _ALL)
def k03(m):
    return kpi.overview_kpi("late", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k04_nps", _overview("nps"), _ALL)
def k04(m):
    return kpi.overview_kpi("nps", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k05_cancel_rate", _overview("cancel"), _ALL)
def k05(m):
    return kpi.overview_kpi("cancel", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k06_active_sellers", _overview("sellers"), _ALL)
def k06(m):
    return kpi.overview_kpi("sellers", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k07_freight_ratio", _overview("freight"), _ALL)
def k07(m):
    return kpi.overview_kpi("freight", m.fact_orders(), m.fact_order_items(), m.dim_date())


@query("k08_unique_customers", _overview("customers"), _ALL)
def k08(m):
    return kpi.overview_kpi("customers", m.fact_orders(), m.fact_order_items(), m.dim_date())


_OVERVIEW_SQL = f"WITH {_YEARS}, {_SOLD}, {_SELL} " + " UNION ALL ".join(_OVERVIEW.values())


@query("k00_overview_view", _OVERVIEW_SQL, _ALL)
def k00(m):
    return kpi.overview_view(m.fact_orders(), m.fact_order_items(), m.dim_date())


# ---------------------------------------------------------------- sales

_CATS = """cat AS (SELECT year_number, category_name_en AS c, CAST(sum(price) AS DOUBLE) AS rev, round(CAST(sum(freight_value) AS DOUBLE) / nullif(CAST(sum(total_item_value) AS DOUBLE), 0) * 100, 2) AS fp,
avg(CASE WHEN order_status = 'delivered' THEN review_score END) AS score FROM sold JOIN dim_products USING (product_id) GROUP BY 1, 2)"""

_SALES = {
    "top": _select("(SELECT * FROM cat QUALIFY rank() OVER (PARTITION BY year_number ORDER BY rev DESC) = 1)", name="Top Revenue Category", value="rev", meaning="#1 revenue-generating category", logic="SUM(price)",
                   label="Category Name", detail="c", verdict="'Main revenue driver'"),
    "growth": _select("(SELECT a.*, round((a.rev - b.rev) / b.rev * 100, 1) AS pct FROM cat a JOIN cat b ON b.c = a.c AND b.year_number = a.year_number - 1 WHERE b.rev > 50000 QUALIFY row_number() OVER (PARTITION BY a.year_number ORDER BY round((a.rev - b.rev) / b.rev * 100, 1) DESC, a.c) = 1)",
                      name="Fastest-Growing Category (YoY)", value="rev", meaning="Highest revenue growth", logic="YoY Formula", label="Growth Rate", detail="printf('%.1f', pct) || '%'", verdict="c || ' trending upward'"),
    "freight": _select("(SELECT * FROM cat QUALIFY rank() OVER (PARTITION BY year_number ORDER BY fp DESC) = 1)", name="Highest Freight Burden", value="fp", meaning="Logistics cost share", logic="SUM(freight) / SUM(total_value)",
                       label="Freight %", detail="printf('%.2f', fp) || '%'", verdict="c || ' margin risk'"),
    "lowest": _select("(SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY coalesce(score, 5), c) = 1)", name="Lowest Customer Satisfaction", value="score", meaning="Category with poor feedback",
                      logic="AVG(review)", label="Avg Score", detail="c || ' | ' || printf('%.2f', round(score, 2))", verdict="'Poor satisfaction risk'"),
    "state": _select("(SELECT year_number, state, CAST(sum(total_item_value) AS DOUBLE) AS rev, count(DISTINCT seller_id) AS sellers FROM sold JOIN dim_sellers USING (seller_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY sum(total_item_value) DESC, state) = 1)",
                     name="Top Seller State (Revenue)", value="rev", meaning="Highest seller output", logic="SUM(revenue)", label="State + Sellers", detail="state || ' | ' || sellers || ' sellers'", verdict="'Primary supply hub'"),
    "pareto": _select("""(SELECT year_number, count(*) AS top, round(CAST(sum(rev) AS DOUBLE) / CAST(max(total) AS DOUBLE) * 100, 1) AS covered FROM (SELECT year_number, product_id, sum(price) AS rev, sum(sum(price)) OVER (PARTITION BY year_number) AS total,
row_number() OVER (PARTITION BY year_number ORDER BY sum(price) DESC, product_id) AS rn, count(*) OVER (PARTITION BY year_number) AS products FROM sold GROUP BY 1, 2) WHERE rn <= floor(products * 0.2) GROUP BY 1)""",
                      name="Product Revenue Concentration", value="covered", meaning="% of revenue from top 20% products", logic="Pareto 80/20", label="Top 20% Count", detail="top || ' products'", verdict="'Heavy dependence on core products'"),
}
_SALES_ROLES = "fact_orders fact_order_items dim_date dim_products dim_sellers"


def _sales(which: str) -> str:
    return f"WITH {_SOLD}, {_CATS} {_SALES[which]}"


def _stats(m):
    return kpi.category_by_year(m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_products())


@query("k09_top_category", _sales("top"), _SALES_ROLES)
def k09(m):
    return kpi.top_revenue_category(_stats(m))


@query("k10_fastest_growing_category", _sales("growth"), _SALES_ROLES)
def k10(m):
    return kpi.fastest_growing_category(_stats(m))


@query("k11_highest_freight_category", _sales("freight"), _SALES_ROLES)
def k11(m):
    return kpi.highest_freight_category(_stats(m))


@query("k12_lowest_rated_category", _sales("lowest"), _SALES_ROLES)
def k12(m):
    return kpi.lowest_rated_category(_stats(m))


@query("k13_top_seller_state", _sales("state"), _SALES_ROLES)
def k13(m):
    return kpi.top_seller_state(m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_sellers())


@query("k14_product_concentration", _sales("pareto"), _SALES_ROLES)
def k14(m):
    return kpi.product_concentration(m.fact_order_items(), m.orders_only(), m.dim_date())


_SALES_SQL = f"WITH {_SOLD}, {_CATS} " + " UNION ALL ".join(_SALES.values())


@query("k00_sales_view", _SALES_SQL, _SALES_ROLES)
def k00_sales(m):
    return kpi.sales_view(m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_products(), m.dim_sellers())


# ---------------------------------------------------------------- marketing

_FUNNEL = """fun AS (SELECT f.*, year_number FROM fact_marketing_funnel f JOIN dim_date ON date_key = first_contact_date_key)"""
_RATES = "count(*) AS leads, count(*) FILTER (is_converted) AS deals, round(count(*) FILTER (is_converted)::DOUBLE / count(*) * 100, 2) AS conv, round(avg(days_to_close) FILTER (is_converted), 1) AS days"
_CHANNELS = f"(SELECT year_number, lead_origin, {_RATES} FROM fun GROUP BY 1, 2 HAVING count(*) >= 10)"

_MARKETING = {
    "conversion": _select(f"(SELECT year_number, {_RATES} FROM fun GROUP BY 1)", name="Seller Acquisition Conversion Rate", value="conv", meaning="MQLs to active sellers", logic="SUM/COUNT", label="Total Pipeline",
                          detail="leads || ' MQLs'", verdict="'Funnel health'"),
    "channel": _select(f"(SELECT * FROM {_CHANNELS} QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY conv DESC, lead_origin) = 1)", name="Best-Converting Acquisition Channel", value="conv",
                       meaning="Highest MQL-to-seller", logic="SUM/COUNT", label="Channel + Volume", detail="lead_origin || ' | ' || leads || ' leads'", verdict="'Top channel performance'"),
    "fastest": _select(f"(SELECT * FROM {_CHANNELS} QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY days NULLS FIRST, lead_origin) = 1)", name="Fastest-Closing Acquisition Channel", value="days",
                       meaning="Shortest time to active", logic="AVG(days)", label="Channel + Speed", detail="lead_origin || ' | Avg ' || printf('%.1f', days) || ' days'", verdict="'Sales cycle speed'"),
    "revenue": _select("(SELECT a.year_number, a.v FROM ms a JOIN ms b USING (year_number) WHERE a.came_from_marketing AND NOT b.came_from_marketing)", name="Marketing-Sourced Seller Revenue", value="v",
                       meaning="Revenue from marketing", logic="SUM(revenue)", label="vs Organic Sellers", detail="'Mktg: R$' || printf('%.0f', round(v, 0))", verdict="'Marketing ROI'"),
    "cycle": _select(f"(SELECT year_number, {_RATES} FROM fun GROUP BY 1)", name="Average Sales Cycle Length", value="days", meaning="First contact to activation", logic="AVG(days)", label="Cycle Length",
                     detail="printf('%.1f', days) || ' days'", verdict="'SDR capacity indicator'"),
    "rep": _select(f"(SELECT year_number, sdr_id, {_RATES} FROM fun WHERE sdr_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY conv DESC, sdr_id) = 1)",
                   name="Top SDR Conversion Rate", value="conv", meaning="Highest SDR conversion", logic="SUM/COUNT", label="SDR ID + Deals", detail="'SDR: ' || sdr_id || ' | ' || deals || ' deals'", verdict="'Team playbook'"),
}
_MS = "ms AS (SELECT year_number, came_from_marketing, CAST(sum(total_item_value) AS DOUBLE) AS v FROM sold JOIN dim_sellers USING (seller_id) GROUP BY 1, 2)"
_MARKETING_ROLES = "fact_marketing_funnel fact_orders fact_order_items dim_date dim_sellers"


def _marketing(which: str) -> str:
    return f"WITH {_FUNNEL}, {_SOLD}, {_MS} {_MARKETING[which]}"


@query("k15_conversion_rate", _marketing("conversion"), _MARKETING_ROLES)
def k15(m):
    return kpi.conversion_rate(m.fact_marketing_funnel(), m.dim_date())


@query("k16_best_channel", _marketing("channel"), _MARKETING_ROLES)
def k16(m):
    return kpi.best_channel(m.fact_marketing_funnel(), m.dim_date())


@query("k17_fastest_channel", _marketing("fastest"), _MARKETING_ROLES)
def k17(m):
    return kpi.fastest_channel(m.fact_marketing_funnel(), m.dim_date())


@query("k18_marketing_revenue", _marketing("revenue"), _MARKETING_ROLES)
def k18(m):
    return kpi.marketing_revenue(m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_sellers())


@query("k19_sales_cycle", _marketing("cycle"), _MARKETING_ROLES)
def k19(m):
    return kpi.sales_cycle(m.fact_marketing_funnel(), m.dim_date())


@query("k20_top_rep", _marketing("rep"), _MARKETING_ROLES)
def k20(m):
    return kpi.top_rep(m.fact_marketing_funnel(), m.dim_date())


_MARKETING_SQL = f"WITH {_FUNNEL}, {_SOLD}, {_MS} " + " UNION ALL ".join(_MARKETING.values())


@query("k00_marketing_view", _MARKETING_SQL, _MARKETING_ROLES)
def k00_marketing(m):
    return kpi.marketing_view(m.fact_marketing_funnel(), m.fact_order_items(), m.orders_only(), m.dim_date(), m.dim_sellers())


# ---------------------------------------------------------------- customers

_HISTORY = """his AS (SELECT year_number, customer_unique_id, max(state) AS state, count(*) AS orders, sum(total_payment) AS spend, count(*) FILTER (is_late_delivery) AS late
FROM fact_orders JOIN dim_customers USING (customer_unique_id) JOIN dim_date ON date_key = purchase_date_key WHERE order_status = 'delivered' GROUP BY 1, 2)"""
_BUYERS = "(SELECT year_number, count(*) AS n, count(*) FILTER (orders = 1) AS one, count(*) FILTER (orders >= 2) AS more, CAST(sum(spend) AS DOUBLE) / count(spend) AS mean FROM his GROUP BY 1)"
_STATES = "(SELECT year_number, state, count(*) AS n, CAST(sum(late) AS DOUBLE) / nullif(sum(orders), 0) * 100 AS lr FROM his GROUP BY 1, 2 HAVING count(*) >= {least})"

_CUSTOMER = {
    "repeat": _select(_BUYERS, name="Repeat Customer Rate", value="round(more::DOUBLE / nullif(n, 0) * 100, 2)", meaning="% of customers with >1 order in year", logic="(Repeat Buyers / Total) * 100", label="Comparison (1 vs >1)",
                      detail="more || ' Repeat vs ' || one || ' Single'", verdict="'Retention indicator'"),
    "value": _select(_BUYERS, name="Average Customer Value (Yearly)", value="round(mean, 2)", meaning="Average revenue per customer per year", logic="SUM/COUNT", label="Value Insight",
                     detail="'Avg Value: R$' || printf('%.2f', round(mean, 2))", verdict="'Yearly spend analysis'"),
    "market": _select("(SELECT * FROM " + _STATES + " QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY n DESC, state) = 1)", name="Largest Customer Market", value="n", meaning="Highest number of customers",
                      logic="COUNT(customers)", label="State", detail="state || ' | ' || n || ' customers'", verdict="'Market size'"),
    "worst": _select("(SELECT * FROM " + _STATES + " QUALIFY row_number() OVER (PARTITION BY year_number ORDER BY lr DESC, state) = 1)", name="Worst Customer Experience State", value="round(lr, 1)",
                     meaning="Highest late delivery rate", logic="SUM(late)/COUNT(orders)", label="State + Late Rate", detail="state || ' | ' || printf('%.1f', round(lr, 1)) || '% late'", verdict="'Logistics improvement needed'"),
    "quartile": _select("""(SELECT year_number, count(*) FILTER (t = 4) AS n, round(CAST(sum(spend) FILTER (t = 4) AS DOUBLE) / CAST(sum(spend) AS DOUBLE) * 100, 1) AS share FROM
(SELECT year_number, spend, ntile(4) OVER (PARTITION BY year_number ORDER BY spend NULLS FIRST, customer_unique_id) AS t FROM his) GROUP BY 1 HAVING count(*) FILTER (t = 4) > 0)""",
                        name="Top 25% Customer Contribution", value="share", meaning="Revenue % from top 25%", logic="NTILE(4) Revenue", label="Top Quartile", detail="n || ' customers'", verdict="'VIP revenue impact'"),
}
_CUSTOMER_ROLES = "fact_orders dim_customers dim_date"


def _customer(which: str) -> str:
    return f"WITH {_HISTORY} {_CUSTOMER[which].replace('{least}', '20')}"


def _history(m):
    return kpi.customer_years(m.fact_orders(), m.dim_customers(), m.dim_date())


@query("k21_repeat_rate", _customer("repeat"), _CUSTOMER_ROLES)
def k21(m):
    return kpi.repeat_rate(_history(m))


@query("k22_customer_value", _customer("value"), _CUSTOMER_ROLES)
def k22(m):
    return kpi.customer_value(_history(m))


@query("k23_largest_market", _customer("market"), _CUSTOMER_ROLES)
def k23(m):
    return kpi.largest_market(_history(m))


@query("k24_worst_state", _customer("worst"), _CUSTOMER_ROLES)
def k24(m):
    return kpi.worst_state(_history(m))


@query("k25_top_quartile", _customer("quartile"), _CUSTOMER_ROLES)
def k25(m):
    return kpi.top_quartile(_history(m))


_CUSTOMER_SQL = f"WITH {_HISTORY} " + " UNION ALL ".join(c.replace("{least}", "20") for c in _CUSTOMER.values())


@query("k00_customer_view", _CUSTOMER_SQL, _CUSTOMER_ROLES)
def k00_customer(m):
    return kpi.customer_view(m.fact_orders(), m.dim_customers(), m.dim_date())


# ---------------------------------------------------------------- all-time sets


def _set(source: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS kpi_name, CAST({v} AS DOUBLE) AS kpi_value, '{l}' AS context_name, {d} AS context_value, '{w}' AS context_meaning FROM {source}" for n, v, l, d, w in rows)


_L_SALES = """WITH o AS (SELECT count(DISTINCT product_id) AS p, CAST(sum(price) AS DOUBLE) AS r, CAST(sum(freight_value) AS DOUBLE) AS f, count(price) AS n FROM fact_order_items),
t AS (SELECT category_name_en AS c, CAST(sum(price) AS DOUBLE) AS r FROM fact_order_items JOIN dim_products USING (product_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) """ + _set("t", [
    ("Top Category", "r", "Category", "c", "The product category with the highest total revenue")]) + " UNION ALL " + _set("o", [
        ("Total Products in Catalog", "p", "Description", "'Active SKUs'", "Unique product variants available for sale"),
        ("Freight Cost Ratio", "round(f / nullif(r, 0) * 100, 2)", "Metric", "'%'", "Shipping cost as % of product revenue"),
        ("Average Order Value", "round(r / n, 2)", "Currency", "'BRL'", "Mean transaction value per line item"), ("Total Revenue", "round(r, 2)", "Period", "'All Time'", "Aggregate gross merchandise value")])


@query("l01_l05_sales_set", _L_SALES, "fact_order_items dim_products")
def l01(m):
    return legacy.sales_set(m.fact_order_items(), m.dim_products())


_L_FUN = """f AS (SELECT count(DISTINCT mql_id) AS n, count(DISTINCT seller_id) FILTER (is_converted) AS s, count(DISTINCT mql_id) FILTER (NOT is_converted) AS u, avg(days_to_close) AS d,
round(count(DISTINCT seller_id) FILTER (is_converted)::DOUBLE / nullif(count(DISTINCT mql_id), 0) * 100, 2) AS c FROM fact_marketing_funnel)"""


@query("l06_l10_marketing_set", f"WITH {_L_FUN} " + _set("f", [
    ("Total MQLs", "n", "Source", "'Marketing Qualified Leads'", "Total unique leads generated"), ("Sellers Acquired", "s", "Status", "'Converted'", "Total sellers onboarded from MQL funnel"),
    ("Funnel Conversion Rate", "c", "Metric", "'%'", "Percentage of MQLs converting to sellers"), ("Average Days to Close", "round(d, 1)", "Metric", "'days'", "Mean sales cycle duration"),
    ("Unconverted Leads", "u", "Status", "'In Funnel'", "Leads not yet converted to sellers")]), "fact_marketing_funnel")
def l06(m):
    return legacy.marketing_set(m.fact_marketing_funnel())


_WIDE = "SELECT '{}' AS kpi_name, CAST({} AS DOUBLE) AS kpi_value, '{}' AS kpi_meaning, '{}' AS sql_calculation_logic, '{}' AS context_name, {} AS context_value, {} AS context_meaning FROM f"


@query("l06_l10_marketing_set_banded", f"WITH {_L_FUN} " + " UNION ALL ".join(_WIDE.format(*r) for r in [
    ("Total MQLs", "n", "Total number of marketing qualified leads", "COUNT(DISTINCT mql_id)", "Leads", "CAST(n AS VARCHAR)", "'MQLs represent the top of the marketing funnel - initial qualified prospects.'"),
    ("Funnel Conversion Rate", "c", "Percentage of MQLs that convert to sellers", "COUNT(converted) / COUNT(total) * 100", "Conversion %", "printf('%.2f', c)",
     "CASE WHEN c > 10 THEN 'Strong conversion efficiency - funnel is healthy.' WHEN c > 5 THEN 'Moderate conversion - standard industry range.' ELSE 'Low conversion rate - investigate bottlenecks in sales process.' END"),
    ("Average Days to Close", "d", "Average sales cycle duration in days", "AVG(days_to_close)", "Days", "CAST(CAST(trunc(d) AS BIGINT) AS VARCHAR)", "'Shorter cycles improve cash flow. Monitor for process improvements.'"),
    ("Sellers Acquired", "s", "Number of seller accounts successfully onboarded", "COUNT(DISTINCT seller_id WHERE is_converted = 1)", "Active Sellers", "CAST(s AS VARCHAR)",
     "'These sellers are active platform participants. Growth target: expand at 10-15% QoQ.'"),
    ("Unconverted Leads", "u", "Number of MQLs that did not convert to sellers", "COUNT(DISTINCT mql_id WHERE is_converted = 0)", "Leads at Risk", "CAST(u AS VARCHAR)",
     "'Analyze these leads to identify conversion barriers - product-market fit, pricing, or nurture gaps.'")]), "fact_marketing_funnel")
def l06_banded(m):
    return legacy.marketing_set_banded(m.fact_marketing_funnel())


@query("l11_l15_customer_set", """WITH c AS (SELECT customer_unique_id, count(*) AS k FROM fact_orders GROUP BY 1), a AS (SELECT count(*) AS n, round(count(*) FILTER (k > 1)::DOUBLE / nullif(count(*), 0) * 100, 2) AS r FROM c),
s AS (SELECT round(avg(review_score), 2) AS m, round(avg(review_score) FILTER (NOT is_late_delivery), 2) AS t, round(avg(review_score) FILTER (is_late_delivery), 2) AS l FROM fact_orders) """ + _set("a", [
    ("Total Unique Customers", "n", "Description", "'All Time'", "Cumulative unique customer accounts"), ("Repeat Customer Rate", "r", "Metric", "'%'", "Customers with multiple orders")]) + " UNION ALL " + _set("s", [
        ("Average Review Score", "m", "Scale", "'1-5'", "Mean customer satisfaction rating"), ("On-Time Delivery Avg Rating", "t", "Condition", "'On-Time'", "Average review score for on-time deliveries"),
        ("Late Delivery Avg Rating", "l", "Condition", "'Late'", "Average review score for late deliveries")]), "fact_orders")
def l11(m):
    return legacy.customer_set(m.fact_orders())
