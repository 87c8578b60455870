"""Year-scoped business KPIs as long-format rows.

Each family is one aggregate over the facts; its KPIs are then unfolded from that
single result, so a family reads the facts once however many rows it emits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import numbers, rules
from vitrine.operators.keyed import first_per_key, leaders
from vitrine.operators.ordered import tile_of
from vitrine.operators.placed import numbered


def _row(name: str, value: Column, meaning: str, logic: str, label: str, detail: Column | None, verdict: Column | str) -> Column:
    return F.struct(
        F.lit(name).alias("kpi_name"),
        value.cast("double").alias("kpi_value"),
        F.lit(meaning).alias("kpi_meaning"),
        F.lit(logic).alias("sql_calculation_logic"),
        F.lit(label).alias("context_name"),
        (F.lit(None).cast("string") if detail is None else detail).alias("context_value"),
        (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("context_meaning"),
    )


def _unfold(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return df.select("year_number", F.inline(F.array(*rows)))


def _year(fact: DataFrame, dim_date: DataFrame, key: str) -> DataFrame:
    """Attach the year; the calendar is a few thousand rows whatever the size of the facts."""
    days = dim_date.select(F.col("date_key").alias(key), "year_number")
    return fact.join(F.broadcast(days), key)


def _prior(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``prior_*`` columns of the year before; NULL keys have no prior year.

    One row per year and key is left here, so a range frame of exactly one year back costs
    a small sort and the aggregate below is computed once, not again for a self join.
    """
    back = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("year_number").rangeBetween(-1, -1)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    return df.withColumns({f"prior_{c}": F.when(known, F.max(c).over(back)) for c in columns})


def _place(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("year_number").orderBy(*order))


def _rank(order: Column) -> Column:
    return F.rank().over(Window.partitionBy("year_number").orderBy(order))


def _unfold_where(df: DataFrame, rows: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One output row per KPI whose condition the input row meets."""
    kept = F.filter(F.array(*[F.when(condition, row) for condition, row in rows]), lambda r: r.isNotNull())
    return df.select("year_number", F.inline(kept))


# ---------------------------------------------------------------- overview

def overview_by_year(fact_orders: DataFrame, dim_date: DataFrame, excluded: Sequence[str] = rules.NOT_A_SALE) -> DataFrame:
    """Order counts and sums per year, all of them from one pass.

    Orders are first merged per (year, customer): the distinct count then is a plain
    count of customers and the sums are carried along.
    """
    status, score = F.col("order_status"), F.col("review_score")
    sale, delivered = rules.is_sale(status, excluded), status == "delivered"
    per_customer = _year(fact_orders, dim_date, "purchase_date_key").groupBy("year_number", "customer_unique_id").agg(
        F.sum(F.when(sale, F.col("total_payment"))).alias("paid"),
        F.count_if(sale).alias("sales"),
        F.count_if(delivered & F.col("is_late_delivery")).alias("late"),
        F.count_if(delivered).alias("delivered"),
        F.count_if(delivered & (score >= 4)).alias("promoters"),
        F.count_if(delivered & (score <= 2)).alias("detractors"),
        F.count_if(status == "canceled").alias("canceled"),
        F.count(F.lit(1)).alias("orders"),
        F.max((~status.isin(*rules.NOT_A_CUSTOMER)).cast("int")).alias("counts"),
    )
    year = per_customer.groupBy("year_number").agg(
        F.coalesce(F.sum("paid"), F.lit(0)).alias("gmv"),
        *[F.sum(c).alias(c) for c in ("sales", "late", "delivered", "promoters", "detractors", "canceled", "orders")],
        F.count_if((F.col("counts") == 1) & F.col("customer_unique_id").isNotNull()).alias("customers"),
    )
    rated = year.select(
        "year_number", "gmv", "customers",
        numbers.ratio(F.col("gmv"), F.col("sales")).alias("aov"),
        numbers.percent(F.col("late"), F.col("delivered")).alias("late_rate"),
        numbers.percent(F.col("promoters") - F.col("detractors"), F.col("delivered")).alias("nps"),
        numbers.percent(F.col("canceled"), F.col("orders")).alias("cancel_rate"),
    )
    growth = F.when(F.col("prior_gmv") > 0, F.round((F.col("gmv") - F.col("prior_gmv")).cast("double") / F.col("prior_gmv").cast("double") * 100, 1))
    return _prior(rated, ["gmv", "aov"]).withColumn("gmv_growth", growth)


def sold_items(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, keys: Sequence[str],
               excluded: Sequence[str] = rules.NOT_A_SALE, carry: Sequence[str] = ()) -> DataFrame:
    """Items of orders that count as sales, with the year and ``carry`` of the order.

    Orders are unique on the join key, so an order with very many items is split across
    tasks by the adaptive skew join; callers aggregate straight after it, map-side first.
    """
    sold = _year(fact_orders.filter(rules.is_sale(F.col("order_status"), excluded)), dim_date, "purchase_date_key")
    slim = items.select("order_id", *keys, "price", F.col("freight_value").alias("freight"), F.col("total_item_value").alias("total"))
    return slim.join(sold.select("order_id", "year_number", *carry), "order_id")


def sellers_by_year(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, excluded: Sequence[str] = rules.NOT_A_SALE) -> DataFrame:
    """Active sellers and freight share per year."""
    sold = sold_items(items, fact_orders, dim_date, ["seller_id"], excluded)
    per_seller = sold.groupBy("year_number", "seller_id").agg(F.sum("freight").alias("freight"), F.sum("total").alias("total"))
    return per_seller.groupBy("year_number").agg(
        F.count("seller_id").alias("active_sellers"),
        numbers.percent(F.sum("freight"), F.sum("total"), 2).alias("freight_pct"))


# Fixed values below: KPI names, explanations and bands, as dashboards expect them.

def _gmv_row() -> Column:
    pct = F.col("gmv_growth")
    return _row("Gross Merchandise Value (GMV)", F.round(F.col("gmv"), 2), "Total transaction value processed", "SUM(total_payment)", "YoY Growth",
                F.concat(numbers.fixed(pct, 1), F.lit("%")),
                F.when(pct >= 20, "Strong growth").when(pct >= 0, "Marginal growth").when(pct.isNull(), "No prior year comparison").otherwise("Decline"))


def _aov_row() -> Column:
    now, then = F.col("aov"), F.col("prior_aov")
    return _row("Average Order Value (AOV)", F.round(now, 2), "Average order value", "SUM/COUNT", "AOV Change",
                F.concat(numbers.fixed(F.round(now - then, 2), 2), F.lit(" BRL")),
                F.when(now > then, "AOV increased").when(now < then, "AOV decreased").otherwise("Stable AOV"))


def _late_row() -> Column:
    return _row("Late Delivery Rate", F.round("late_rate", 2), "Late delivery percentage (Delivered only)", "is_late / delivered_orders", "Customer Impact",
                None, F.when(F.col("late_rate") > 10, "High late rate").otherwise("Healthy"))


def _nps_row() -> Column:
    return _row("Platform NPS Proxy", F.round("nps", 1), "Customer satisfaction proxy", "Promoters - Detractors", "Sentiment", None,
                F.when(F.col("nps") >= 30, "Good").when(F.col("nps") >= 0, "Neutral").otherwise("Negative"))


def _cancel_row() -> Column:
    return _row("Order Cancellation Rate", F.round("cancel_rate", 2), "Canceled orders percentage", "canceled / all_system_orders", "Revenue Risk", None,
                F.when(F.col("cancel_rate") > 2, "Moderate cancellation rate").otherwise("Low cancellation rate"))


def _sellers_row() -> Column:
    return _row("Active Sellers", F.col("active_sellers"), "Number of active sellers", "COUNT(seller_id)", "Revenue per Seller",
                F.concat(F.lit("R$"), numbers.fixed(F.round(numbers.ratio(F.col("gmv"), F.col("active_sellers")), 0), 0)), "Seller base size")


def _freight_row() -> Column:
    return _row("Freight Cost Ratio", F.col("freight_pct"), "Freight cost % of revenue", "freight / total_item_value", "Logistics efficiency", None,
                F.when(F.col("freight_pct") > 15, "High freight cost").otherwise("Healthy freight level"))


def _customers_row() -> Column:
    return _row("Total Unique Customers", F.col("customers"), "Unique customers per year", "COUNT(customer_unique_id)", "Retention Insight", None, "Customer base size")


_ORDER_ROWS = {"gmv": _gmv_row, "aov": _aov_row, "late": _late_row, "nps": _nps_row, "cancel": _cancel_row, "customers": _customers_row}
_SELLER_ROWS = {"sellers": _sellers_row, "freight": _freight_row}


def overview_kpi(which: str, fact_orders: DataFrame, items: DataFrame, dim_date: DataFrame) -> DataFrame:
    """One KPI of the overview family; columns it does not need are never computed."""
    if which in _ORDER_ROWS:
        return _unfold(overview_by_year(fact_orders, dim_date), [_ORDER_ROWS[which]()])
    sellers = sellers_by_year(items, fact_orders, dim_date)
    years = overview_by_year(fact_orders, dim_date)
    return _unfold(years.join(sellers, "year_number"), [_SELLER_ROWS[which]()])


def overview_view(fact_orders: DataFrame, items: DataFrame | None, dim_date: DataFrame) -> DataFrame:
    """All eight overview KPIs from one aggregate of the orders and one of the items; without ``items`` the six that orders tell alone."""
    years = overview_by_year(fact_orders, dim_date)
    rows = F.array(*[make() for make in _ORDER_ROWS.values()])
    if items is None:
        return years.select("year_number", F.inline(rows))
    years = years.join(sellers_by_year(items, fact_orders, dim_date), "year_number", "left")
    seller_rows = F.when(F.col("active_sellers").isNotNull(), F.array(*[make() for make in _SELLER_ROWS.values()]))
    none = F.slice(rows, 1, 0)
    return years.select("year_number", F.inline(F.concat(rows, F.coalesce(seller_rows, none))))


# ---------------------------------------------------------------- sales

def category_by_year(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, dim_products: DataFrame,
                     excluded: Sequence[str] = rules.NOT_A_SALE) -> DataFrame:
    """Revenue, freight share and mean review of each category and year."""
    sold = sold_items(items, fact_orders, dim_date, ["product_id"], excluded, ["review_score", "order_status"])
    rated = (F.col("order_status") == "delivered") & F.col("review_score").isNotNull()
    per_product = sold.groupBy("year_number", "product_id").agg(
        F.sum("price").alias("revenue"), F.sum("freight").alias("freight"), F.sum("total").alias("total"),
        F.sum(F.when(rated, F.col("review_score"))).alias("score_sum"), F.count_if(rated).alias("score_n"))
    named = per_product.join(dim_products.select("product_id", F.col("category_name_en").alias("category")), "product_id")
    return named.groupBy("year_number", "category").agg(
        F.sum("revenue").alias("revenue"),
        numbers.percent(F.sum("freight"), F.sum("total"), 2).alias("freight_pct"),
        numbers.ratio(F.sum("score_sum"), F.sum("score_n")).alias("avg_review"))


def _top_row() -> Column:
    return _row("Top Revenue Category", F.col("revenue"), "#1 revenue-generating category", "SUM(price)", "Category Name", F.col("category"), "Main revenue driver")


def _growth_row() -> Column:
    return _row("Fastest-Growing Category (YoY)", F.col("revenue"), "Highest revenue growth", "YoY Formula", "Growth Rate",
                F.concat(numbers.fixed(F.col("growth"), 1), F.lit("%")), F.concat(F.col("category"), F.lit(" trending upward")))


def _burden_row() -> Column:
    return _row("Highest Freight Burden", F.col("freight_pct"), "Logistics cost share", "SUM(freight) / SUM(total_value)", "Freight %",
                F.concat(numbers.fixed(F.col("freight_pct"), 2), F.lit("%")), F.concat(F.col("category"), F.lit(" margin risk")))


def _lowest_row() -> Column:
    return _row("Lowest Customer Satisfaction", F.col("avg_review"), "Category with poor feedback", "AVG(review)", "Avg Score",
                F.concat(F.col("category"), F.lit(" | "), numbers.fixed(F.round("avg_review", 2), 2)), "Poor satisfaction risk")


def _grown(stats: DataFrame, floor: float) -> DataFrame:
    """Growth of categories whose revenue the year before exceeded the floor, else NULL."""
    before = F.col("prior_revenue")
    pct = F.round((F.col("revenue") - before).cast("double") / before.cast("double") * 100, 1)
    return _prior(stats, ["revenue"], ["category"]).withColumn("growth", F.when(before > floor, pct))


_BY_SCORE = lambda: (F.coalesce("avg_review", F.lit(5.0)), F.col("category"))


def top_revenue_category(stats: DataFrame) -> DataFrame:
    return _unfold(leaders(stats, ["year_number"], [F.col("revenue").desc()]), [_top_row()])


def fastest_growing_category(stats: DataFrame, floor: float = 50000) -> DataFrame:
    grown = _grown(stats.select("year_number", "category", "revenue"), floor).filter("growth is not null")
    return _unfold(first_per_key(grown, ["year_number"], [F.col("growth").desc(), F.col("category")]), [_growth_row()])


def highest_freight_category(stats: DataFrame) -> DataFrame:
    return _unfold(leaders(stats, ["year_number"], [F.col("freight_pct").desc()]), [_burden_row()])


def lowest_rated_category(stats: DataFrame) -> DataFrame:
    """Unrated categories count as 5, so they win only where nothing scores lower."""
    return _unfold(first_per_key(stats, ["year_number"], list(_BY_SCORE())), [_lowest_row()])


def category_view(stats: DataFrame, floor: float = 50000) -> DataFrame:
    """The four category KPIs from one pass: ``stats`` has one row per (year, category)."""
    ranked = _grown(stats, floor).withColumns({
        "_top": _rank(F.col("revenue").desc()), "_burden": _rank(F.col("freight_pct").desc()), "_lowest": _place(*_BY_SCORE()),
        "_fastest": _place(F.col("growth").desc_nulls_last(), F.col("category"))})
    return _unfold_where(ranked, [(F.col("_top") == 1, _top_row()), ((F.col("_fastest") == 1) & F.col("growth").isNotNull(), _growth_row()),
                                  (F.col("_burden") == 1, _burden_row()), (F.col("_lowest") == 1, _lowest_row())])


def top_seller_state(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    sold = sold_items(items, fact_orders, dim_date, ["seller_id"])
    per_seller = sold.groupBy("year_number", "seller_id").agg(F.sum("total").alias("total"))
    per_state = per_seller.join(dim_sellers.select("seller_id", "state"), "seller_id").groupBy("year_number", "state").agg(
        F.sum("total").alias("revenue"), F.count(F.lit(1)).alias("sellers"))
    best = first_per_key(per_state, ["year_number"], [F.col("revenue").desc(), F.col("state")])
    return _unfold(best, [_row("Top Seller State (Revenue)", F.col("revenue"), "Highest seller output", "SUM(revenue)", "State + Sellers",
                               F.concat(F.col("state"), F.lit(" | "), numbers.whole(F.col("sellers")), F.lit(" sellers")), "Primary supply hub")])


def product_concentration(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, share: float = 0.2) -> DataFrame:
    """Revenue share of the best-selling fifth of the products of each year.

    Products are numbered by revenue with the distributed numbering, so no year has to
    fit into one task.
    """
    sold = sold_items(items, fact_orders, dim_date, ["product_id"])
    per_product = sold.groupBy("year_number", "product_id").agg(F.sum("price").alias("revenue"))
    placed = numbered(per_product, [("revenue", "desc"), "product_id"], ["year_number"], "place", "products")
    kept = F.col("place") <= F.floor(F.col("products") * F.lit(share))
    covered = placed.groupBy("year_number").agg(
        F.count_if(kept).alias("top"), F.sum(F.when(kept, F.col("revenue"))).alias("top_revenue"), F.sum("revenue").alias("all_revenue")
    ).filter("top > 0").withColumn("covered", numbers.percent(F.col("top_revenue"), F.col("all_revenue"), 1))
    return _unfold(covered, [_row("Product Revenue Concentration", F.col("covered"), "% of revenue from top 20% products", "Pareto 80/20", "Top 20% Count",
                                  F.concat(numbers.whole(F.col("top")), F.lit(" products")), "Heavy dependence on core products")])


def sales_view(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, dim_products: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    stats = category_by_year(items, fact_orders, dim_date, dim_products)
    return reduce(DataFrame.unionByName, [
        category_view(stats), top_seller_state(items, fact_orders, dim_date, dim_sellers), product_concentration(items, fact_orders, dim_date)])


# ---------------------------------------------------------------- marketing

def funnel_by(funnel: DataFrame, dim_date: DataFrame, *keys: str) -> DataFrame:
    """Leads, deals, conversion and mean days to close per year and ``keys``."""
    won = F.col("is_converted")
    return _year(funnel, dim_date, "first_contact_date_key").groupBy("year_number", *keys).agg(
        F.count("mql_id").alias("leads"), F.count_if(won).alias("deals"),
        numbers.percent(F.count_if(won), F.count("mql_id"), 2).alias("conversion"),
        F.round(F.avg(F.when(won, F.col("days_to_close").cast("double"))), 1).alias("days"))


def conversion_rate(funnel: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _unfold(funnel_by(funnel, dim_date), [_conversion_row()])


def _conversion_row() -> Column:
    return _row("Seller Acquisition Conversion Rate", F.col("conversion"), "MQLs to active sellers", "SUM/COUNT", "Total Pipeline",
                F.concat(numbers.whole(F.col("leads")), F.lit(" MQLs")), "Funnel health")


def _cycle_row() -> Column:
    return _row("Average Sales Cycle Length", F.col("days"), "First contact to activation", "AVG(days)", "Cycle Length",
                F.concat(numbers.fixed(F.col("days"), 1), F.lit(" days")), "SDR capacity indicator")


def sales_cycle(funnel: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _unfold(funnel_by(funnel, dim_date), [_cycle_row()])


def _best_channel_row() -> Column:
    return _row("Best-Converting Acquisition Channel", F.col("conversion"), "Highest MQL-to-seller", "SUM/COUNT", "Channel + Volume",
                F.concat(F.col("lead_origin"), F.lit(" | "), numbers.whole(F.col("leads")), F.lit(" leads")), "Top channel performance")


def _fastest_channel_row() -> Column:
    return _row("Fastest-Closing Acquisition Channel", F.col("days"), "Shortest time to active", "AVG(days)", "Channel + Speed",
                F.concat(F.col("lead_origin"), F.lit(" | Avg "), numbers.fixed(F.col("days"), 1), F.lit(" days")), "Sales cycle speed")


_BY_CONVERSION = lambda: (F.col("conversion").desc(), F.col("lead_origin"))
_BY_DAYS = lambda: (F.col("days").asc_nulls_first(), F.col("lead_origin"))


def _channels(funnel: DataFrame, dim_date: DataFrame, least: int) -> DataFrame:
    return funnel_by(funnel, dim_date, "lead_origin").filter(F.col("leads") >= least)


def best_channel(funnel: DataFrame, dim_date: DataFrame, least: int = 10) -> DataFrame:
    return _unfold(first_per_key(_channels(funnel, dim_date, least), ["year_number"], list(_BY_CONVERSION())), [_best_channel_row()])


def fastest_channel(funnel: DataFrame, dim_date: DataFrame, least: int = 10) -> DataFrame:
    """A channel that closed nothing has no mean and sorts first."""
    return _unfold(first_per_key(_channels(funnel, dim_date, least), ["year_number"], list(_BY_DAYS())), [_fastest_channel_row()])


def channel_view(funnel: DataFrame, dim_date: DataFrame, least: int = 10) -> DataFrame:
    """Both channel KPIs from one pass over the leads."""
    ranked = _channels(funnel, dim_date, least).withColumns({"_best": _place(*_BY_CONVERSION()), "_fastest": _place(*_BY_DAYS())})
    return _unfold_where(ranked, [(F.col("_best") == 1, _best_channel_row()), (F.col("_fastest") == 1, _fastest_channel_row())])


def marketing_revenue(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    """Item value of sellers won by marketing, for years that have other sellers too."""
    sold = sold_items(items, fact_orders, dim_date, ["seller_id"])
    per_seller = sold.groupBy("year_number", "seller_id").agg(F.sum("total").alias("total"))
    won = F.col("came_from_marketing")
    sides = per_seller.join(dim_sellers.select("seller_id", "came_from_marketing"), "seller_id").groupBy("year_number").agg(
        F.sum(F.when(won, F.col("total"))).alias("won"), F.count_if(won).alias("n_won"), F.count_if(~won).alias("n_other"))
    both = sides.filter((F.col("n_won") > 0) & (F.col("n_other") > 0))
    return _unfold(both, [_row("Marketing-Sourced Seller Revenue", F.col("won"), "Revenue from marketing", "SUM(revenue)", "vs Organic Sellers",
                               F.concat(F.lit("Mktg: R$"), numbers.fixed(F.round("won", 0), 0)), "Marketing ROI")])


def top_rep(funnel: DataFrame, dim_date: DataFrame, least: int = 5) -> DataFrame:
    reps = funnel_by(funnel.filter("sdr_id is not null"), dim_date, "sdr_id").filter(F.col("leads") >= least)
    best = first_per_key(reps, ["year_number"], [F.col("conversion").desc(), F.col("sdr_id")])
    return _unfold(best, [_row("Top SDR Conversion Rate", F.col("conversion"), "Highest SDR conversion", "SUM/COUNT", "SDR ID + Deals",
                               F.concat(F.lit("SDR: "), F.col("sdr_id"), F.lit(" | "), numbers.whole(F.col("deals")), F.lit(" deals")), "Team playbook")])


def marketing_view(funnel: DataFrame, items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    overall = _unfold(funnel_by(funnel, dim_date), [_conversion_row(), _cycle_row()])
    return reduce(DataFrame.unionByName, [
        overall, channel_view(funnel, dim_date),
        marketing_revenue(items, fact_orders, dim_date, dim_sellers), top_rep(funnel, dim_date)])


# ---------------------------------------------------------------- customers

def customer_years(fact_orders: DataFrame, dim_customers: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Delivered orders, spend and late orders per customer and year, with the state."""
    delivered = _year(fact_orders.filter(F.col("order_status") == "delivered"), dim_date, "purchase_date_key")
    merged = delivered.groupBy("year_number", "customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_payment").alias("spend"), F.count_if("is_late_delivery").alias("late"))
    return merged.join(dim_customers.select("customer_unique_id", "state"), "customer_unique_id")


def states_by_year(history: DataFrame) -> DataFrame:
    """Customers, orders, late orders and spend per year and state, with the yearly totals beside them.

    Everything is additive over states, so the yearly figures are sums of a few small rows.
    """
    states = history.groupBy("year_number", "state").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("orders") == 1).alias("single"), F.count_if(F.col("orders") >= 2).alias("repeat"),
        F.sum("spend").alias("spend"), F.count("spend").alias("spenders"), numbers.percent(F.sum("late"), F.sum("orders")).alias("late_rate"))
    year = Window.partitionBy("year_number")
    totals = {f"year_{c}": F.sum(c).over(year) for c in ("customers", "single", "repeat", "spend", "spenders")}
    return states.withColumns(totals).withColumn("mean_spend", numbers.ratio(F.col("year_spend"), F.col("year_spenders")))


def _repeat_row() -> Column:
    return _row("Repeat Customer Rate", numbers.percent(F.col("year_repeat"), F.col("year_customers"), 2), "% of customers with >1 order in year",
                "(Repeat Buyers / Total) * 100", "Comparison (1 vs >1)",
                F.concat(numbers.whole(F.col("year_repeat")), F.lit(" Repeat vs "), numbers.whole(F.col("year_single")), F.lit(" Single")), "Retention indicator")


def _value_row() -> Column:
    return _row("Average Customer Value (Yearly)", F.round("mean_spend", 2), "Average revenue per customer per year", "SUM/COUNT", "Value Insight",
                F.concat(F.lit("Avg Value: R$"), numbers.fixed(F.round("mean_spend", 2), 2)), "Yearly spend analysis")


def _market_row() -> Column:
    return _row("Largest Customer Market", F.col("customers"), "Highest number of customers", "COUNT(customers)", "State",
                F.concat(F.col("state"), F.lit(" | "), numbers.whole(F.col("customers")), F.lit(" customers")), "Market size")


def _worst_row() -> Column:
    return _row("Worst Customer Experience State", F.round("late_rate", 1), "Highest late delivery rate", "SUM(late)/COUNT(orders)", "State + Late Rate",
                F.concat(F.col("state"), F.lit(" | "), numbers.fixed(F.round("late_rate", 1), 1), F.lit("% late")), "Logistics improvement needed")


def state_view(history: DataFrame, least: int = 20, which: Sequence[str] = ("repeat", "value", "market", "worst")) -> DataFrame:
    """Repeat rate, customer value, largest market and worst state from one pass over the customers' years.

    States with fewer than ``least`` customers do not compete for the last two.
    """
    big = F.col("customers") >= least
    ranked = states_by_year(history).withColumns({
        "_any": _place(F.col("state")), "_market": _place(big.desc(), F.col("customers").desc(), F.col("state")),
        "_worst": _place(big.desc(), F.col("late_rate").desc(), F.col("state"))})
    rows = {"repeat": (F.col("_any") == 1, _repeat_row()), "value": (F.col("_any") == 1, _value_row()),
            "market": (big & (F.col("_market") == 1), _market_row()), "worst": (big & (F.col("_worst") == 1), _worst_row())}
    return _unfold_where(ranked, [rows[w] for w in which])


def repeat_rate(history: DataFrame) -> DataFrame:
    return state_view(history, which=["repeat"])


def customer_value(history: DataFrame) -> DataFrame:
    return state_view(history, which=["value"])


def largest_market(history: DataFrame, least: int = 20) -> DataFrame:
    return state_view(history, least, ["market"])


def worst_state(history: DataFrame, least: int = 20) -> DataFrame:
    return state_view(history, least, ["worst"])


def top_quartile(history: DataFrame) -> DataFrame:
    """Spend share of the top quarter of customers per year, numbered without one task per year."""
    placed = numbered(history.select("year_number", "customer_unique_id", "spend"),
                      ["spend", "customer_unique_id"], ["year_number"], "place", "of")
    tile = tile_of(F.col("place"), F.col("of"), 4)
    quarters = placed.withColumn("tile", tile).groupBy("year_number").agg(
        F.count_if(F.col("tile") == 4).alias("customers"), F.sum(F.when(F.col("tile") == 4, F.col("spend"))).alias("top"), F.sum("spend").alias("total"),
    ).filter("customers > 0")
    return _unfold(quarters, [_row("Top 25% Customer Contribution", numbers.percent(F.col("top"), F.col("total"), 1), "Revenue % from top 25%", "NTILE(4) Revenue",
                                   "Top Quartile", F.concat(numbers.whole(F.col("customers")), F.lit(" customers")), "VIP revenue impact")])


def customer_view(fact_orders: DataFrame, dim_customers: DataFrame, dim_date: DataFrame) -> DataFrame:
    history = customer_years(fact_orders, dim_customers, dim_date)
    return state_view(history).unionByName(top_quartile(history))
