"""Queries behind the dashboard pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import dates, numbers, rules, text
from vitrine.operators.keyed import moving_average

# KPI names shown as overview cards, with key, label and kind of display.
CARDS = [
    ("Gross Merchandise Value (GMV)", "gmv", "Total GMV", "currency"),
    ("Avg Review Score", "review_score", "Avg Review Score", "score"),
    ("Average Review Score", "review_score", "Avg Review Score", "score"),
    ("Late Delivery Rate", "late_delivery_rate", "Late Delivery Rate", "percent"),
    ("Average Order Value (AOV)", "aov", "AOV", "currency"),
]
# Page slots and the KPI names that may fill them.
SLOTS = {
    "sales": [
        ("top_category", ["top revenue category", "top_revenue_category"]),
        ("freight_ratio", ["highest freight burden", "highest_freight_burden"]),
        ("lowest_satisfaction", ["lowest customer satisfaction", "lowest_customer_satisfaction"]),
        ("top_seller_state", ["top seller state (revenue)", "top_seller_state_revenue"]),
        ("concentration", ["product revenue concentration", "product_revenue_concentration"]),
    ],
    "marketing": [
        ("total_mqls", ["total mqls", "total_mqls"]),
        ("conversion", ["funnel conversion rate", "funnel_conversion_rate"]),
        ("time_close", ["average days to close", "avg_time_to_close", "days_to_close"]),
        ("sellers", ["sellers acquired", "sellers_acquired"]),
        ("unconverted", ["unconverted leads", "unconverted_leads"]),
    ],
    "customer": [
        ("unique", ["largest customer market (by volume)", "total_unique_customers"]),
        ("repeat", ["repeat customer rate", "repeat_customer_rate"]),
        ("review_avgs", ["late delivery impact on review score", "delivery_impact_review"]),
        ("ltv", ["average customer lifetime value (ltv)", "ltv", "lifetime_value"]),
        ("nps", ["customer satisfaction score (nps proxy)", "nps_proxy"]),
    ],
}


def _display(kind: Column, value: Column) -> Column:
    return (F.when(kind == "currency", numbers.currency_text(value)).when(kind == "score", numbers.score_text(value))
            .otherwise(numbers.percent_text(value)))


def overview_cards(view: DataFrame, year: int | None = None) -> DataFrame:
    """Typed, formatted cards of one year (the latest by default), plus the growth card."""
    name = F.lower(F.btrim("kpi_name"))
    pick = lambda i: F.coalesce(*[F.when(name == card[0].lower(), F.lit(card[i])) for card in CARDS])
    # The view holds a handful of rows per year, so one ordered partition is small.
    wanted = F.lit(year) if year is not None else F.max("year_number").over(Window.partitionBy(F.lit(0)))
    rows = view.withColumn("_wanted", wanted).filter("year_number = _wanted").withColumn("_key", pick(1)).filter("_key is not null")
    card = lambda key, label, value, shown, trend, meaning: F.struct(
        key.alias("card_key"), label.alias("label"), value.alias("value"), shown.alias("display_value"),
        F.col("context_name").alias("trend_label"), trend.alias("trend_value"), rules.tone_of(F.col("context_meaning")).alias("trend_tone"),
        meaning.alias("meaning"))
    trend = F.coalesce(text.blank_to_null(F.col("context_value")), F.col("context_meaning"))
    main = card(F.col("_key"), pick(2), F.col("kpi_value"), _display(pick(3), F.col("kpi_value")), trend, F.col("kpi_meaning"))
    growth = numbers.parsed_percent(F.col("context_value"))
    extra = card(F.lit("yoy"), F.lit("YoY Revenue Growth"), growth, numbers.signed_percent_text(growth), F.col("context_meaning"),
                 F.lit("Year-over-year GMV change"))
    return rows.select("year_number", F.inline(F.when(F.col("_key") == "gmv", F.array(main, extra)).otherwise(F.array(main))))


def latest_review_score(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Mean score and review count of the last year with reviews."""
    reviewed = fact_orders.filter(F.col("review_score").isNotNull() & ~F.col("order_status").isin(*rules.NOT_CONFIRMED))
    yearly = reviewed.join(F.broadcast(dim_date.select(F.col("date_key").alias("purchase_date_key"), "year_number")), "purchase_date_key").groupBy(
        "year_number").agg(F.sum("review_score").alias("score"), F.count(F.lit(1)).alias("review_count"))
    return yearly.orderBy(F.col("year_number").desc()).limit(1).select(
        numbers.ratio(F.col("score"), F.col("review_count")).alias("avg_review_score"), "review_count")


def review_card(score: DataFrame) -> DataFrame:
    value = F.col("avg_review_score")
    return score.filter(value.isNotNull()).select(
        F.lit("review_score").alias("card_key"), F.lit("Avg Review Score").alias("label"), value.alias("value"),
        numbers.score_text(value).alias("display_value"),
        F.concat(F.lit("from "), numbers.whole(F.col("review_count")), F.lit(" reviews")).alias("trend_value"), F.lit("neutral").alias("trend_tone"))


def daily_trend(fact_orders: DataFrame, dim_date: DataFrame, year: int = 2018) -> DataFrame:
    """Orders and revenue per day of one year; the year's key range is pushed to the scan."""
    in_year = F.col("purchase_date_key").between(year * 10000 + 101, year * 10000 + 1231)
    rows = fact_orders.filter(in_year & ~F.col("order_status").isin(*rules.NOT_CONFIRMED))
    daily = rows.groupBy("purchase_date_key").agg(F.count("order_id").alias("total_orders"), F.sum("total_payment").alias("daily_revenue"))
    days = F.broadcast(dim_date.filter(F.col("year_number") == year).select(F.col("date_key").alias("purchase_date_key"), "full_date"))
    return daily.join(days, "purchase_date_key").select("full_date", dates.iso_text(F.col("full_date")).alias("date_text"), "total_orders",
                                                         F.coalesce(F.col("daily_revenue").cast("double"), F.lit(0.0)).alias("daily_revenue")).orderBy("full_date")


def _per_product(items: DataFrame, dim_products: DataFrame, *columns: str) -> DataFrame:
    """Item sums merged per product before the category is looked up."""
    merged = items.groupBy("product_id").agg(F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), F.count("price").alias("lines"))
    return merged.join(dim_products.select("product_id", F.col("category_name_en").alias("category"), *columns), "product_id")


def category_profitability(items: DataFrame, dim_products: DataFrame, floor: float = 5000) -> DataFrame:
    """Sales, distinct orders and freight share of each category above the floor.

    Orders are counted after merging per (category, order), so no category has to be
    held by one task.
    """
    named = items.select("order_id", "product_id", "price", "freight_value").join(
        dim_products.select("product_id", F.col("category_name_en").alias("category")), "product_id")
    per_order = named.groupBy("category", "order_id").agg(F.sum("price").alias("price"), F.sum("freight_value").alias("freight"))
    out = per_order.groupBy("category").agg(
        F.sum("price").alias("sales"), F.count("order_id").alias("units_sold"), numbers.percent(F.sum("freight"), F.sum("price"), 2).alias("freight_ratio_pct"))
    return out.filter(F.col("sales") > floor).select(
        F.coalesce("category", F.lit("Unknown")).alias("category"), F.col("sales").cast("double").alias("total_sales"), "units_sold", "freight_ratio_pct",
    ).orderBy(F.col("total_sales").desc(), "category")


def value_density(items: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Mean weight, mean price and revenue of each named category."""
    rows = _per_product(items, dim_products, "weight_g").filter(F.col("category").isNotNull())
    heavy = F.col("weight_g").isNotNull()
    return rows.groupBy("category").agg(
        numbers.ratio(F.sum(F.when(heavy, F.col("weight_g") * F.col("lines"))), F.sum(F.when(heavy, F.col("lines")))).alias("x"),
        numbers.ratio(F.sum("price"), F.sum("lines")).alias("y"), F.sum("price").cast("double").alias("size"),
    ).select(F.col("category").alias("category_name_en"), "x", "y", "size")


def revenue_by_category(items: DataFrame, dim_products: DataFrame) -> DataFrame:
    return _per_product(items, dim_products).groupBy("category").agg(F.sum("price").cast("double").alias("revenue")).orderBy(F.col("revenue").desc(), "category")


def item_revenue_series(items: DataFrame, fact_orders: DataFrame, dim_date: DataFrame, width: int = 7) -> DataFrame:
    """Item revenue per day with its trailing mean."""
    kept = fact_orders.filter(~F.col("order_status").isin(*rules.NOT_IN_SERIES)).select("order_id", "purchase_date_key")
    daily = items.select("order_id", "price").join(kept, "order_id").groupBy("purchase_date_key").agg(F.sum("price").cast("double").alias("revenue"))
    days = F.broadcast(dim_date.select(F.col("date_key").alias("purchase_date_key"), "full_date"))
    series = daily.join(days, "purchase_date_key").select(F.col("full_date").alias("date"), "revenue")
    return moving_average(series, "date", "revenue", width, "moving_avg").orderBy("date")


def funnel_stages(funnel: DataFrame) -> DataFrame:
    """Stage counts, each also as a percent of the first stage."""
    from vitrine.plans.legacy import funnel_totals

    # Stage names in funnel order.
    stages = [("MQL", "leads"), ("Sellers Acquired", "sellers"), ("Unconverted", "unconverted")]
    rows = [F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(c).alias("value"),
                     numbers.percent(F.col(c), F.col("leads"), 2).alias("pct_of_first")) for i, (name, c) in enumerate(stages)]
    return funnel_totals(funnel).select(F.inline(F.array(*rows)))


def top_origins(funnel: DataFrame, n: int = 5) -> DataFrame:
    pairs = funnel.filter("lead_origin is not null").groupBy("lead_origin", "mql_id").agg(F.lit(1).alias("_one"))
    return pairs.groupBy(F.col("lead_origin").alias("state")).agg(F.count("mql_id").alias("leads")).orderBy(F.col("leads").desc(), "state").limit(n)


def customer_points(fact_orders: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """One located, reviewed order per row."""
    placed = dim_customers.filter("latitude is not null and longitude is not null").select(
        "customer_unique_id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
        F.col("state").alias("customer_state"))
    return fact_orders.filter("review_score is not null").select("customer_unique_id", "review_score").join(placed, "customer_unique_id").select(
        "latitude", "longitude", F.col("review_score").cast("double").alias("review_score"), "customer_state")


def state_rollup(points: DataFrame) -> DataFrame:
    """Count, mean score, one representative place and marker size per state.

    The place is the smallest (latitude, longitude) pair, so it does not depend on row order.
    """
    rolled = points.groupBy(F.coalesce("customer_state", F.lit("Unknown")).alias("state")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum(F.coalesce("review_score", F.lit(0.0))).alias("_score"),
        F.min(F.struct("latitude", "longitude")).alias("_at"))
    return rolled.select("state", "customer_count", numbers.ratio(F.col("_score"), F.col("customer_count")).alias("avg_score"),
                         F.col("_at.latitude").alias("latitude"), F.col("_at.longitude").alias("longitude"),
                         numbers.marker_size(F.col("customer_count")).alias("marker_size"))


def review_distribution(fact_orders: DataFrame) -> DataFrame:
    return fact_orders.filter("review_score is not null").groupBy("review_score").agg(
        F.count_if(~F.col("is_late_delivery")).alias("on_time_count"), F.count_if("is_late_delivery").alias("late_count")).orderBy("review_score")


def page_slots(view: DataFrame, page: str, extra: Sequence[str] = ()) -> DataFrame:
    """KPI rows that fill the slots of a page, found by alias."""
    slot = F.coalesce(*[F.when(text.alias_matches(F.col("kpi_name"), names), F.lit(key)) for key, names in SLOTS[page]])
    return view.withColumn("slot", slot).filter("slot is not null").select("slot", *extra, "kpi_name", "kpi_value", "context_name", "context_value", "context_meaning")


def rfm(fact_orders: DataFrame, items: DataFrame, dim_products: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Recency, frequency, monetary value, delivery time and category diversity per customer.

    Delivery time is the truncated mean over items (an order counts once per item). Spark
    spreads the two distinct counts over (customer, order) and (customer, category), so a
    customer with very many orders is counted by many tasks.
    """
    last = dates.key_to_date(fact_orders.agg(F.max("purchase_date_key")).scalar())
    delivered = fact_orders.filter(F.col("order_status") == "delivered").select(
        "order_id", "customer_unique_id", "purchase_date_key", "delivery_days_actual").join(
        dim_customers.select("customer_unique_id"), "customer_unique_id", "left_semi")
    bought = items.select("order_id", "product_id", (F.col("price") + F.col("freight_value")).alias("value")).join(delivered, "order_id").join(
        dim_products.select("product_id", "category_name_en"), "product_id")
    out = bought.groupBy("customer_unique_id").agg(
        F.max("purchase_date_key").alias("_last"), F.count_distinct("order_id").alias("frequency"), F.sum("value").cast("double").alias("monetary"),
        F.sum("delivery_days_actual").alias("_days"), F.count("delivery_days_actual").alias("_timed"),
        F.count_distinct("category_name_en").alias("category_diversity"))
    return out.select(
        "customer_unique_id", dates.days_between(dates.key_to_date(F.col("_last")), last).alias("recency"), "frequency", "monetary",
        numbers.ratio(F.col("_days"), F.col("_timed")).cast("int").alias("avg_delivery_time"), "category_diversity")
