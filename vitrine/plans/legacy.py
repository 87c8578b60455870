"""All-time KPI sets: one aggregate per set, unfolded into rows.

The older layout has five text columns; the newer marketing layout has seven with a
numeric value and bands. A line item is one unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import numbers


def _row(name: str, value: Column, label: str, detail: Column | str, meaning: str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(name).alias("kpi_name"), value.cast("double").alias("kpi_value"), F.lit(label).alias("context_name"),
                    detail.alias("context_value"), F.lit(meaning).alias("context_meaning"))


def _unfold(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


# Fixed values below: KPI names and explanations.

def sales_set(items: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Top category, catalogue size, freight ratio, mean line value and total revenue.

    Items are merged per product first; product count, sums and the category ranking all
    come from that one result.
    """
    per_product = items.groupBy("product_id").agg(
        F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), F.count("price").alias("lines"))
    overall = per_product.agg(
        F.count("product_id").alias("products"), F.sum("price").alias("price"), F.sum("freight").alias("freight"), F.sum("lines").alias("lines"))
    rows = [
        _row("Total Products in Catalog", F.col("products"), "Description", "Active SKUs", "Unique product variants available for sale"),
        _row("Freight Cost Ratio", numbers.percent(F.col("freight"), F.col("price"), 2), "Metric", "%", "Shipping cost as % of product revenue"),
        _row("Average Order Value", F.round(numbers.ratio(F.col("price"), F.col("lines")), 2), "Currency", "BRL", "Mean transaction value per line item"),
        _row("Total Revenue", F.round("price", 2), "Period", "All Time", "Aggregate gross merchandise value"),
    ]
    best = (
        per_product.join(dim_products.select("product_id", F.col("category_name_en").alias("category")), "product_id")
        .groupBy("category").agg(F.sum("price").alias("revenue")).orderBy(F.col("revenue").desc(), F.col("category")).limit(1)
    )
    top = _unfold(best, [_row("Top Category", F.col("revenue"), "Category", F.col("category"), "The product category with the highest total revenue")])
    return top.unionByName(_unfold(overall, rows))


def funnel_totals(funnel: DataFrame) -> DataFrame:
    """All-time funnel counts. Distinct leads and sellers come from two small per-key merges."""
    won = F.col("is_converted")
    per_lead = funnel.groupBy("mql_id").agg(
        F.max(F.when(~won, 1).otherwise(0)).alias("open"), F.sum("days_to_close").alias("days"), F.count("days_to_close").alias("closed"))
    leads = per_lead.agg(F.count("mql_id").alias("leads"), F.count_if((F.col("open") == 1) & F.col("mql_id").isNotNull()).alias("unconverted"),
                         F.sum("days").alias("days"), F.sum("closed").alias("closed"))
    sellers = funnel.filter(won).agg(F.count_distinct("seller_id").alias("sellers"))
    return leads.withColumn("sellers", sellers.scalar()).select(
        "leads", "sellers", "unconverted", numbers.percent(F.col("sellers"), F.col("leads"), 2).alias("conversion"),
        numbers.ratio(F.col("days"), F.col("closed")).alias("mean_days"))


def marketing_set(funnel: DataFrame) -> DataFrame:
    rows = [
        _row("Total MQLs", F.col("leads"), "Source", "Marketing Qualified Leads", "Total unique leads generated"),
        _row("Sellers Acquired", F.col("sellers"), "Status", "Converted", "Total sellers onboarded from MQL funnel"),
        _row("Funnel Conversion Rate", F.col("conversion"), "Metric", "%", "Percentage of MQLs converting to sellers"),
        _row("Average Days to Close", F.round("mean_days", 1), "Metric", "days", "Mean sales cycle duration"),
        _row("Unconverted Leads", F.col("unconverted"), "Status", "In Funnel", "Leads not yet converted to sellers"),
    ]
    return _unfold(funnel_totals(funnel), rows)


def _wide(name: str, value: Column, meaning: str, logic: str, label: str, detail: Column, verdict: Column | str) -> Column:
    verdict = F.lit(verdict) if isinstance(verdict, str) else verdict
    return F.struct(F.lit(name).alias("kpi_name"), value.cast("double").alias("kpi_value"), F.lit(meaning).alias("kpi_meaning"),
                    F.lit(logic).alias("sql_calculation_logic"), F.lit(label).alias("context_name"), detail.alias("context_value"),
                    verdict.alias("context_meaning"))


def marketing_set_banded(funnel: DataFrame) -> DataFrame:
    rate = F.col("conversion")
    band = (F.when(rate > 10, "Strong conversion efficiency - funnel is healthy.")
            .when(rate > 5, "Moderate conversion - standard industry range.")
            .otherwise("Low conversion rate - investigate bottlenecks in sales process."))
    rows = [
        _wide("Total MQLs", F.col("leads"), "Total number of marketing qualified leads", "COUNT(DISTINCT mql_id)", "Leads",
              numbers.whole(F.col("leads")), "MQLs represent the top of the marketing funnel - initial qualified prospects."),
        _wide("Funnel Conversion Rate", rate, "Percentage of MQLs that convert to sellers", "COUNT(converted) / COUNT(total) * 100", "Conversion %",
              numbers.fixed(rate, 2), band),
        _wide("Average Days to Close", F.col("mean_days"), "Average sales cycle duration in days", "AVG(days_to_close)",
              "Days", numbers.whole(F.col("mean_days")), "Shorter cycles improve cash flow. Monitor for process improvements."),
        _wide("Sellers Acquired", F.col("sellers"), "Number of seller accounts successfully onboarded", "COUNT(DISTINCT seller_id WHERE is_converted = 1)",
              "Active Sellers", numbers.whole(F.col("sellers")), "These sellers are active platform participants. Growth target: expand at 10-15% QoQ."),
        _wide("Unconverted Leads", F.col("unconverted"), "Number of MQLs that did not convert to sellers", "COUNT(DISTINCT mql_id WHERE is_converted = 0)",
              "Leads at Risk", numbers.whole(F.col("unconverted")),
              "Analyze these leads to identify conversion barriers - product-market fit, pricing, or nurture gaps."),
    ]
    return _unfold(funnel_totals(funnel), rows)


def customer_set(fact_orders: DataFrame) -> DataFrame:
    """Distinct customers, repeat rate and mean scores, from one merge per customer."""
    score, late = F.col("review_score"), F.col("is_late_delivery")

    def tally(name: str, when: Column) -> list[Column]:
        return [F.sum(F.when(when, score)).alias(f"{name}_sum"), F.count(F.when(when, score)).alias(f"{name}_n")]

    per_customer = fact_orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), *tally("all", score.isNotNull()), *tally("on_time", ~late), *tally("late", late))
    known = F.col("customer_unique_id").isNotNull()
    totals = per_customer.agg(
        F.count("customer_unique_id").alias("customers"), F.count_if(known & (F.col("orders") > 1)).alias("repeat"),
        *[F.sum(f"{n}_{part}").alias(f"{n}_{part}") for n in ("all", "on_time", "late") for part in ("sum", "n")])
    mean = lambda n: F.round(numbers.ratio(F.col(f"{n}_sum"), F.col(f"{n}_n")), 2)
    rows = [
        _row("Total Unique Customers", F.col("customers"), "Description", "All Time", "Cumulative unique customer accounts"),
        _row("Repeat Customer Rate", numbers.percent(F.col("repeat"), F.col("customers"), 2), "Metric", "%", "Customers with multiple orders"),
        _row("Average Review Score", mean("all"), "Scale", "1-5", "Mean customer satisfaction rating"),
        _row("On-Time Delivery Avg Rating", mean("on_time"), "Condition", "On-Time", "Average review score for on-time deliveries"),
        _row("Late Delivery Avg Rating", mean("late"), "Condition", "Late", "Average review score for late deliveries"),
    ]
    return _unfold(totals, rows)
