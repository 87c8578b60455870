"""Full refresh: land, clean, model, publish."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from vitrine.plans import checks, gold, kpi, silver
from vitrine.sources import audit, bronze, store


def land(spark: SparkSession, source: str, lake: str, files: dict[str, str] | None = None) -> None:
    """Raw files to all-string tables."""
    with audit.LoadBatch(spark, lake, "Bronze", "land") as batch:
        for table in bronze.COLUMNS:
            batch.load(f"bronze_{table}", lambda t=table: store.replace_table(bronze.read_raw(spark, t, source, files), lake, f"bronze_{t}"))


def clean(spark: SparkSession, lake: str) -> None:
    """Landed tables to typed tables. Source counts are read from file footers, not by a scan of the data."""
    with audit.LoadBatch(spark, lake, "Silver", "clean") as batch:
        for table, job in silver.JOBS.items():
            raw = store.read_table(spark, lake, f"bronze_{table}")
            batch.load(f"silver_{table}", lambda t=table, j=job, r=raw: store.replace_table(j(r), lake, f"silver_{t}"), source_rows=raw.count())


def model(spark: SparkSession, lake: str, calendar: tuple[dt.date, dt.date] = gold.CALENDAR) -> None:
    """Typed tables to the star schema: dimensions first, then the facts that refer to them."""
    tidy = lambda name: store.read_table(spark, lake, f"silver_{name}")
    star = lambda name: store.read_table(spark, lake, name)
    jobs = {
        "dim_date": lambda: gold.build_dim_date(spark, *calendar),
        "dim_products": lambda: gold.build_dim_products(tidy("products"), tidy("category_translation")),
        "dim_customers": lambda: gold.build_dim_customers(tidy("customers"), tidy("geolocation")),
        "dim_sellers": lambda: gold.build_dim_sellers(tidy("sellers"), tidy("closed_deals"), tidy("geolocation")),
        "fact_orders": lambda: gold.build_fact_orders(tidy("orders"), tidy("customers"), star("dim_customers"), tidy("order_reviews"), tidy("order_payments")),
        "fact_order_items": lambda: gold.build_fact_order_items(tidy("order_items"), tidy("orders"), star("dim_products"), star("dim_sellers")),
        "fact_marketing_funnel": lambda: gold.build_fact_funnel(tidy("marketing_qualified_leads"), tidy("closed_deals"), star("dim_sellers")),
    }
    # Facts are filtered by day far more often than by anything else.
    sort_by = {"fact_orders": "purchase_date_key", "fact_order_items": "purchase_date_key", "fact_marketing_funnel": "first_contact_date_key"}
    with audit.LoadBatch(spark, lake, "Gold", "model") as batch:
        for table, build in jobs.items():
            batch.load(table, lambda t=table, b=build: store.replace_table(silver.stamped(b()), lake, t, sort_by=sort_by.get(t)))


def publish(spark: SparkSession, lake: str) -> dict[str, DataFrame]:
    """Register the star tables and the four KPI views; each view is logged, and a failure leaves a FAILED row."""
    tables = {name: store.read_table(spark, lake, name) for name in checks.PRIMARY_KEYS}
    build = {
        "overview_kpis": lambda: kpi.overview_view(tables["fact_orders"], tables["fact_order_items"], tables["dim_date"]),
        "sales_kpis": lambda: kpi.sales_view(tables["fact_order_items"], tables["fact_orders"], tables["dim_date"], tables["dim_products"], tables["dim_sellers"]),
        "marketing_kpis": lambda: kpi.marketing_view(tables["fact_marketing_funnel"], tables["fact_order_items"], tables["fact_orders"], tables["dim_date"], tables["dim_sellers"]),
        "customer_kpis": lambda: kpi.customer_view(tables["fact_orders"], tables["dim_customers"], tables["dim_date"]),
    }
    for name, df in tables.items():
        store.define_view(df, name)
    views: dict[str, DataFrame] = {}

    def define(name: str) -> None:
        views[name] = build[name]()
        store.define_view(views[name], name)

    with audit.LoadBatch(spark, lake, "Gold_Views", "publish") as batch:
        for name in build:
            batch.load(name, lambda n=name: define(n))
    return {**tables, **views}


def run_refresh(spark: SparkSession, source: str, lake: str, calendar: tuple[dt.date, dt.date] = gold.CALENDAR) -> dict[str, DataFrame]:
    land(spark, source, lake)
    clean(spark, lake)
    model(spark, lake, calendar)
    return publish(spark, lake)
