"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vitrine import catalog
from vitrine.session import build_session

HEADLINE = [
    "k01_gmv_yoy", "k00_overview_view", "k00_sales_view", "k00_marketing_view", "k00_customer_view", "l01_l05_sales_set", "d01_overview_cards", "d04_category_profitability",
    "d07_item_revenue_series", "d13_rfm", "g05_fact_orders", "g06_fact_order_items", "c01_reviews", "c05_geolocation", "w05_ntile", "w06_running_sum", "w08_global_number",
    "e04_describe", "e09_price_outliers", "i05_knn", "m02_clean_text", "m06_vocabulary", "m07_tfidf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    for name in sys.argv[1:] or HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
