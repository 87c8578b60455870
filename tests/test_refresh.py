"""End-to-end refresh from hand-written files; audit rows; stored models."""

import csv
import datetime as dt
import os
import threading

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vitrine.functions import rules
from vitrine.ml import sentiment, words
from vitrine.plans import checks, dashboards, gold, kpi, refresh
from vitrine.sources import audit, bronze, store

RAW = {
    "closed_deals": [["m1", "s1", "r1", "q1", "2018-02-05 10:00:00", "home_decor", "online_big", "cat", "True", "", "5-Jan", "reseller", "10", "500.0"],
                     ["m3", "ghost", "r1", "q1", "2018-02-09 10:00:00", "toys", "online", "eagle", "", "", "20-May", "reseller", "", "0"]],
    "customers": [["c1", "u1", "01001", "sao-paulo", "sp"], ["c2", "u1", "01001", "sao-paulo", "sp"], ["c3", "u2", "20000", "rio", "rj"]],
    "marketing_qualified_leads": [["m1", "2018-02-01", "p1", "paid_search"], ["m2", "2018-02-02", "p1", "organic"], ["m3", "2018-02-03", "p2", "organic"]],
    "order_reviews": [["v1", "o1", "5", "Ótimo!", 'Gostei "muito",\nvolto sempre.', "2018-01-20", "2018-01-21 09:00:00"], ["v1", "o1", "1", "", "", "2018-01-10", "2018-01-11 09:00:00"],
                      ["v2", "o2", "2", "", "ruim", "2018-03-01", "2018-03-02 09:00:00"]],
    "order_items": [["o1", "10", "p1", "s1", "2018-01-09 00:00:00", "100.00", "10.50"], ["o1", "2", "p2", "s2", "2018-01-09 00:00:00", "50.00", "5.00"],
                    ["o2", "1", "p1", "s1", "2018-02-09 00:00:00", "100.00", "9.50"], ["o3", "1", "nope", "s1", "2018-02-09 00:00:00", "1.00", "1.00"]],
    "order_payments": [["o1", "1", "credit_card", "2", "80.00"], ["o1", "2", "boleto", "1", "85.50"], ["o2", "1", "voucher", "1", "0.00"]],
    "products": [["p1", "cama_mesa_banho", "40", "200", "1", "500", "10", "20", "30"], ["p2", "pc_gamer", "30", "100", "2", "0", "1", "2", ""]],
    "sellers": [["s1", "01001", "sao paulo sp", "sp"], ["s2", "99999", "x@y.z", "mg"]],
    "category_translation": [["cama_mesa_banho", "bed_bath_table"]],
    "geolocation": [["01001", "-23.50", "-46.60", "sao paulo", "sp"], ["01001", "-23.60", "-46.70", "SAO PAULO", "SP"], ["01001", "-3.00", "-40.00", "outra", "ce"]],
    "orders": [["o1", "c1", "delivered", "2018-01-05 10:00:00", "2018-01-05 11:00:00", "2018-01-06 10:00:00", "2018-01-15 23:00:00", "2018-01-15 00:00:00"],
               ["o2", "c2", "delivered", "2017-02-05 10:00:00", "", "", "2017-02-10 10:00:00", "2017-02-10 10:00:00"],
               ["o3", "c3", "unavailable", "2018-02-05 10:00:00", "", "", "", "2018-03-01 00:00:00"], ["o4", "lost", "shipped", "2018-02-05 10:00:00", "", "", "", ""]],
}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("source"), str(tmp_path_factory.mktemp("lake"))
    for table, rows in RAW.items():
        folder = source / bronze.FOLDERS[table]
        folder.mkdir(exist_ok=True)
        with open(folder / f"{table}.csv", "w", newline="", encoding="utf8") as handle:
            writer = csv.writer(handle)
            writer.writerow(bronze.COLUMNS[table])
            writer.writerows(rows)
    return str(source), target, refresh.run_refresh(spark, str(source), target)


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_multi_line_review_survives(spark, lake):
    review = rows_of(store.read_table(spark, lake[1], "silver_order_reviews"), "review_id")["v1"]
    assert review["review_comment_message"] == "gostei muito\nvolto sempre" and review["review_score"] == 5


def test_facts(lake):
    orders = rows_of(lake[2]["fact_orders"], "order_id")
    assert set(orders) == {"o1", "o2", "o3"}
    assert (orders["o1"]["primary_payment_type"], float(orders["o1"]["total_payment"]), orders["o1"]["is_late_delivery"], orders["o1"]["delivery_days_actual"]) == ("boleto", 165.5, True, 10)
    assert orders["o2"]["is_late_delivery"] is False and orders["o2"]["is_invalid_payment"] is True
    assert orders["o3"]["is_late_delivery"] is None and orders["o3"]["order_status"] == "out of stock" and orders["o3"]["total_payment"] is None
    items = rows_of(lake[2]["fact_order_items"], "order_item_key")
    # '10' sorts before '2' as text; the item of an unknown product is gone.
    assert [(k, items[k]["product_id"]) for k in sorted(items)] == [(1, "p1"), (2, "p2"), (3, "p1")]


def test_dimensions(lake):
    customers = rows_of(lake[2]["dim_customers"], "customer_unique_id")
    assert float(customers["u1"]["latitude"]) == -23.55 and customers["u1"]["city"] == "sao paulo" and customers["u2"]["latitude"] is None
    sellers = rows_of(lake[2]["dim_sellers"], "seller_id")
    assert sellers["s1"]["came_from_marketing"] and not sellers["s2"]["came_from_marketing"] and sellers["s2"]["city"] is None
    products = rows_of(lake[2]["dim_products"], "product_id")
    assert products["p1"]["category_name_en"] == "bed bath table" and float(products["p1"]["volume_cm3"]) == 6000.0 and products["p2"]["volume_cm3"] is None
    assert lake[2]["dim_date"].count() == 2192


def test_funnel(lake):
    leads = rows_of(lake[2]["fact_marketing_funnel"], "mql_id")
    assert leads["m1"]["days_to_close"] == 4 and leads["m1"]["seller_id"] == "s1" and not leads["m2"]["is_converted"]
    assert leads["m3"]["is_converted"] and leads["m3"]["seller_id"] is None


def test_constraints_hold(lake):
    assert checks.check_keys(lake[2]).filter("null_keys + repeated_keys > 0").count() == 0
    assert checks.check_references(lake[2]).filter("lost_rows > 0").count() == 0


def test_views(spark, lake):
    overview = {(r["year_number"], r["kpi_name"]): r for r in lake[2]["overview_kpis"].collect()}
    assert overview[2018, "Gross Merchandise Value (GMV)"]["kpi_value"] == 165.5
    assert overview[2018, "Gross Merchandise Value (GMV)"]["context_meaning"] == "No prior year comparison"
    assert overview[2018, "Late Delivery Rate"]["context_meaning"] == "High late rate"
    assert spark.table("customer_kpis").count() > 0
    assert {r["view_name"] for r in store.list_views(spark, ["overview_kpis", "sales_kpis"]).collect()} == {"overview_kpis", "sales_kpis"}
    assert store.list_columns(spark, ["dim_date"]).count() == 9
    cards = rows_of(dashboards.overview_cards(lake[2]["overview_kpis"], 2018), "card_key")
    assert cards["gmv"]["display_value"] == "R$ 165.50" and cards["yoy"]["display_value"] == "—"


def test_audit(spark, lake):
    log = audit.read_log(spark, lake[1])
    counts = {r["table_name"]: r for r in log.collect()}
    assert counts["silver_order_reviews"]["source_row_count"] == 3 and counts["silver_order_reviews"]["rows_inserted"] == 2
    assert all(r["batch_end_time"] is not None for r in counts.values())
    assert audit.reconcile(log).filter("layer_name = 'Silver' and not agrees").select("table_name").collect()[0][0] == "silver_order_reviews"


def test_failure_is_logged_and_raised(spark, tmp_path):
    def broken():
        raise RuntimeError("disk on fire")

    with pytest.raises(RuntimeError):
        with audit.LoadBatch(spark, str(tmp_path), "Bronze", "land") as batch:
            batch.load("orders", broken)
    failed = audit.read_log(spark, str(tmp_path)).filter("status = 'FAILED'").collect()
    assert len(failed) == 1 and failed[0]["table_name"] == "orders" and "disk on fire" in failed[0]["error_message"]


def test_failed_refresh_keeps_previous_table(spark, tmp_path):
    base = str(tmp_path)
    store.replace_table(spark.range(5), base, "t")
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        store.replace_table(bad, base, "t")
    assert store.read_table(spark, base, "t").count() == 5
    assert store.replace_table(spark.range(2), base, "t") == 2 and store.read_table(spark, base, "t").count() == 2


def test_broken_off_replacement_is_put_right(spark, tmp_path):
    """A table of the layout without pointers, as left by a crash between two renames."""
    base = str(tmp_path)
    spark.range(5).write.parquet(f"{base}/_previous_t")
    assert store.read_table(spark, base, "t").count() == 5
    assert store.replace_table(spark.range(2), base, "t") == 2 and store.read_table(spark, base, "t").count() == 2


def test_readers_inside_a_swap_see_old_or_new(spark, tmp_path):
    base, stop, seen = str(tmp_path), threading.Event(), []
    store.replace_table(spark.range(1), base, "t")

    def watch():
        while not stop.is_set():
            with store.pinned(spark, base, "t") as df:
                seen.append((df.count(), df.agg(F.max("id")).first()[0]))

    readers = [threading.Thread(target=watch) for _ in range(3)]
    for r in readers:
        r.start()
    for n in range(2, 9):
        store.replace_table(spark.range(n), base, "t")
    stop.set()
    for r in readers:
        r.join()
    assert len(seen) > 3 and all(n == top + 1 and 1 <= n <= 8 for n, top in seen)
    assert store.read_table(spark, base, "t").count() == 8


def test_a_frame_keeps_its_snapshot(spark, tmp_path):
    base = str(tmp_path)
    store.replace_table(spark.range(3), base, "t")
    before = store.read_table(spark, base, "t")
    store.replace_table(spark.range(5), base, "t")
    assert before.count() == 3 and store.read_table(spark, base, "t").count() == 5


def test_a_killed_swap_leaves_the_table_and_is_cleaned_up(spark, tmp_path):
    base = str(tmp_path)
    store.replace_table(spark.range(5), base, "t")
    spark.range(9).write.parquet(f"{base}/t/_snapshots/halfway")  # written, never published
    assert store.read_table(spark, base, "t").count() == 5
    assert store.clean_up(spark, base, "t") == [] and store.clean_up(spark, base, "t", stale_hours=-1) == ["halfway"]
    assert store.read_table(spark, base, "t").count() == 5


def test_clean_up_spares_the_newest_and_the_pinned(spark, tmp_path):
    base = str(tmp_path)
    folder = lambda: len(os.listdir(f"{base}/t/_snapshots"))
    store.replace_table(spark.range(1), base, "t")
    with store.pinned(spark, base, "t") as first:
        for n in range(2, 7):
            store.replace_table(spark.range(n), base, "t")
        assert first.count() == 1 and folder() == 3
    assert len(store.clean_up(spark, base, "t")) == 1 and folder() == 2
    assert len(store.clean_up(spark, base, "t", keep=1)) == 1 and store.read_table(spark, base, "t").count() == 6
    with pytest.raises(FileNotFoundError), store.pinned(spark, base, "other"):
        pass


def test_whole_error_and_its_class_are_logged(spark, tmp_path):
    with pytest.raises(Exception), audit.LoadBatch(spark, str(tmp_path), "Bronze", "land") as batch:  # noqa: B017, PT011
        batch.load("t", lambda: spark.sql("SELECT nothing_here").count())
    with pytest.raises(ValueError), audit.LoadBatch(spark, str(tmp_path), "Bronze", "land") as batch:
        batch.load("u", lambda: (_ for _ in ()).throw(ValueError("x" * 9000)))
    rows = {r.table_name: r for r in audit.read_log(spark, str(tmp_path)).filter("status = 'FAILED'").collect()}
    assert rows["t"].error_class.startswith("UNRESOLVED_COLUMN") and rows["t"].sql_state == "42703"
    assert len(rows["u"].error_message) == 9000 and rows["u"].error_class is None


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        bronze.read_local_csv(spark, str(tmp_path / "none.csv"))


def _facts(spark, rows):
    """fact_orders from (id, customer, yyyymmdd, status, paid, score, late)."""
    return spark.createDataFrame(rows, "order_id int, customer_unique_id string, purchase_date_key int, order_status string, total_payment decimal(12,2), review_score int, is_late_delivery boolean")


@pytest.mark.parametrize("now, band", [(120, "Strong growth"), (119, "Marginal growth"), (100, "Marginal growth"), (99, "Decline")])
def test_growth_bands(spark, now, band):
    from decimal import Decimal

    facts = _facts(spark, [(1, "a", 20160301, "delivered", Decimal(7), 5, False), (2, "a", 20180301, "delivered", Decimal(100), 5, False), (3, "a", 20190301, "delivered", Decimal(now), 2, None),
                           (4, "b", 20190301, "canceled", Decimal(500), 1, None), (5, "c", 20190302, "created", None, None, None)])
    years = {r["year_number"]: r for r in kpi.overview_by_year(facts, gold.build_dim_date(spark)).collect()}
    rows = {r["year_number"]: r for r in kpi.overview_kpi("gmv", facts, spark.createDataFrame([], "order_id int, product_id int, seller_id int, price decimal(12,2), freight_value decimal(12,2), total_item_value decimal(12,2)"), gold.build_dim_date(spark)).collect()}
    assert rows[2019]["context_meaning"] == band and rows[2018]["context_meaning"] == "No prior year comparison"
    assert years[2019]["customers"] == 2 and years[2019]["cancel_rate"] == pytest.approx(100 / 3)


def test_excluded_statuses_are_a_parameter(spark):
    from decimal import Decimal

    facts = _facts(spark, [(1, "a", 20180301, "out of stock", Decimal(10), 5, None)])
    count = lambda **k: float(kpi.overview_by_year(facts, gold.build_dim_date(spark), **k).first()["gmv"])
    assert count() == 10.0 and count(excluded=(*rules.NOT_A_SALE, "out of stock")) == 0.0


def test_null_categories_have_no_prior_year(spark):
    df = spark.createDataFrame([(2017, None, 60000.0), (2018, None, 90000.0), (2017, "a", 60000.0), (2018, "a", 61000.0)], "year_number short, category string, revenue double")
    assert [(r["year_number"], r["context_meaning"]) for r in kpi.fastest_growing_category(df).collect()] == [(2018, "a trending upward")]


def test_models_score_in_a_session_that_observed_something(spark, tmp_path):
    store.replace_table(spark.range(3), str(tmp_path), "t")  # its row count is an observation
    rows = spark.createDataFrame([(float(i % 2), [float(i % 2), float(i % 5)]) for i in range(40)], "label double, x array<double>")
    shaped = rows.select("label", array_to_vector("x").alias("features"))
    model = sentiment.logistic(shaped)
    assert not model.hasSummary and model.transform(shaped).filter("prediction = label").count() == 40


def test_model_round_trip(spark, tmp_path):
    good, bad = "produto bom chegou rápido gostei muito", "produto ruim chegou quebrado não gostei"
    rows = spark.createDataFrame([(i, f"{good if i % 2 else bad} caso {i % 5}", 5 if i % 2 else 1) for i in range(120)], "id int, review_text string, review_score int")
    data = sentiment.split(words.with_label(words.prepared(rows, ["id"])), "id")
    assert data.filter("is_test").groupBy("label").count().select("count").distinct().collect()[0][0] == 12
    model = sentiment.train(data.filter("not is_test"), {"C": 1.0, "max_iter": 50, "class_weight": "balanced"}, max_share=1.0)
    path = str(tmp_path / "model")
    sentiment.save(model, path)
    loaded, names = sentiment.load(spark, path)
    assert names == ["Negative", "Positive"] and os.path.isdir(path)
    out = sentiment.scored(loaded, data.filter("is_test"), names).collect()
    assert all((r["sentiment_label"] == "Positive") == (r["label"] == 1.0) and 0.5 <= r["confidence"] <= 1.0 for r in out)
    assert {r["sentiment_label"] for r in sentiment.scored(loaded, data.filter("is_test"), []).collect()} == {"Unknown"}
    assert sentiment.importance(model, 5).count() == 5
    folds = sentiment.folded(data.drop("is_test"), "id").groupBy("label", "fold").count().select("count").distinct().collect()
    assert [r[0] for r in folds] == [12]


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(1, 1)] * 3, "label int, prediction int")
    got = {r["metric"]: r["value"] for r in sentiment.metrics(df).collect()}
    assert got["Negative_precision"] == 0.0 and got["Positive_f1"] == 1.0 and got["macro_f1"] == 0.5 and got["accuracy"] == 1.0


def test_calendar_bounds(spark):
    days = gold.build_dim_date(spark, dt.date(2020, 2, 28), dt.date(2020, 3, 1)).orderBy("date_key").collect()
    assert [d["date_key"] for d in days] == [20200228, 20200229, 20200301] and [d["is_weekend"] for d in days] == [False, True, True]
