"""Every query with check SQL gives the same rows as it on the smallest tables; plans keep their shape."""

import re

import pytest

from tests.compare import TESTDATA, compare, duck
from vitrine import catalog

FOLDER = f"{TESTDATA}/sf0.001"
CHECKED = sorted(catalog.oracles())


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, con, name):
    assert compare(catalog.queries()[name](spark, FOLDER), con, catalog.oracles()[name]) == ""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["k01_gmv_yoy", "k00_overview_view", "k21_repeat_rate", "l11_l15_customer_set", "d13_rfm", "w01_latest_per_key", "w10_last_turns", "a03_distinct_count"])
def test_no_python_in_plans(spark, name):
    assert not re.search("Python|Arrow|Pandas", plan(catalog.queries()[name](spark, FOLDER)))


def test_rank_filters_are_cut_before_the_shuffle(spark):
    assert plan(catalog.queries()["w10_last_turns"](spark, FOLDER)).count("WindowGroupLimit") == 2


def test_overview_reads_orders_once_and_items_where_needed(spark):
    text = plan(catalog.queries()["k04_nps"](spark, FOLDER))
    assert text.count("orders.parquet") == 1 and "l_extendedprice" not in text


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*o_totalprice", plan(catalog.queries()["p10_ranges"](spark, FOLDER)))


def test_no_query_crosses_tables(spark):
    for name in ("j12_latest_year", "j13_scalar_bound", "e09_price_outliers", "i04_min_max"):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(catalog.queries()[name](spark, FOLDER)))
