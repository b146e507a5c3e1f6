"""Physical plans: what must and must not be in them."""

import contextlib
import io

import pytest
from conftest import SF

from loomtable import catalog

catalog.load()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def of(spark, name) -> str:
    return plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"table_reload"}))
def test_no_python_and_no_cross_join(spark, name):
    text = of(spark, name)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", ["top1_per_group", "top3_per_group", "dedupe_by_keys", "clean_orders"])
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in of(spark, name)


def test_ties_are_not_gathered(spark):
    text = of(spark, "top_with_ties")
    assert "LeftSemi" in text and "Window" not in text


@pytest.mark.parametrize("name", ["top_k", "take_ordered", "top_customers_by_revenue", "etl_top3"])
def test_top_k_does_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in of(spark, name)


@pytest.mark.parametrize("name", ["customers_without_orders", "customers_without_orders_sql", "subtract_keys"])
def test_anti_joins(spark, name):
    assert "LeftAnti" in of(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = of(spark, "customers_without_orders")
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text


def test_facts_are_added_up_before_the_join(spark):
    text = of(spark, "left_join_zero_spend")
    tree = text[: text.index("(1) ")]
    assert tree.index("Join") < tree.index("HashAggregate")


def test_mean_is_a_subquery(spark):
    assert "Subquery" in of(spark, "mean_impute")


def test_registered_functions_are_inlined(spark):
    text = of(spark, "udtf_lateral")
    assert "Generate" in text and "Python" not in text


RETAIL = ["clean_customers", "clean_products", "clean_orders", "retail_fact_orders", "retail_sales_enriched",
          "retail_dq_summary"]


def test_cleaned_order_values_are_computed_once(spark):
    # Two dates of three formats; a filter below the selection would parse those that it tests again.
    assert of(spark, "retail_fact_orders").count("gettimestamp(") == 6


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("name", RETAIL)
def test_generated_methods_are_small_enough_to_be_compiled(spark, name, broadcast):
    """The JVM only interprets methods of more than 8,000 bytes; Spark's own limit is far higher by default."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        executed = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenStringSeq(executed)
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sizes and max(sizes) <= 8000
