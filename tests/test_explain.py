"""Plans that must not degrade."""

import os

import pytest
from callgrain import bindings as B
from callgrain.operators import explore
from callgrain.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_not_a_global_sort(spark):
    for name in ("top_query_texts", "top_districts", "descriptive_answers", "longest_answers"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF)), name


def test_rewrite_runs_once_per_row(spark):
    docs = B.table(spark, SF, "documents").withColumnRenamed("text", "QueryText")
    p = plan(explore.top_query_texts(docs, 10))
    assert p.count(r"(?U)\W+") == 1
    assert "ReadSchema: struct<text:string>" in docs.select("QueryText")._jdf.queryExecution().executedPlan().toString()


def test_scan_gets_filters_and_few_columns(spark):
    orders = B.table(spark, SF, "orders")
    p = plan(explore.facet_filter(orders, {"o_orderpriority": ["1-URGENT"]}).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in p


def test_no_python_in_the_relational_queries(spark):
    for name in ("top_query_texts", "place_profile", "geo_district_counts", "name_match", "specificity"):
        p = plan(QUERIES[name](spark, SF))
        assert "Python" not in p and "InPandas" not in p and "CartesianProduct" not in p, name


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["place_profile"](spark, SF))


def test_counts_are_combined_before_the_shuffle(spark):
    p = plan(QUERIES["count_by"](spark, SF))
    assert "partial_count" in p
