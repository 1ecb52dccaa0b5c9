"""Costly functions over narrow tables: rows are dealt to all cores, and a page is read once a row."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
READERS = "jsonld_product offers_flatten microdata_product opengraph_product structured_cascade price_from_dom page_name extract_data_method quote_products component_prices price_note quote_markdown".split()


@pytest.mark.parametrize("name", READERS)
def test_pages_are_read_once_on_all_cores(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "REPARTITION_BY_NUM" in plan
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
