"""Character references without their semicolon, as titles have that are cut after they were escaped, in the queries and in the operators."""

import pytest

import __spark_entry__ as entry
from corpusmill.functions import html as H

TEXT = "Some words of the text that go on and on, " * 8
TITLES = ["a&amp;&amp;&amp", "b &quot;x&quot; &lt;&gt", "c &amp;lt; d", "e &lt", "f &amp;amp; &am", "plain"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    page = lambda t: f'<html lang="en"><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{TEXT}</p><p>{TEXT} {t}</p></article></body></html>'
    rows = [(k, f"http://h/{k}", page(t)) for k, t in enumerate([x for t in TITLES for x in [t] * 5])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(d / "pages.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["page_title", "page_extract", "page_markdown", "page_passages", "response_documents"])
def test_queries_say_what_their_sql_says(spark, folder, name):
    import duckdb

    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view pages as from '{folder}/pages.parquet/*.parquet'")
    told = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, told)) and told


def test_operators_decode_all_unless_told():
    page = "<title>a&amp&quot;&#65;</title><p>x</p>"
    assert H.extract(page, "")["title"] == 'a&"A'
    assert H.extract(page, "", ("amp",))["title"] == "a&amp&quot;&#65;"
