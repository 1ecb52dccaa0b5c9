"""Every query with SQL against DuckDB on the smallest tables, and the plans of hot operators."""

import glob
import os

import duckdb
import pytest

from corpusmill.plans import catalog, fetching, lookups, models, quote_shop, shop, streams  # noqa: F401 (these add their queries to the catalog)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(records):
    show = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    df = catalog.FOUND[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.SQL[name]})")
    got = rows(map(tuple, df.select(*columns).collect()))
    assert got == rows(want.fetchall()) and got, "two empty results prove nothing"


@pytest.mark.parametrize("name", ["tokenize", "bm25_rank", "chunk_text", "clean_documents", "canon_url", "price_from_listing", "throttle_schedule"])
def test_stays_in_the_jvm(spark, name):
    plan = catalog.FOUND[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
