"""Queries over whole tables against brute force."""

import pandas as pd

from corpusmill.plans import catalog, fetching, models, quote_shop, shop  # noqa: F401 (these add their queries to the catalog)

FOLDER = "/root/testdata/sf0.001"


def test_crawl_over_all_orders(spark):
    links: dict = {}
    for o in pd.read_parquet(f"{FOLDER}/orders.parquet").itertuples():
        links.setdefault(f"c{o.o_custkey}", set()).add(f"c{(o.o_custkey * 7 + o.o_orderkey) % 1500}")
    want, level = {"c1": 0}, {"c1"}
    for depth in (1, 2, 3):
        level = set().union(*(links.get(n, set()) for n in level)) - set(want)
        want |= dict.fromkeys(level, depth)
    assert {r.node: r.depth for r in catalog.FOUND["crawl_bfs"](spark, FOLDER).collect()} == want


def test_place_of_every_quote(spark):
    part = pd.read_parquet(f"{FOLDER}/part.parquet")
    part["p"] = part.p_retailprice.astype(float).where(part.p_size % 7 != 0, 0.0).fillna(0.0)
    want = {k: i + 1 for i, k in enumerate(part.sort_values(["p", "p_partkey"]).p_partkey)}
    assert {r.p_partkey: r.place for r in catalog.FOUND["quotes_sorted"](spark, FOLDER).collect()} == want and len(want) > 50


def test_failures_of_all_services(spark):
    failed = pd.read_parquet(f"{FOLDER}/supplier.parquet").query("s_suppkey % 7 == 3").s_name
    got = catalog.FOUND["search_failures"](spark, FOLDER).collect()
    services = {"wikipedia", "brave", "serpapi", "google_cse", "naver", "searxng", "tavily"}
    assert sorted((r.provider, r.query) for r in got) == sorted((p, q) for p in services for q in failed) and len(got) > 0
    assert all(r.error.startswith(f"{r.provider} HTTP 500: ") for r in got)
