"""Fetching where the driver's tables don't reach: robots files, cache and crawl edges, odd responses, the quote shop."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import quote_shop as Q
from corpusmill.operators import fetching as E
from corpusmill.operators import policy, usage
from corpusmill.sources import tables

RULES = "host string, status int, body string"


def verdicts(spark, body, agent, paths, status=200):
    files = spark.createDataFrame([("h", status, body)], RULES)
    urls = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    return {r.path: r.allowed for r in E.robots_verdict(urls, E.robots_rules(files), agent).collect()}


def test_robots_files(spark):
    body = "# a\r\nUser-Agent: one\nUser-agent: Two\nDisallow: /x # y\nallow: /\nSitemap: s\n\nAllow: /x\nUser-agent: *\nDisallow: /x/y\nCrawl-delay: 7"
    assert verdicts(spark, body, "Two/2.0 (+u)", ["/x", "/x/y", "/z"]) == {"/x": False, "/x/y": False, "/z": True}
    assert verdicts(spark, body, "three", ["/x", "/x/y", None]) == {"/x": True, "/x/y": False, None: True}
    assert verdicts(spark, body, "three", ["/x/y"], 404) == {"/x/y": True} and verdicts(spark, None, "a", ["/"], None) == {"/": True}
    assert verdicts(spark, "Disallow: /", "a", ["/"]) == {"/": True} and verdicts(spark, "", "a", ["/"]) == {"/": True}
    files = spark.createDataFrame([("h", 200, body)], RULES)
    assert [(r.agents, r.delay, len(r.rules)) for r in E.robots_rules(files).orderBy("group").collect()] == [(["one", "two"], None, 2), (["*"], 7, 1)]
    assert E.robots_rules(files.where("false")).count() == 0


def test_crawls_stay_within_their_bounds(spark):
    links = spark.createDataFrame([("http://a/", 1, "http://a/1"), ("http://a/", 2, "http://www.a/2/"), ("http://a/", 3, "http://a/1/"), ("http://a/", 4, "http://b/"), ("http://a/", 5, None), ("http://a/1", 1, "http://a/"), ("http://a/1", 2, "http://a/3"), ("http://www.a/2/", 1, "http://a/4")], "src string, pos int, dst string")
    pages = spark.createDataFrame([(u, u != "http://www.a/2/") for u in ("http://a/", "http://a/1", "http://www.a/2/", "http://a/3")], "url string, ok boolean")
    crawl = lambda **k: [r.url for r in E.crawl_pages("http://a/", pages, links, **k).orderBy("place").collect()]
    assert crawl(depth=0) == ["http://a/"] and crawl() == ["http://a/", "http://a/1", "http://www.a/2/"]
    assert crawl(depth=3) == ["http://a/", "http://a/1", "http://www.a/2/", "http://a/3"]  # the broken page leads nowhere
    assert crawl(depth=3, max_pages=2) == ["http://a/", "http://a/1"] and crawl(max_pages=0) == []
    assert crawl(same_site=False) == ["http://a/", "http://a/1", "http://www.a/2/", "http://b/"] and crawl(domains=[".b"]) == ["http://a/", "http://b/"]
    assert [r.url for r in E.crawl_pages("http://a/", pages, links.where("false")).collect()] == ["http://a/"]


def test_cache(spark):
    rows = [("k", "u", 200, 10.0, "old"), ("k", "u", 200, 20.0, "new"), ("k", "u", 500, 30.0, "bad"), ("l", "u", 200, 5.0, None)]
    answers = spark.createDataFrame(rows, "key string, url string, status int, stored_at double, content string")
    cache = E.cache_put(answers.limit(0), answers)
    asked = spark.createDataFrame([("k", 1), ("l", 2), ("m", 3)], "key string, content int")
    got = lambda now, ttl: sorted((r.key, r.cached, r[3]) for r in E.cache_get(asked, cache, F.lit(now), ttl).collect())
    assert got(25.0, 10) == [("k", True, "new"), ("l", False, None), ("m", False, None)] and [c for _, c, _ in got(1e9, 0)] == [True, True, False]
    sized = spark.createDataFrame([(str(i), float(i * 1000), 10) for i in range(20)], "key string, stored_at double, size int")
    assert sorted(int(r.key) for r in E.cache_kept(sized, 75).collect()) == list(range(13, 20)) and E.cache_kept(sized, 0).count() == 0
    assert E.cache_kept(sized, 1000).count() == 20 and E.cache_kept(sized.where("false"), 5).count() == 0
    key = lambda m: spark.range(1).select(E.cache_key(F.lit("e"), F.lit("u"), m).alias("k")).first()["k"]
    ab = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert key(ab) == key(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))) != key(F.lit(None))


def test_bytes_of_any_charset(spark):
    page = '<html><head><meta http-equiv="x" content="text/html; charset=euc-kr"></head><body>가격</body></html>'
    rows = [(1, page.encode("euc-kr"), None), (2, "가격".encode("shift-jis", "replace"), "utf-8"), (3, "ä".encode("latin-1"), "iso-8859-1"), (4, b"\xff<p>", None), (5, None, None), (6, b"x", "no-such")]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, body binary, c string").select("k", E.body_text("body", "c").alias("t")).collect()}
    assert got[1] == page and got[3] == "ä" and got[4] == "�<p>" and got[5] is None and got[6] == "x"
    responses = spark.createDataFrame([("u", 200, None, b"<title>T</title><p>some words</p>", None, 1), ("v", None, "Application/PDF", b"x", None, 1), ("w", 503, "text/html", None, None, 1), ("u", 200, "text/plain", None, None, 1)], "url string, status int, header string, body binary, error string, text int")
    rows = [(r.url, r.status, r.title, r.words, r.error) for r in E.documents_of(responses).orderBy("url", "content_type").collect()]
    assert rows == [("u", 200, "T", 2, None), ("u", 200, "", 0, None), ("v", 0, "", 0, "unsupported content-type: application/pdf"), ("w", 503, "", 0, "HTTP 503")]
    assert E.documents_of(responses.where("false")).count() == 0


def test_ladders(spark):
    names = lambda df: [r.engine for r in df.collect()]
    assert names(E.ladder(spark, policy.ENGINES)) == ["static", "scrapling", "chrome"] and names(E.escalation_targets(spark, policy.ENGINES, "dynamic")) == []
    with pytest.raises(ValueError):
        E.ladder(spark, policy.ENGINES, "none")


def test_quote_shop_pages(spark):
    empty = {"model": "", "tel": "", "delivery": "", "quote_time": "", "base_low": 0, "base_high": 0, "groups": []}
    assert Q.read_product(None) == empty and Q.read_product("<div class=total_price>9,999</div>") == empty
    pages = spark.createDataFrame([(1, None), (2, "<p>")], "k int, html string")
    assert {r.m.split("\n")[0] for r in Q.with_product(pages).select(Q.markdown().alias("m")).collect()} == {f"# {Q.NAMELESS}"}
    menu = '<a href="server_list.php?c=1">A</a><a href="server_list.php?c=1">again</a><a href="server_list.php">no query</a><p class="tit"><a href="/server_list.php?c=2">B</a></p>'
    assert [(x["label"], x["key"]) for x in Q.read_menu(menu, "https://s/")] == [("A", "c=1"), ("B", "c=2")]
    cats = spark.createDataFrame([(0, "alpha", "u1"), (1, "beta", "u2")], "pos int, label string, url string")
    lists = spark.createDataFrame([("u1", [])], f"url string, links {Q.LINKS}")
    none = Q.with_product(pages.where("false")).select(F.lit("x").alias("url"), "product")
    assert [(r.rank, r.title, r.snippet) for r in Q.search(cats, lists, none, "alpha", 3).collect()] == [(1, "alpha", Q.NO_LIST_PRODUCTS)]
    assert Q.search(cats, lists, none, "gamma", 3).count() == 0 and Q.search(cats, lists, none, "  ", 3).count() == 0


def test_usage_logs(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert usage.read_log(spark, path).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"event_id":1,"provider":"p","model":"m","prompt_tokens":2}\nnot json\n{"event_id":2}\n')
    assert [r.event_id for r in usage.read_log(spark, path).collect()] == [1]
    usage.export_pricing(usage.pricing(spark), f"{tmp_path}/prices")
    assert sorted(map(tuple, usage.read_pricing(spark, f"{tmp_path}/prices").collect()), key=str) == sorted(usage.PRICING, key=str)
    log = usage.read_log(spark, path)
    assert usage.reset(log, "session").count() == 1 and usage.reset(log, "all").count() == 0
    with pytest.raises(ValueError):
        usage.reset(log, "other")


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.shared_dir(Session)
