"""Markup, quotes, responses, messages and corpus folders: what the tables' pages don't reach."""

import json

from pyspark.sql import functions as F

from corpusmill.functions import product as X
from corpusmill.operators import messages as M
from corpusmill.operators import quotes
from corpusmill.sources import corpus, search
from tests.test_functions import one


def ld(*things):
    return "".join(f'<script type="application/ld+json">{t if isinstance(t, str) else json.dumps(t)}</script>' for t in things)


def test_the_richest_json_ld_product_wins():
    page = ld({"@type": "Product", "name": "few", "offers": {"price": 1}}, {"@graph": [{"x": [{"@type": ["Thing", "product"], "name": ["many", "n"], "brand": {"name": "B"}, "gtin13": 5, "offers": [{"priceSpecification": {"price": 7.5}, "highPrice": "9"}, {"price": "8"}, "odd"]}]}]})
    got = X.read(page)["json_ld"]
    assert (got["name"], got["price"], got["high_price"], got["brand"], got["sku"], len(got["offers"])) == ("many", "7.5", "9", "B", "5", 2)
    assert X.read(ld("{bad", '{"@type":"Product","name":"n",}'))["json_ld"]["name"] == "n"
    assert X.read(ld({"@type": "Article"}))["json_ld"] is None
    assert X.read(ld("[" * 5000))["json_ld"] is None


def test_microdata_and_open_graph():
    page = '<div itemtype="http://schema.org/Product"><span itemprop="name"> </span><span itemprop="name">N</span><meta itemprop="lowPrice" content="5"><link itemprop="availability" content="http://schema.org/OutOfStock"></div>'
    got = X.read(page)["microdata"]
    assert (got["name"], got["price"], got["availability"]) == ("N", "5", "OutOfStock")
    assert X.read('<div itemtype="http://schema.org/Product"><b itemprop="sku">1</b></div>')["microdata"] is None
    assert X.read('<meta property="og:title" content="T"><meta property="og:type" content="article">')["open_graph"] is None
    assert X.read('<meta property="og:title" content="T"><meta name="og:type" content="Product.item">')["open_graph"]["name"] == "T"


def test_the_labelled_price_is_read():
    price = lambda page: X.read(page)["dom_price"]
    assert price('<div><b>판매가</b><i style="display:none">256,000</i>259,000<u>원</u></div>') == 259000
    assert price("<p>래플 99% 100원</p>") is None
    assert price("<div><b>가격</b> 5,000원</div><div><b>판매가</b> 4,000원</div>") == 4000
    assert price(f"<div><b>판매가</b>{'x' * 130} 4,000원</div>") is None
    assert price("<div><b>price</b><del>9,000원</del> ₩8,000</div>") == 8000
    for odd in ("", None, "<<<", "<b>판매가</b>"):
        assert price(odd) is None


def test_page_names_and_search_forms():
    assert X.read("<title>Name of it : Shop</title>")["page_name"] == "Name of it"
    assert X.read('<meta property="og:title" content=" "><h1><b> </b>Big | Shop</h1><title>t</title>')["page_name"] == "Big"
    assert X.search_template('<form action="https://[bad"><input name=q></form>', "a.b") is None
    assert X.search_template("<form><input name=email></form>", "a.b") is None
    assert X.search_template('<form action="/f?a=1#x"><input name=q><input type=search name="s x"></form>', "a.b") == "https://a.b/f?a=1&s+x={q}"


def test_a_conflicting_model_price_gives_way(spark):
    rows = spark.createDataFrame([(259000, "256,000"), (5000, "5,000원"), (None, "7000"), (5000, None)], "dom long, model string")
    got = [tuple(r.s) for r in rows.select(X.settle(F.col("dom"), F.col("model")).alias("s")).collect()]
    assert [g[:2] for g in got] == [("259000", "llm+dom"), ("5,000원", "llm"), ("7000", "llm"), ("5000", "llm+dom")]
    assert "256000" in got[0][2] and got[3][2] is None


def test_quotes_prefer_pages_and_tell_why_sites_miss(spark):
    hits = spark.createDataFrame([("a", 1, "rx7500 5,000원", "u1", ""), ("a", 2, "row", "u2", "3,000원29%2,000원"), ("b", 1, "rx7500 9,000원", "u3", ""), ("c", 1, "t", "u4", None), ("c", 2, "t", "u5", "")], "site string, rank int, title string, url string, snippet string")
    reads = spark.createDataFrame([("u1", 4000, "dom", "Access Denied", "", ""), ("u2", None, "", "Real name", "B", "no price in the page"), ("u4", None, "", "", "", "blocked"), ("u5", None, "", "", "", "blocked")], "url string, price long, method string, name string, brand string, problem string")
    q = quotes.quotes(hits, reads)
    got = {(r.site, r["rank"]): (r.title, r.price, r.method, r.problem) for r in q.collect()}
    assert got[("a", 1)] == ("rx7500 5,000원", 4000, "dom", "")
    assert got[("a", 2)] == ("Real name", 2000, "listing", "")
    assert got[("c", 1)] == ("t", None, "", "blocked")
    sites = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "site string, pos int")
    why = {r.site: r.reason for r in quotes.misses(sites, q, F.lit("rx9600")).collect()}
    assert set(why) == {"b", "c", "d"} and "ads" in why["b"] and why["c"].endswith("none priced — blocked") and why["d"] == quotes.NO_RESULTS
    assert quotes.summary(quotes.offers(q, F.lit("rx9600")), sites).collect()[0].asDict() == {"count": 2, "min": 2000, "max": 4000, "median": 3000, "cheapest_url": "u2"}
    assert quotes.summary(q.limit(0), sites).collect() == []


def test_search_takes_the_first_provider_with_results(spark):
    rows = [("brave", "q", 500, "down", None), ("searxng", "q", 200, '{"results":[]}', None), ("bing", "q", 200, '<li class="b_algo"><h2><a href="https://A.com/x#f">T</a></h2><p>s</p></li><li class="b_algo"><h2><a href="https://a.com/x">dup</a></h2></li>', None), ("wikipedia", "q", 200, '{"query":{"search":[{"title":"W","snippet":"x"}]}}', None), ("brave", "r", 200, "not json", None), ("tavily", "q", 200, None, None)]
    responses = spark.createDataFrame(rows, "provider string, query string, status int, body string, lang string")
    order = search.provider_order(spark, ["brave", "searxng"])
    got = search.search(responses, order, 6).collect()
    assert [(r.provider, r.title, r.url, r.snippet) for r in got] == [("bing", "T", "https://A.com/x#f", "s")]
    assert search.search(responses, order, 6, include=[".notA.com"]).collect() == []
    assert search.search(responses, order, 6, exclude=["a.com"]).collect() == []
    assert search.brand_query(" q ", ["www.a.com", ".b.com"]) == "q www b"
    assert [r.error for r in search.failures(responses).collect()] == ["brave HTTP 500: down"]


def test_messages_between_the_shapes(spark):
    call = [("i", "find", '{"q":1}'), (None, "f", "bad")]
    rows = [(1, 0, "system", "S1", None, None, None), (1, 1, "user", "hi", None, None, None), (1, 2, "assistant", None, None, None, call), (1, 3, "tool", "r1", "i", None, None), (1, 4, "assistant", "", None, None, None), (1, 5, "tool", "r2", None, "f", None), (1, 6, None, None, None, None, None)]
    m = spark.createDataFrame(rows, M.MESSAGES)
    got = sorted((r.turn, r.role, [(b.type, b.text, b.id, b.input) for b in r.blocks]) for r in M.to_blocks(m).collect())
    assert got == [(1, "user", [("text", "hi", None, None)]), (2, "assistant", [("tool_use", None, "i", '{"q":1}'), ("tool_use", None, "f", "{}")]), (3, "user", [("tool_result", "r1", "i", None), ("tool_result", "r2", "f", None)]), (6, "user", [("text", "", None, None)])]
    assert M.system_of(m).first().system == "S1"
    reply = one(spark, M.from_body(F.col("b")), b='{"content":[{"type":"tool_use","name":"n","input":{"a":[1]}}]}')
    assert (reply.content, reply.tool_calls[0].arguments, reply.finish_reason) == ("", '{"a":[1]}', None)
    assert one(spark, M.from_body(F.col("b")), b="bad").content == ""


def test_replies_and_errors(spark):
    cases = {'```json\n{"a":1}\n```': '{"a":1}', 'Sure: {"a":{"b":2}} ok': '{"a":{"b":2}}', "none": None, "{bad": None, "": None}
    assert {k: M.first_object(k) for k in cases} == cases
    say = lambda b: one(spark, M.error_message(F.lit(500), F.col("b"), F.lit("")), b=b)
    assert [say(b) for b in ('{"error":{"type":"t"}}', '{"detail":"d"}', "{}", "x" * 300, None)] == ["HTTP 500: t", "HTTP 500: d", "HTTP 500: request failed", "HTTP 500: " + "x" * 200, "HTTP 500: request failed"]
    assert one(spark, M.usage_of_choices(F.col("b")), b="{}").estimated is True


def test_the_agent_loop_ends_and_survives_tools():
    replies = iter([{"content": "", "tool_calls": [{"id": "1", "name": "bad", "arguments": "{"}, {"id": "2", "name": "fly", "arguments": None}], "usage": 1}, {"content": "done", "usage": 2}])
    seen = []

    def chat(messages, tools):
        seen.append((len(messages), tuple(tools)))
        return next(replies)

    def bad(args):
        raise KeyError("k")

    out = M.run_agent("q", "s", chat, {"bad": bad}, max_steps=3)
    assert out["final"] == "done" and out["usage"] == [1, 2] and [t["error"] for t in out["trace"]] == ["KeyError: 'k'", "unknown tool: fly"] and seen == [(2, ("bad",)), (5, ("bad",))]
    forever = M.run_agent("q", "s", lambda m, t: {"content": "c", "tool_calls": [{"name": "bad"}]}, {"bad": lambda a: {}}, max_steps=2)
    assert forever["steps"] == 2 and len(forever["usage"]) == 3 and len(forever["trace"]) == 2


def test_a_corpus_folder(spark, tmp_path):
    text = "Plain words make a fine long sentence here. " * 40
    pages = spark.createDataFrame([("http://a/1", "A", text, "", 200, 1), ("http://a/1", "dup", "x", "", 200, 2), ("http://a/2", None, "", "", 200, 3), ("http://a/3", "B", None, "# **h**\n\n" + text, 200, 4), ("http://a/4", "C", text, "", 404, 5)], "url string, title string, text string, markdown string, status int, pos int").withColumn("meta", F.create_map(F.lit("host"), F.lit("a")))
    root = str(tmp_path / "c")
    counts = corpus.save(pages, root)
    assert counts["n_documents"] == 2 and counts["n_chunks"] == spark.read.json(f"{root}/chunks").count() > 2
    assert {r.url: "**h**" in r.text for r in spark.read.json(f"{root}/documents").collect()} == {"http://a/1": False, "http://a/3": True}
    assert "**" not in "".join(r.text for r in spark.read.json(f"{root}/chunks").collect())
    assert {r.name for r in spark.read.text(f"{root}/pages").select("name").distinct().collect()} == {"a_1", "a_3"}
    assert spark.read.json(f"{root}/manifest").first()["n_documents"] == 2
