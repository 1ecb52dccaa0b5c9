"""Queries of product markup, quotes, search responses and corpus sinks, over pages and responses written from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import html as H
from corpusmill.functions import product as X
from corpusmill.functions import urls as U
from corpusmill.operators import chunk, keep, quotes
from corpusmill.plans.catalog import CHUNKS, CLEAN, QUALITY, docs, query
from corpusmill.sources import corpus, search
from corpusmill.sources.tables import spread, table

WON = "floor(p_retailprice)::BIGINT"
#: A page a part: JSON-LD, microdata, Open Graph, a labelled price behind a decoy, and no price, by the key's remainder.
HTML = """concat('<html><head><title>Page of ', p_name, ' : Shop</title>', CASE pmod(p_partkey, 5)
 WHEN 0 THEN concat('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Product"],"name":"', p_name, '","brand":{"name":"', p_brand, '"},"sku":"s', p_partkey, '","offers":[{"price":"', w, '","priceCurrency":"KRW","availability":"https://schema.org/InStock"},{"lowPrice":1},]}]}</script>')
 WHEN 2 THEN concat('<meta property="og:title" content="', p_name, '"><meta property="og:type" content="product.item"><meta property="product:price:amount" content="', w, '"><meta property="og:price:currency" content="KRW">')
 ELSE '' END, '</head><body><h1>', p_name, ' | Shop</h1>', CASE pmod(p_partkey, 5)
 WHEN 1 THEN concat('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">', p_name, '</b><meta itemprop="price" content="', w, '"><i itemprop="brand">', p_brand, '</i></div>')
 WHEN 3 THEN concat('<p>래플 100원</p><div><span>판매가</span><div style="display: none">256,000</div>', format_number(w, 0), '<span>원</span></div>')
 ELSE '<p>no offer here</p>' END, '</body></html>')"""
SOURCE = "CASE p_partkey % 5 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'microdata' WHEN 2 THEN 'opengraph' END"


def shop_pages(spark, d):
    part = spread(table(spark, d, "part"), "p_partkey").withColumn("w", F.expr("cast(floor(p_retailprice) as bigint)"))
    return part.withColumn("html", F.expr(HTML)).withColumn("url", F.concat(F.lit("https://shop.example.com/p?id="), (F.col("p_partkey") + 1000).cast("string"))).drop("w")


def reads(spark, d):
    return X.with_reads(shop_pages(spark, d))


def _one(spark, d, reading, *fields):
    return reads(spark, d).where(f"read.{reading} is not null").select("p_partkey", *[F.col(f"read.{reading}.{f}").alias(f) for f in fields])


@query(f"SELECT p_partkey, p_name AS name, {WON}::VARCHAR AS price, 'KRW' AS currency, 'InStock' AS availability, p_brand AS brand, 's' || p_partkey AS sku FROM part WHERE p_partkey % 5 = 0")
def jsonld_product(spark, d):
    return _one(spark, d, "json_ld", "name", "price", "currency", "availability", "brand", "sku")


@query(f"SELECT p_partkey, 0 AS pos, {WON}::VARCHAR AS price, 'InStock' AS availability FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 1, '1', '' FROM part WHERE p_partkey % 5 = 0")
def offers_flatten(spark, d):
    return reads(spark, d).select("p_partkey", F.posexplode("read.json_ld.offers").alias("pos", "o")).select("p_partkey", "pos", "o.price", "o.availability")


@query(f"SELECT p_partkey, p_name AS name, {WON}::VARCHAR AS price, p_brand AS brand FROM part WHERE p_partkey % 5 = 1")
def microdata_product(spark, d):
    return _one(spark, d, "microdata", "name", "price", "brand")


@query(f"SELECT p_partkey, p_name AS name, {WON}::VARCHAR AS price, 'KRW' AS currency FROM part WHERE p_partkey % 5 = 2")
def opengraph_product(spark, d):
    return _one(spark, d, "open_graph", "name", "price", "currency")


@query(f"SELECT p_partkey, {SOURCE} AS source FROM part")
def structured_cascade(spark, d):
    return reads(spark, d).select("p_partkey", X.structured()["source"].alias("source"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 AND {WON} >= 100 THEN {WON} END AS price FROM part")
def price_from_dom(spark, d):
    return reads(spark, d).select("p_partkey", F.col("read.dom_price").alias("price"))


@query("SELECT p_partkey, p_name AS name FROM part")
def page_name(spark, d):
    return reads(spark, d).select("p_partkey", F.col("read.page_name").alias("name"))


@query(f"SELECT p_partkey, coalesce('structured:' || {SOURCE}, CASE p_partkey % 5 WHEN 3 THEN 'dom' ELSE 'none' END) AS method, CASE WHEN p_partkey % 5 < 4 THEN p_name END AS name, CASE WHEN p_partkey % 5 < 4 THEN {WON}::VARCHAR END AS price FROM part")
def extract_data_method(spark, d):
    return X.extracted(reads(spark, d)).select("p_partkey", "method", "name", "price")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {WON}::VARCHAR ELSE '7' END AS price, CASE WHEN p_partkey % 2 = 0 THEN 'llm' ELSE 'llm+dom' END AS method FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 7 END AS p_retailprice FROM part)")
def model_price_settled(spark, d):
    price = F.expr("cast(floor(p_retailprice) as bigint)")
    label = F.when(F.col("p_partkey") % 2 == 0, price).otherwise(F.lit(7).cast("long"))
    return table(spark, d, "part").select("p_partkey", X.settle(label, price.cast("string")).alias("s")).select("p_partkey", "s.price", "s.method")


# Quotes.
def _hits(spark, d):
    k, own = F.pmod("p_partkey", F.lit(7)), F.concat("p_name", F.lit(" rx100"))
    title = F.when(k == 0, F.lit("rx200 row 5,000원")).when(k == 1, F.lit("3,000원29%2,000원배송비 500원")).otherwise(own)
    return shop_pages(spark, d).select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("rank"), title.alias("title"), "url", F.lit("").alias("snippet"))


def _quotes(spark, d):
    return quotes.quotes(_hits(spark, d), X.priced(reads(spark, d)).select("url", "price", "method", "name", "brand", "problem"))


QUOTED = f"""(SELECT p_brand AS site, p_partkey AS rank, p_name AS title, 'https://shop.example.com/p?id=' || (p_partkey + 1000) AS url,
 CASE WHEN p_partkey % 5 < 4 THEN {WON} WHEN p_partkey % 7 = 0 THEN 5000 WHEN p_partkey % 7 = 1 THEN 2000 END::BIGINT AS price,
 coalesce({SOURCE}, CASE WHEN p_partkey % 5 = 3 THEN 'dom' WHEN p_partkey % 7 < 2 THEN 'listing' ELSE '' END) AS method FROM part)"""


@query(f"SELECT * FROM {QUOTED}")
def quote_cascade(spark, d):
    return _quotes(spark, d).select("site", "rank", "title", "url", "price", "method")


@query(f"SELECT site, rank, price FROM {QUOTED} WHERE price IS NOT NULL")
def site_quotes(spark, d):
    return quotes.offers(_quotes(spark, d), F.lit("radeon rx100")).select("site", "rank", "price")


def _sites(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("site"))
    extra = spark.range(1).select(F.lit("none.example.com").alias("site"))
    return brands.unionByName(extra).distinct()


@query(f"SELECT 'none.example.com' AS site, '{quotes.NO_RESULTS.replace(chr(39), chr(39) * 2)}' AS reason UNION ALL SELECT site, '1 page(s) found, none priced — no price in the page' FROM (SELECT p_brand || '/' || p_partkey AS site FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 7 > 1)")
def price_misses(spark, d):
    each = _quotes(spark, d).withColumn("site", F.concat("site", F.lit("/"), F.col("rank").cast("string")))
    sites = each.select("site").unionByName(spark.range(1).select(F.lit("none.example.com").alias("site")))
    return quotes.misses(sites, each, F.lit("radeon rx100"))


@query(f"SELECT site, price, url FROM {QUOTED} WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY price, rank) = 1")
def cheapest_by_site(spark, d):
    return quotes.cheapest(quotes.offers(_quotes(spark, d), F.lit("radeon rx100")))


@query(f"SELECT count(*)::BIGINT AS count, min(price) AS min, max(price) AS max, floor(median(price))::BIGINT AS median, arg_min(url, (price, site, rank)) AS cheapest_url FROM {QUOTED} WHERE price IS NOT NULL")
def find_prices(spark, d):
    sites = _sites(spark, d).select("site", F.row_number().over(quotes.Window.orderBy("site")).alias("pos"))
    return quotes.summary(quotes.offers(_quotes(spark, d), F.lit("radeon rx100")), sites)


@query("SELECT s_name AS site, q.pos AS query_pos, q.query FROM supplier, (VALUES (0, 'a b'), (1, 'c')) q(pos, query)")
def sites_cross_query(spark, d):
    return quotes.site_queries(table(spark, d, "supplier").select(F.col("s_name").alias("site")), ["a b", "c"])


@query("""SELECT site, rank, title, url FROM (SELECT 's' || p_size || '.example.com' AS site, row_number() OVER (PARTITION BY p_size ORDER BY min(p_partkey))::INT AS rank, arg_max(title, (length(title), -p_partkey)) AS title, arg_min(url, p_partkey) AS url
FROM (SELECT *, p_type || ' ' || p_name AS title, 'https://s' || p_size || '.example.com/item?pcode=' || (1000 + p_partkey % 20) || '&ref=r' || p_partkey AS url FROM part) GROUP BY p_size, p_partkey % 20) WHERE rank <= 3""")
def harvest_titles(spark, d):
    site = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit(".example.com"))
    made = table(spark, d, "part").select(
        site.alias("site"), F.concat(F.lit("https://"), site, F.lit("/find?q=x")).alias("search_url"), F.col("p_partkey").alias("pos"),
        F.concat(F.lit("https://"), site, F.lit("/item?pcode="), (1000 + F.col("p_partkey") % 20).cast("string"), F.lit("&ref=r"), F.col("p_partkey").cast("string")).alias("url"),
        F.concat(F.lit(" "), "p_type", F.lit("\n "), "p_name").alias("text"), F.lit("/item").alias("pattern"),
    )
    home = made.withColumn("url", F.concat(F.lit("https://"), "site", F.lit("/"))).withColumn("text", F.lit("a very long text of the homepage, which is no result"))
    return quotes.harvest(made.unionByName(home).unionByName(made.withColumn("url", F.col("search_url"))), 3)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'https://h' || s_suppkey || '.com/find?' || CASE WHEN s_suppkey % 3 = 0 THEN 'lang=en&stx={q}' ELSE 'q={q}' END END AS template FROM supplier")
def search_template(spark, d):
    login = '<form action="/login" method="post"><input name="id"><input type="password" name="pw"></form>'
    k = F.pmod("s_suppkey", F.lit(3))
    found = F.when(k == 0, '<form action="/find?lang=en#top" class="search"><input type="hidden" name="x"><input name="stx" id="search_inp"></form>').when(k == 1, '<form action="/find"><input name="q"></form>').otherwise('<form method="post"><input type="search" name="q"></form>')
    homes = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("site"), F.concat(F.lit(login), found).alias("html"))
    return X.with_search_template(homes).select("s_suppkey", "template")


# Search responses.
def _responses(spark, d):
    """A response of each service a supplier: a title, an address and a marked snippet; every seventh failed."""
    item = F.expr("""concat('{"title":"T ', s_name, '","url":"https://u', s_suppkey, '.com/a","link":"https://l', s_suppkey, '.com/a","snippet":"<b>s</b> &amp; x","content":"c","description":"<b>d</b> &lt;","score":0.5}')""")
    body = {"wikipedia": '{"query":{"search":[%s]}}', "brave": '{"web":{"results":[%s]}}', "serpapi": '{"organic_results":[%s]}', "google_cse": '{"items":[%s]}', "naver": '{"items":[%s]}', "searxng": '{"results":[%s]}', "tavily": '{"results":[%s]}'}
    forms = F.array(*[F.struct(F.lit(k).alias("provider"), F.concat(F.lit(v.split("%s")[0]), item, F.lit(v.split("%s")[1])).alias("body")) for k, v in body.items()])
    each = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("query"), F.explode(forms).alias("r"))
    return each.select("r.provider", "query", F.when(F.col("s_suppkey") % 7 == 3, 500).otherwise(200).alias("status"), "r.body", F.lit("ko-KR").alias("lang"))


@query("""SELECT p.provider, s_name AS query, 0 AS pos, 'T ' || s_name AS title, CASE p.provider WHEN 'wikipedia' THEN 'https://ko.wikipedia.org/wiki/T_' || s_name WHEN 'serpapi' THEN 'https://l' || s_suppkey || '.com/a' WHEN 'google_cse' THEN 'https://l' || s_suppkey || '.com/a' WHEN 'naver' THEN 'https://l' || s_suppkey || '.com/a' ELSE 'https://u' || s_suppkey || '.com/a' END AS url,
CASE p.provider WHEN 'wikipedia' THEN 's & x' WHEN 'naver' THEN 'd <' WHEN 'brave' THEN '<b>d</b> &lt;' WHEN 'serpapi' THEN '<b>s</b> &amp; x' WHEN 'google_cse' THEN '<b>s</b> &amp; x' ELSE 'c' END AS snippet, CASE WHEN p.provider = 'tavily' THEN 0.5::DOUBLE END AS score
FROM supplier, (VALUES ('wikipedia'), ('brave'), ('serpapi'), ('google_cse'), ('naver'), ('searxng'), ('tavily')) p(provider) WHERE s_suppkey % 7 <> 3""")
def search_json(spark, d):
    return search.json_results(_responses(spark, d), 5)


ITEM = """'{"title":"T ' || s_name || '","url":"https://u' || s_suppkey || '.com/a","link":"https://l' || s_suppkey || '.com/a","snippet":"<b>s</b> &amp; x","content":"c","description":"<b>d</b> &lt;","score":0.5}'"""
OPENING = {"wikipedia": '{"query":{"search":[', "brave": '{"web":{"results":[', "serpapi": '{"organic_results":[', "google_cse": '{"items":[', "naver": '{"items":[', "searxng": '{"results":[', "tavily": '{"results":['}


@query(" UNION ALL ".join(f"SELECT '{k}' AS provider, s_name AS query, '{k} HTTP 500: ' || left('{v}' || {ITEM} || '{']' + '}' * v.count('{')}', 200) AS error FROM supplier WHERE s_suppkey % 7 = 3" for k, v in OPENING.items()))
def search_failures(spark, d):
    """Of all services."""
    return search.failures(_responses(spark, d))


@query("SELECT s_name AS query, 1 AS rank, 'searxng' AS provider, 'https://u' || s_suppkey || '.com/a' AS url FROM supplier WHERE s_suppkey % 7 <> 3")
def web_search(spark, d):
    order = search.provider_order(spark, ["searxng", "brave"], ["brave"])
    return search.search(_responses(spark, d), order, 6).select("query", "rank", "provider", "url")


@query("SELECT * FROM (VALUES ('naver', 0), ('serpapi', 1), ('bing', 2), ('wikipedia', 3)) t(provider, priority)")
def provider_order(spark, d):
    return search.provider_order(spark, ["serpapi", "naver"], ["duckduckgo"])


@query(f"""SELECT p_partkey, p_name AS title, {WON} AS price_low, CASE WHEN p_size % 2 = 0 THEN {WON} + 1000 END AS price_high, {WON}::VARCHAR || '원' || CASE WHEN p_size % 2 = 0 THEN ' · ~ ' || format('{{:,}}', {WON} + 1000) || '원' ELSE '' END || ' · M&M' AS snippet, p_brand || ' > ' || p_type AS category FROM part""")
def shop_results(spark, d):
    body = F.expr("""concat('{"items":[{"title":"<b>', p_name, '</b>","link":"https://x/', p_partkey, '","lprice":"', cast(floor(p_retailprice) as bigint), '","hprice":"', if(p_size % 2 = 0, cast(floor(p_retailprice) as bigint) + 1000, 0), '","mallName":"M&amp;M","category1":"', p_brand, '","category2":"', p_type, '","category3":""}]}')""")
    responses = table(spark, d, "part").select(F.lit("naver_shop").alias("provider"), F.col("p_partkey").alias("query"), F.lit(200).alias("status"), body.alias("body"))
    return search.shop_results(responses, 5).select(F.col("query").alias("p_partkey"), "title", "price_low", "price_high", "snippet", "category")


@query("""SELECT provider, s_name AS query, 0 AS pos, 'T & ' || s_name AS title, 'https://u' || s_suppkey || '.com/?a=1' AS url, 'snippet of it' AS snippet FROM supplier, (VALUES ('bing'), ('duckduckgo')) p(provider)""")
def search_pages(spark, d):
    name, target = F.col("s_name"), F.concat(F.lit("https://u"), F.col("s_suppkey").cast("string"), F.lit(".com/?a=1"))
    code = F.translate(F.regexp_replace(F.base64(F.encode(target, "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    bing = F.concat(F.lit('<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?x=1&amp;u=a1'), code, F.lit('">T &amp; '), name, F.lit('</a></h2><div class="b_caption"><p> snippet of it</p></div></li><li class="b_algo">no link</li></ol>'))
    duck = F.concat(F.lit('<div class="result"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(target), F.lit('&amp;rut=1">T &amp; '), name, F.lit('</a></h2><a class="result__snippet">snippet of it</a></div><div class="result"><a class="result__a" href="/relative">x</a></div>'))
    both = F.array(F.struct(F.lit("bing").alias("provider"), bing.alias("body")), F.struct(F.lit("duckduckgo").alias("provider"), duck.alias("body")))
    responses = table(spark, d, "supplier").select(name.alias("query"), F.explode(both).alias("r")).select("r.provider", "query", F.lit(200).alias("status"), "r.body")
    return search.page_results(responses, 5).drop("score")


# Crawl results, recovery and corpus.
@query("SELECT r.page_id, coalesce(p.url, '') AS opened, CASE WHEN p.url IS NULL THEN 0 ELSE 200 END AS status FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/gone' END AS url FROM pages) r LEFT JOIN pages p USING (url)")
def results_with_docs(spark, d):
    pages = table(spark, d, "pages")
    hits = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/gone"))).alias("url"))
    fetched = pages.select("url", F.lit(200).alias("s"))
    return hits.join(fetched, "url", "left").select("page_id", F.when(F.col("s").isNotNull(), F.col("url")).otherwise("").alias("opened"), F.coalesce("s", F.lit(0)).alias("status"))


@query("SELECT url, min(pos)::BIGINT AS pos FROM (SELECT url, page_id AS pos FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 1000000 + page_id FROM pages) GROUP BY url")
def seed_union(spark, d):
    pages = table(spark, d, "pages").select("url", F.col("page_id").alias("pos"))
    both = pages.where("pos % 3 = 0").unionByName(pages.select("url", (F.col("pos") + 1000000).alias("pos")))
    return keep.keep_first(both, ["url"], "pos")


@query("SELECT user_id::VARCHAR AS url, 'c' || event_id AS opened FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id) = 1")
def recover_best(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("opened"), (F.col("event_id") % 4).alias("preference"), F.col("event_id").alias("pos"), (F.col("event_id") % 3 == 0).alias("ok"))
    return keep.keep_first(c.where("ok"), ["url"], "preference", "pos").select("url", "opened")


def _snapshot(spark, d):
    doc = docs(spark, d)
    return doc.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), "text", F.lit("").alias("markdown"), F.lit(200).alias("status"), F.create_map(F.lit("host"), "source").alias("meta"), F.col("doc_id").alias("pos"))


@query(f"SELECT 'doc://' || doc_id AS url, source AS title, source AS host, t AS text, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count FROM {CLEAN} JOIN (SELECT doc_id, source FROM documents WHERE text <> '') USING (doc_id)")
def corpus_documents(spark, d):
    return corpus.documents(corpus.admitted(_snapshot(spark, d))).drop("meta")


@query("SELECT 'doc_' || doc_id AS name, '# ' || source || chr(10) || chr(10) || '> source: doc://' || doc_id || chr(10) || chr(10) || text AS value FROM documents WHERE text <> ''")
def corpus_pages(spark, d):
    return corpus.markdown_files(corpus.admitted(_snapshot(spark, d)))


@query(f"SELECT 'doc://' || doc_id AS url, coalesce(n, 0)::BIGINT AS n_chunks FROM documents LEFT JOIN (SELECT doc_id, len(chunks) AS n FROM {CHUNKS(CLEAN)} WHERE {QUALITY('t')} >= 0.25) USING (doc_id)")
def build_rag(spark, d):
    """Chunks a seed page, pages without any included."""
    snap = _snapshot(spark, d)
    n = chunk.chunk_records(snap.select("url", "title", "text")).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    return snap.select("url").join(n, "url", "left").select("url", F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"))


@query("""SELECT s_name AS query, 1 AS rank, 'https://shop.example.com/' || s_suppkey AS url, s_suppkey % 3 = 1 AS again FROM supplier WHERE s_suppkey % 3 < 2""")
def search_twice(spark, d):
    """Searches within a domain: a third of the queries find it at once, a third when asked with its brand word, a third never."""
    k = F.col("s_suppkey")
    item = lambda host: F.concat(F.lit('{"web":{"results":[{"title":"t","url":"https://'), host, F.lit("/"), k.cast("string"), F.lit('","description":"d"}]}}'))
    tries = F.array(
        F.struct(F.col("s_name").alias("query"), item(F.when(k % 3 == 0, "shop.example.com").otherwise("other.org")).alias("body")),
        F.struct(F.concat("s_name", F.lit(" example")).alias("query"), item(F.when(k % 3 == 1, "shop.example.com").otherwise("notexample.com")).alias("body")),
    )
    responses = table(spark, d, "supplier").select(F.explode(tries).alias("t")).select(F.lit("brave").alias("provider"), "t.query", F.lit(200).alias("status"), "t.body", F.lit("en").alias("lang"))
    queries = table(spark, d, "supplier").select(F.col("s_name").alias("query"))
    found = search.search_twice(queries, responses, search.provider_order(spark, ["brave"]), 5, ["example.com"])
    own = table(spark, d, "supplier").select(F.col("s_name").alias("query"), (k % 3 == 1).alias("again"))
    return found.join(own, "query").select("query", "rank", "url", "again")


@query("SELECT 'bing' AS provider, s_name AS query, 'bing returned a consent/CAPTCHA page (no results parsed)' AS error FROM supplier WHERE s_suppkey % 4 = 1")
def search_blocked(spark, d):
    """Of result pages with results, walls, pages with results that speak of walls, and pages with neither, the walls."""
    k = F.col("s_suppkey") % 4
    hit = '<ol><li class="b_algo"><h2><a href="https://x.org/1">t</a></h2></li></ol>'
    body = F.when(k == 0, hit).when(k == 1, "<p>Please VERIFY you are human, then go on.</p>").when(k == 2, hit + "<p>How a captcha works</p>").otherwise("<p>nothing was found</p>")
    return search.blocked_pages(table(spark, d, "supplier").select(F.lit("bing").alias("provider"), F.col("s_name").alias("query"), F.lit(200).alias("status"), body.alias("body")))
