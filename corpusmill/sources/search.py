"""Search responses as rows: JSON bodies of search services, result pages, provider order and fallback.

A response table has provider, query, status, body and lang (of the encyclopedia); rows of results are provider, query, pos,
title, url, snippet, score. Requests themselves are out of scope: a connector writes the response table.
"""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import urls as U
from corpusmill.functions.html import Node, tree
from corpusmill.operators import keep

# Where each service keeps its results and their fields, and the order of services (those with a key first).
BODIES = {
    "wikipedia": ("$.query.search", "title", None, "snippet"),
    "searxng": ("$.results", "title", "url", "content"),
    "brave": ("$.web.results", "title", "url", "description"),
    "tavily": ("$.results", "title", "url", "content"),
    "serpapi": ("$.organic_results", "title", "link", "snippet"),
    "google_cse": ("$.items", "title", "link", "snippet"),
    "naver": ("$.items", "title", "link", "description"),
}
ORDER = ["naver", "brave", "serpapi", "google_cse", "searxng", "bing", "duckduckgo", "wikipedia"]
KEYLESS = ["bing", "duckduckgo", "wikipedia"]
GOOGLE_CAP, NAVER_CAP = 10, 100
ITEM = "array<struct<title:string,url:string,link:string,snippet:string,content:string,description:string,score:double>>"
SHOP_ITEM = "array<struct<title:string,link:string,lprice:string,hprice:string,mallName:string,productId:string,brand:string,maker:string,image:string,category1:string,category2:string,category3:string,category4:string>>"


def provider_order(spark: SparkSession, with_keys: list[str] = (), disabled: list[str] = ()) -> DataFrame:
    """(provider, priority) of services in the order they are tried: keyed ones only where a key is set, none that is disabled."""
    names = [n for n in ORDER if (n in KEYLESS or n in with_keys) and n not in disabled]
    return spark.createDataFrame(list(enumerate(names)), "priority int, provider string").select("provider", "priority")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(lambda t: _html.unescape(t) if isinstance(t, str) else None)


def service_text(c: Column) -> Column:
    """Text of a service: tags out, references decoded, trimmed; null is empty."""
    return F.trim(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")))


def failures(responses: DataFrame) -> DataFrame:
    """(provider, query, error) of responses of status 400 and above, with 200 characters of the body."""
    told = F.concat(F.col("provider"), F.lit(" HTTP "), F.col("status").cast("string"), F.lit(": "), F.left(F.coalesce("body", F.lit("")), F.lit(200)))
    return responses.where("status >= 400").select("provider", "query", told.alias("error"))


def json_results(responses: DataFrame, n: int) -> DataFrame:
    """Results of JSON bodies, n a response at most; bad bodies, failures and other providers have none."""
    good = responses.where(F.col("provider").isin(*BODIES) & (F.coalesce("status", F.lit(200)) < 400))
    part = F.coalesce(*[F.when(F.col("provider") == p, F.get_json_object("body", v[0])) for p, v in BODIES.items()])
    cap = F.when(F.col("provider") == "google_cse", min(n, GOOGLE_CAP)).when(F.col("provider") == "naver", max(1, min(n, NAVER_CAP))).otherwise(n)
    each = good.select("provider", "query", "lang", F.posexplode(F.slice(F.from_json(part, ITEM), F.lit(1), cap)).alias("pos", "i"))
    field = lambda at: F.coalesce(*[F.when(F.col("provider") == p, F.col(f"i.{v[at]}")) for p, v in BODIES.items() if v[at]], F.lit(""))
    wiki, marked = F.col("provider") == "wikipedia", F.col("provider").isin("wikipedia", "naver")
    lang = F.lower(F.split_part(F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")), F.lit("-"), F.lit(1)))
    page = F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace("i.title", F.lit(" "), F.lit("_")))
    made = each.select(
        "provider", "query", "pos", field(1).alias("title"), F.when(wiki, page).otherwise(field(2)).alias("url"), field(3).alias("snippet"),
        F.when(F.col("provider") == "tavily", F.col("i.score")).alias("score"), marked.alias("__marked"), wiki.alias("__wiki"),
    )
    made = made.withColumn("__t", service_text(F.col("title"))).withColumn("__s", service_text(F.col("snippet")))
    title = F.when(F.col("__marked") & ~F.col("__wiki"), F.col("__t")).otherwise(F.col("title"))
    return made.select("provider", "query", "pos", title.alias("title"), "url", F.when(F.col("__marked"), F.col("__s")).otherwise(F.col("snippet")).alias("snippet"), "score")


def shop_results(responses: DataFrame, n: int) -> DataFrame:
    """Offers of the shopping service: prices as numbers ("0" is not told), mall, product, category path, and a snippet of them."""
    each = responses.where((F.col("provider") == "naver_shop") & (F.coalesce("status", F.lit(200)) < 400)).select("query", F.posexplode(F.slice(F.from_json(F.get_json_object("body", "$.items"), SHOP_ITEM), 1, n)).alias("pos", "i"))
    won = lambda c: F.nullif(F.trim(F.col(c)).try_cast("long"), F.lit(0).cast("long"))
    texts = {"title": "title", "mall": "mallName", "brand": "brand", "maker": "maker", **{f"c{k}": f"category{k}" for k in range(1, 5)}}
    out = each.select("query", "pos", F.col("i.link").alias("url"), won("i.lprice").alias("price_low"), won("i.hprice").alias("price_high"), F.coalesce("i.productId", F.lit("")).alias("product_id"), F.coalesce("i.image", F.lit("")).alias("image"), *[service_text(F.col(f"i.{v}")).alias(k) for k, v in texts.items()])
    some = lambda c: F.nullif(c, F.lit(""))
    money = lambda c: F.concat(F.format_number(c, 0), F.lit("원"))
    low, high = F.col("price_low"), F.col("price_high")
    snippet = F.concat_ws(" · ", F.coalesce(money(low), F.lit("가격 미표시")), F.when(~high.eqNullSafe(low), F.concat(F.lit("~ "), money(high))), some(F.col("mall")))
    path = F.concat_ws(" > ", *[some(F.col(f"c{k}")) for k in range(1, 5)])
    return out.select("query", "pos", "title", "url", snippet.alias("snippet"), "price_low", "price_high", "mall", "product_id", "brand", "maker", "image", path.alias("category"))


def _has(n: Node, name: str) -> bool:
    return name in n.attrs.get("class", "")


def _text_of(nodes: Iterator[Node]) -> str:
    return next((n.text().strip() for n in nodes), "")


def _bing(root: Node) -> Iterator[tuple[str, str, str]]:
    for item in root.walk():
        if item.tag == "li" and _has(item, "b_algo"):
            link = next((a for h in item.walk() if h.tag == "h2" for a in h.children if isinstance(a, Node) and a.tag == "a"), None)
            if link is not None:
                captions = [p for c in item.walk() if c.tag == "div" and _has(c, "b_caption") for p in c.walk() if p.tag == "p"]
                yield link.text().strip(), link.attrs.get("href", ""), _text_of(iter(captions or [p for p in item.walk() if p.tag == "p"]))


def _duckduckgo(root: Node) -> Iterator[tuple[str, str, str]]:
    for link in root.walk():
        if link.tag == "a" and _has(link, "result__a"):
            box, top = link.parent, None
            while box is not None:
                top, box = (box if box.tag == "div" and _has(box, "result") else top), box.parent
            yield link.text().strip(), link.attrs.get("href", ""), _text_of(a for a in (top.walk() if top else ()) if a.tag == "a" and _has(a, "result__snippet"))


PARSERS = {"bing": _bing, "duckduckgo": _duckduckgo}


def page_results(responses: DataFrame, n: int) -> DataFrame:
    """Results of result pages (bing, duckduckgo) with their wrapped addresses decoded, n a page at most."""

    @F.pandas_udf("array<struct<title:string,href:string,snippet:string>>")
    def run(providers: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("title", "href", "snippet"), x)) for x in PARSERS[p](tree(b or ""))] for p, b in zip(providers, bodies)], dtype=object)

    pages = responses.where(F.col("provider").isin(*PARSERS) & (F.coalesce("status", F.lit(200)) < 400))
    each = pages.select("provider", "query", F.posexplode(run("provider", "body")).alias("at", "i"))
    url = F.when(F.col("provider") == "bing", F.when(F.col("i.href").contains("bing.com/ck/a"), U.decode_bing(F.col("i.href"))).otherwise(F.col("i.href"))).otherwise(U.decode_uddg(F.col("i.href")))
    rows = each.select("provider", "query", "at", F.col("i.title").alias("title"), url.alias("url"), F.col("i.snippet").alias("snippet")).where((F.col("provider") == "bing") | F.col("url").startswith("http"))
    place = F.row_number().over(Window.partitionBy("provider", "query").orderBy("at")) - 1
    return rows.withColumn("pos", place).where(F.col("pos") < n).select("provider", "query", "pos", "title", "url", "snippet", F.lit(None).cast("double").alias("score"))


def search(responses: DataFrame, order: DataFrame, n: int, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The results of each query: those of the first provider in order with any, without repeats, in and out of domains, n at most.

    Repeated (provider, query) responses count as one page each by position. An empty result of a domain search is the
    caller's cue to ask again with ``brand_query``.
    """
    fetch = max(20, 4 * n) if include else n
    found = json_results(responses, fetch).unionByName(page_results(responses, fetch)).join(F.broadcast(order), "provider")
    first = found.groupBy("query").agg(F.min("priority").alias("priority"))
    used = found.join(first, ["query", "priority"])
    real = used.where(F.col("url").startswith("http"))
    one = keep.keep_first(real.withColumn("__key", U.normalize_url(F.col("url"))), ["query", "__key"], "pos", "url").drop("__key")
    hosted = one.withColumn("__host", U.host(F.col("url")))
    clean = lambda names: [x.lower().lstrip(".") for x in names]
    if include:
        hosted = keep.domain_filter(hosted, "__host", clean(include), True)
    if exclude:
        hosted = keep.domain_filter(hosted, "__host", clean(exclude), False)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("pos", "url"))
    return hosted.withColumn("rank", rank).where(F.col("rank") <= n).select("query", "rank", "provider", "title", "url", "snippet", "score")


def brand_query(query: str, include: list[str]) -> str:
    """The query with the first label of each domain, for the second try of a domain search that found nothing."""
    return " ".join([query.strip(), *[d.lstrip(".").split(".")[0] for d in include]])


def brand_queries(queries: DataFrame, include: list[str]) -> DataFrame:
    """queries (query) with ``again``: the query that a second try asks, as ``brand_query`` makes it."""
    return queries.select("query", F.concat_ws(" ", F.trim("query"), *[F.lit(d.lstrip(".").split(".")[0]) for d in include]).alias("again"))


def search_twice(queries: DataFrame, responses: DataFrame, order: DataFrame, n: int, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """``search`` within domains for a table of queries (query); those that find nothing are asked again with the domains' brand words.

    responses has those of both tries, each under the query that was asked; what the second try finds stands under the first query. Blank queries find nothing.
    """
    asked = brand_queries(queries.where(F.trim("query") != "").distinct(), include)
    one = lambda c: responses.join(asked.select(F.col(c).alias("query")).distinct(), "query", "left_semi")
    first = search(one("query"), order, n, include, exclude)
    empty = asked.join(first.select("query").distinct(), "query", "left_anti").select(F.col("query").alias("__first"), F.col("again").alias("query"))
    second = search(one("again"), order, n, include, exclude).join(empty, "query").withColumn("query", F.col("__first")).select(first.columns)
    return first.unionByName(second)


# What a result page says that is a consent wall or a bot check, and how much of it is looked at.
BLOCK_MARKERS = ("captcha", "unusual traffic", "verify you are human", "are you a robot", "consent.bing", "/tou/", "before you continue")
BLOCK_PREFIX = 20_000


def blocked_pages(responses: DataFrame) -> DataFrame:
    """(provider, query, error) of result pages that have no results and say that they are a wall. A page with results is none, whatever it says."""
    head = F.lower(F.left(F.coalesce("body", F.lit("")), F.lit(BLOCK_PREFIX)))
    wall = F.lit(False)
    for marker in BLOCK_MARKERS:
        wall = wall | head.contains(marker)
    pages = responses.where((F.col("provider") == "bing") & (F.coalesce("status", F.lit(200)) < 400) & wall)
    with_results = page_results(pages, 1).select("provider", "query").distinct()
    return pages.join(with_results, ["provider", "query"], "left_anti").select("provider", "query", F.concat("provider", F.lit(" returned a consent/CAPTCHA page (no results parsed)")).alias("error"))
