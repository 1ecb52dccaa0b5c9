"""Queries of the quote shop, of usage scopes and of lookups, over pages written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import quote_shop as Q
from corpusmill.operators import policy, quotes, usage
from corpusmill.plans.catalog import BM25, COSTED, SUMS, _costed, query
from corpusmill.sources.tables import spread, table

WON = "floor(p_retailprice)::BIGINT"
MONEY = lambda x: f"format('{{:,}}', ({x})::BIGINT)"


def _product_pages(spark, d):
    """A product page a part: a base price (none for every sixth), two groups of options, times for every second."""
    k, won = F.col("p_partkey"), F.floor("p_retailprice").cast("string")
    money = F.format_number(F.floor("p_retailprice"), 0)
    group = lambda name, attrs, *options: F.concat(F.lit(f'<div class="x group_component" {attrs}><div class="name">{name}</div>'), *options, F.lit("</div>"))
    option = lambda name, low, high: F.concat(F.lit('<label><input type="radio" data-idx="1"><span class="agree_txt">x  '), name, F.lit('</span><b class="pay_start">'), low, F.lit('</b><b class="pay_top">'), high, F.lit("</b></label>"))
    html = F.concat(
        F.lit('<div class="r_box_fixed on"><div class="title"> '), "p_name", F.lit(' </div></div><div class="tel"><i class="num">02-'), k.cast("string"), F.lit("</i></div>"),
        F.when(k % 6 != 0, F.concat(F.lit('<span class="price_system_start">'), money, F.lit('원</span><span class="a price_system_top">'), F.format_number(F.floor("p_retailprice") + k % 2, 0), F.lit("</span>"))).otherwise('<span class="price_system_start_not">5</span>'),
        F.when(k % 2 == 0, "<dl><dt>예상딜리버리 :</dt><dd>3 일</dd><dt>Other</dt><dd>x</dd></dl>").otherwise(""), F.lit('<span class="total_price">9,999,999</span>'),
        group("CPU", 'data-required="y" data-max="2"', option(F.lit("one"), F.lit("1,000"), F.lit("1,000")), option(F.lit("two"), won, F.lit("9,000,000"))),
        group("GPU", 'data-max="0"', option(F.lit("none"), F.lit(""), F.lit(""))), group("empty", ""),
    )
    url = F.concat(F.lit("https://itmaya.co.kr/server_view.php?idx="), k.cast("string"))
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey").select("p_partkey", url.alias("url"), html.alias("html"))


def _products(spark, d):
    return Q.with_product(_product_pages(spark, d))


RANGE = f"(CASE WHEN p_partkey % 2 = 1 THEN {MONEY(WON)} || '~' || {MONEY(WON + ' + 1')} ELSE {MONEY(WON)} END || '원')"


@query("SELECT p_partkey, trim(p_name) AS model, '02-' || p_partkey AS tel, CASE WHEN p_partkey % 2 = 0 THEN '3 일' ELSE '' END AS delivery, " f"CASE WHEN p_partkey % 6 <> 0 THEN {WON} ELSE 0 END AS base_low, CASE WHEN p_partkey % 6 <> 0 THEN {WON} + p_partkey % 2 ELSE 0 END::BIGINT AS base_high, 2 AS groups FROM part")
def quote_products(spark, d):
    return _products(spark, d).select("p_partkey", "product.model", "product.tel", "product.delivery", "product.base_low", "product.base_high", F.size("product.groups").alias("groups"))


@query(f"SELECT p_partkey, part, option, low, high FROM (SELECT p_partkey, 'CPU' AS part, 'one' AS option, 1000::BIGINT AS low, 1000::BIGINT AS high FROM part UNION ALL SELECT p_partkey, 'CPU', 'two', {WON}, 9000000 FROM part UNION ALL SELECT p_partkey, 'GPU', 'none', 0, 0 FROM part)")
def component_prices(spark, d):
    return Q.parts_of(_products(spark, d).select("p_partkey", "product"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '구성별 견적 ({Q.CAVEAT})' ELSE '시스템 기본가 ' || {RANGE} || '~ (구성요소 추가 시 합산, {Q.CAVEAT})' END AS note FROM part")
def price_note(spark, d):
    return _products(spark, d).select("p_partkey", Q.price_note().alias("note"))


TIMES = "CASE WHEN p_partkey % 2 = 0 THEN '{a}예상딜리버리:{b} 3 일{c}' ELSE '' END"


@query(f"""SELECT p_partkey, '# ' || trim(p_name) || chr(10) || chr(10) || CASE WHEN p_partkey % 6 = 0 THEN '**가격:** 구성별 견적 — {Q.CAVEAT}' ELSE '**시스템 기본가:** ' || {RANGE} || '  ({Q.CAVEAT})' END || chr(10) || '**견적 문의:** 02-' || p_partkey || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN '**예상딜리버리:** 3 일' || chr(10) ELSE '' END || chr(10) || '## 구성요소별 가격 (기본가에 합산)' || chr(10) || '### CPU (필수, 최대 2개)' || chr(10) || '- one: 1,000원' || chr(10) || '- two: ' || {MONEY(WON)} || '~9,000,000원' || chr(10) || '### GPU' || chr(10) || '- none: 가격문의' AS markdown,
3 + (p_partkey % 2 = 0)::INT AS passages, 'CPU 가격: one 1,000원; two ' || {MONEY(WON)} || '~9,000,000원' AS cpu FROM part""")
def quote_markdown(spark, d):
    return _products(spark, d).select("p_partkey", Q.markdown().alias("markdown"), F.size(Q.passages()).alias("passages"), F.element_at(Q.passages(), -2).alias("cpu"))


@query("SELECT s_suppkey, host, s_suppkey % 4 IN (0, 2) AS adapter FROM (SELECT s_suppkey, ['www.itmaya.co.kr', 'notitmaya.co.kr', 'Shop.ITMAYA.com', 'itmaya.co.kr.example.org'][s_suppkey % 4 + 1] AS host FROM supplier)")
def adapter_route(spark, d):
    names = F.array(*map(F.lit, ("www.itmaya.co.kr", "notitmaya.co.kr", "Shop.ITMAYA.com", "itmaya.co.kr.example.org")))
    hosts = table(spark, d, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 4).cast("int")).alias("host"))
    return hosts.select("s_suppkey", "host", Q.handles(F.col("host")).alias("adapter"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE (s_suppkey || '6910')::BIGINT END AS won, 'n ' || s_suppkey AS label FROM supplier")
def glued_amount(spark, d):
    text = F.when(F.col("s_suppkey") % 3 == 0, "견적 문의").otherwise(F.concat(F.lit("총 "), F.col("s_suppkey").cast("string"), F.lit(",6 910원")))
    return table(spark, d, "supplier").select("s_suppkey", Q.amount(text).alias("won"), Q.label(F.concat(F.lit(" n \n"), F.col("s_suppkey").cast("string"), F.lit(" ：· :"))).alias("label"))


LABELS = "(SELECT p_partkey, p_name AS text FROM part)"
SHOP_QUERY = "blue widget rod"


@query(f"SELECT p_partkey, round(score, 6) AS score FROM {BM25(LABELS, terms=SHOP_QUERY.split())} WHERE score > 0")
def rank_labels(spark, d):
    """Categories' labels ranked among each other; only those that score."""
    from corpusmill.operators import rank

    return rank.scores(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text")), SHOP_QUERY).where("score > 0").select("p_partkey", F.round("score", 6).alias("score"))


def _menu(spark, d):
    """A shop a nation: its menu has a category a region, whose pages list the nation's first suppliers."""
    link = F.expr("""concat('<div class="sub_set"><div class="menu_tit"><b class="tit">', n_name, '</b></div><a href="server_list.php?category_s=', n_nationkey, '"> list ', n_regionkey, ' </a><a href="/other">x</a></div>')""")
    whole = table(spark, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", link.alias("a")))), lambda x: x["a"]), "").alias("html"), F.lit("https://itmaya.co.kr/").alias("url"))
    return Q.with_links(whole, True).select(F.posexplode("links").alias("pos", "l")).select("pos", "l.label", "l.url")


@query("SELECT n_nationkey::INT AS pos, 'list ' || n_regionkey || ' ' || n_name AS label, 'https://itmaya.co.kr/server_list.php?category_s=' || n_nationkey AS url FROM nation")
def shop_menu(spark, d):
    return _menu(spark, d)


@query("""SELECT row_number() OVER (ORDER BY p_partkey)::INT AS rank, trim(p_name) AS title, 'https://itmaya.co.kr/server_view.php?idx=' || p_partkey AS url FROM part WHERE p_partkey % 25 = (SELECT min(n_nationkey) FROM nation WHERE n_name = 'NATION_13') ORDER BY p_partkey LIMIT 5""")
def shop_search(spark, d):
    """The products of the category that the query names; a category's page lists the parts of its remainder."""
    k = F.col("p_partkey")
    link = F.concat(F.lit('<a href="server_view.php?idx='), k.cast("string"), F.lit('">p</a>'))
    lists = table(spark, d, "part").groupBy((k % 25).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", link.alias("a")))), lambda x: x["a"]), "").alias("html"))
    lists = lists.select(F.concat(F.lit("https://itmaya.co.kr/server_list.php?category_s="), F.col("c").cast("string")).alias("url"), "html")
    return Q.search(_menu(spark, d), lists, _product_pages(spark, d), "NATION_13", 5).select("rank", "title", "url")


# Usage.
@query(f"""SELECT scope, {SUMS} FROM (SELECT c.*, unnest(['total'] || CASE WHEN strftime(ts, '%Y-%m-%d') = (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) THEN ['today'] ELSE [] END || CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN ['session'] ELSE [] END) AS scope FROM {COSTED} c) GROUP BY scope""")
def usage_scopes(spark, d):
    """All calls, those of the last call's day, and those of a session that began an hour before it."""
    calls = _costed(spark, d)
    last = calls.agg(F.max("ts")).first()[0]
    return usage.scopes(calls, F.lit(last), F.lit(last) - F.expr("INTERVAL 1 HOUR"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.25::DOUBLE ELSE cost_usd END AS cost_usd FROM {COSTED}")
def usage_reported_cost(spark, d):
    """A cost that a call reports stands; others are priced."""
    return _costed(spark, d).withColumn("cost_usd", usage.priced(F.when(F.col("event_id") % 5 == 0, 0.25))).select("event_id", "cost_usd")


@query(f"SELECT provider, CASE WHEN cost_usd = 0 THEN '$0' ELSE '$' || format('{{:.4f}}', cost_usd) END || CASE WHEN unpriced_requests > 0 THEN ' (+' || unpriced_requests || ' unpriced)' ELSE '' END AS shown FROM (SELECT provider, {SUMS} FROM {COSTED} GROUP BY provider)")
def usage_shown(spark, d):
    return _costed(spark, d).groupBy("provider").agg(*usage.sums()).select("provider", usage.shown(F.col("cost_usd"), F.col("unpriced_requests")).alias("shown"))


# Lookups.
@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 428 WHEN 3 THEN 502 ELSE 500 END AS status FROM events")
def error_status(spark, d):
    kind = F.get(F.array(*map(F.lit, ("unauthorized", "rate_limit", "no_key", "unreachable", "else"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", policy.error_status(kind).alias("status"))


@query("SELECT s_suppkey, (12000 // greatest(s_suppkey % 9, 1))::INT AS budget FROM supplier")
def result_budget(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", policy.result_budget(12_000, F.col("s_suppkey") % 9).cast("int").alias("budget"))


@query("""SELECT asked, method, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN [{'a': 'shopping.naver.com', 'm': 'naver_api'}] WHEN s_suppkey % 4 = 1 THEN [{'a': 'b.co.kr', 'm': 'b.co.kr'}, {'a': 'b.com', 'm': 'b.co.kr'}] ELSE [] END) AS x FROM supplier), LATERAL (SELECT x.a AS asked, x.m AS method) GROUP BY asked, method""")
def answered_sites(spark, d):
    """One site by its service, one that answers itself, one whose sibling answers for it, and one that nobody answers for."""
    k = F.col("s_suppkey") % 4
    hits = table(spark, d, "supplier").where(k == 1).select(F.lit("b.co.kr").alias("site"), F.lit("b.co.kr").alias("asked"), "s_suppkey")
    api = table(spark, d, "supplier").where(k == 0).select(F.col("s_name").alias("title"), F.lit("u").alias("url"), F.lit(5).cast("long").alias("low_price"), F.lit("").alias("brand"), F.lit("").alias("mall"))
    sites = spark.createDataFrame([("shopping.naver.com", None), ("b.co.kr", None), ("b.com", "b.co.kr"), ("c.com", None)], "site string, sibling string")
    named = quotes.api_quotes(api, "shopping.naver.com").select(F.col("site").alias("asked"), "method")
    return named.unionByName(quotes.answered(sites, hits).select("asked", F.col("site").alias("method"))).groupBy("asked", "method").agg(F.count("*").alias("n"))
