"""Behaviour that the driver's tables don't reach: other scripts, odd markup, odd values."""

from pyspark.sql import functions as F

from corpusmill.functions import html as H
from corpusmill.functions import prices as P
from corpusmill.functions import text as T
from corpusmill.functions import urls as U
from corpusmill.operators import chunk, policy, rank, usage


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_normalize_and_clean(spark):
    t = F.col("t")
    assert one(spark, T.normalize(t), t="exam-\nple\r\n\r\n\r\n\r\nx \t y ") == "example\n\nx y"
    assert one(spark, T.clean(t), t="We use cookies on this site\nReal words here\n로그인\n—\nhttps://a.b/c") == "Real words here"
    line = "this is a long enough line to count"
    assert one(spark, T.dedupe_lines(t), t=f"{line}\nab\n{line.upper()}\nab") == f"{line}\nab\nab"
    assert one(spark, T.flatten_markdown(t), t="![i](u) [label](http://x) **b** `c`") == " label b c"
    assert one(spark, T.quality_score(t), t="") == 0.0


def test_nfkc_changes_only_what_needs_it(spark):
    df = spark.createDataFrame([("ﬁne Ａ",), ("plain é",), (None,)], "t string")
    assert {r.t for r in T.nfkc(df, "t").collect()} == {"fine A", "plain é", None}


def test_korean_tokens(spark):
    assert one(spark, rank.tokenize(F.col("t")), t="삼성전자는 the Price") == ["삼성전자는", "삼성", "성전", "전자", "자는", "price"]
    assert one(spark, T.est_tokens_chunk(F.col("t")), t="가나다라abcd") == 3


def test_chunks_overlap_and_wrap(spark):
    t = F.col("t")
    assert one(spark, chunk.split_long(t, 10), t="aaa. bbb. " + "c" * 25) == ["aaa. bbb.", "c" * 10, "c" * 10, "c" * 5]
    got = one(spark, chunk.chunk_text(t, 20, 5), t="first para one\n\nsecond para two")
    assert got == ["first para one", "a one\n\nsecond para two"]
    assert one(spark, chunk.chunk_text(t), t=" \n\n ") == []


def test_urls(spark):
    u = F.col("u")
    assert one(spark, U.normalize_url(u), u="HTTP://Ex.Com?a=1#f") == "http://ex.com/?a=1"
    assert one(spark, U.canon_url(u), u="https://x.com/p/?q=z&pcode=12345&ref=1") == "https://x.com/p?pcode=12345"
    assert one(spark, U.canon_url(u), u="https://x.com/p?b=%7E*&a=b%20c&%61=z&e=&f=%zz") == one(spark, U.canon_url(u), u="https://x.com/p?f=%25zz&a=z&a=b+c&b=~%2A") == "https://x.com/p?a=b+c&a=z&b=~%2A&f=%25zz"
    assert one(spark, U.url_keywords(u), u="https://www.x.com/product/ESC4000-view/123?id=7&esc4000") == ["ESC4000"]
    assert one(spark, U.url_variants(u), u="http://www.x.com/a") == ["https://www.x.com/a", "http://x.com/a", "http://www.x.com/a/"]
    assert one(spark, U.slug(u), u="https://a.b/c d?e") == "a.b_c_d_e"


def test_prices(spark):
    t = F.col("t")
    cases = {"리뷰 1,234건 · 265,000원": 265000, "라이젠5 9600X": None, "₩ 5,000": 5000, "90원": None}
    assert {k: one(spark, P.price_from_text(t), t=k) for k in cases} == cases
    rows = {"369,000원29%259,000원배송비 2,500원": 259000, "배송비 2,500원": None, "8,967원 적립 and some other words 300,000원": 300000, "": None}
    assert {k: one(spark, P.price_from_listing(t), t=k) for k in rows} == rows
    assert one(spark, P.names_another(t, F.lit("ryzen 9600X")), t="Ryzen 7500F 216,080원") is True
    assert one(spark, P.names_another(t, F.lit("ryzen 9600X")), t="265,000원") is False


def test_html_is_mended():
    page = '<html lang="en"><head><title>A &amp; B</title></head><body><nav><a href="/n">nav</a></nav><article><h2>Head</h2><p><b>Bold.<br><p>Second <a href="x">link</a> is long enough to be a passage.<ul><li>one<li>two</ul><table><tr><td>k<td>v</table></article></body>'
    x = H.extract(page, "http://h/p/")
    assert x["title"] == "A & B" and x["meta"] == {"lang": "en", "host": "h"}
    assert [link["url"] for link in x["links"]] == ["http://h/n", "http://h/p/x"]
    assert "## Head" in x["markdown"] and "- one\n- two" in x["markdown"] and "| k | v |" in x["markdown"] and "nav" not in x["text"]
    for odd in ("", "<<<", "<p", None, "\x00<a href='http://[bad'>x</a>"):
        assert isinstance(H.extract(odd, None)["text"], str)


def test_policy(spark):
    assert one(spark, policy.private_ip(F.col("i")), i="169.254.169.254") is True
    assert one(spark, policy.private_ip(F.col("i")), i="8.8.8.8") is False
    assert one(spark, policy.private_ip(F.col("i")), i="::1") is True
    assert one(spark, policy.private_ip(F.col("i")), i="2001:4860:4860::8888") is False and one(spark, policy.private_ip(F.col("i")), i="no") is None
    assert one(spark, policy.looks_blocked(F.lit(404), F.col("b")), b="gone") is False
    assert one(spark, policy.looks_blocked(F.lit(200), F.col("b")), b="Just a Moment") is True


def test_price_lookup_prefers_exact_then_longest_prefix(spark):
    prices = usage.pricing(spark, [("p", "m*", 1.0, 1.0, None), ("p", "m-x*", 2.0, 2.0, None), ("p", "m-x-1", 3.0, 3.0, None)])
    calls = spark.createDataFrame([("p", m, 10, 10, 0) for m in ("m-x-1", "m-x-2", "m", "z")] + [("q", "m", 1, 1, 0)], "provider string, model string, prompt_tokens long, completion_tokens long, cached_tokens long")
    got = {(r.provider, r.model): r.in_rate for r in usage.with_price(calls, prices).collect()}
    assert got == {("p", "m-x-1"): 3.0, ("p", "m-x-2"): 2.0, ("p", "m"): 1.0, ("p", "z"): None, ("q", "m"): None}


def test_ledger_as_a_stream(spark, tmp_path):
    from corpusmill.streaming.ledger import daily_ledger

    rows = [(f"2024-01-0{d} 10:00:00", "p", "m", 10 * d, 1, 0, 0.5 if d != 2 else None) for d in (1, 1, 2, 9)]
    calls = spark.createDataFrame(rows, "ts string, provider string, model string, prompt_tokens long, completion_tokens long, cached_tokens long, cost_usd double").withColumn("ts", F.to_timestamp("ts"))
    calls.write.json(str(tmp_path / "in"))
    stream = daily_ledger(spark.readStream.schema(calls.schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ledger").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    show = lambda df: sorted(map(tuple, df.select("day", "requests", "total_tokens", "cost_usd", "unpriced_requests").collect()))
    assert show(spark.table("ledger")) == show(daily_ledger(calls))
