"""Queries over the data source of responses, the inverted index, address ranges, exact quantiles, the unbounded crawl and engine climbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import crawl, index, networks, policy, quantiles
from corpusmill.plans.catalog import BFS, TOK, query
from corpusmill.plans.shop import ITEM, OPENING, _responses
from corpusmill.sources import responses
from corpusmill.sources.tables import table
from corpusmill.streaming.replay import new_folder


def _saved(spark, d):
    """The responses of all services, saved in a folder of pages (a supplier's is its number), and how many a block has."""
    root = new_folder(spark, "responses")
    pages = _responses(spark, d).withColumn("page", F.regexp_extract("query", r"(\d+)$", 1).cast("long"))
    size = responses.block_size(pages, 16)
    responses.write_responses(pages, root, size)
    return root, size


BODIES = " UNION ALL ".join(f"SELECT '{k}' AS provider, s_name AS query, s_suppkey AS page, CASE WHEN s_suppkey % 7 = 3 THEN 500 ELSE 200 END AS status, md5('{v}' || {ITEM} || '{']' + '}' * v.count('{')}') AS body_md5 FROM supplier" for k, v in OPENING.items())


@query(f"SELECT * FROM ({BODIES}) WHERE provider IN ('brave', 'naver') AND page > 3 AND status = 200")
def response_pages(spark, d):
    """Saved responses by provider and page; the source reads the blocks that can have them."""
    root, size = _saved(spark, d)
    rows = responses.read_responses(spark, root, block_pages=size)
    return rows.where(F.col("provider").isin("brave", "naver") & (F.col("page") > 3) & (F.col("status") == 200)).select("provider", "query", "page", "status", F.md5("body").alias("body_md5"))


@query(f"SELECT provider, count(*)::BIGINT AS pages, count(*) FILTER (WHERE status >= 400)::BIGINT AS failed, max(page)::BIGINT AS last_page FROM ({BODIES}) GROUP BY provider")
def response_feed(spark, d):
    """Saved responses as a stream, with what failed of each provider."""
    (root, size), folder = _saved(spark, d), new_folder(spark, "stream")
    rows = responses.read_responses(spark, root, stream=True, block_pages=size).select("provider", "page", "status")
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("provider string, page long, status int").parquet(f"{folder}/out")
    return got.groupBy("provider").agg(F.count("*").alias("pages"), F.count_if(F.col("status") >= 400).alias("failed"), F.max("page").alias("last_page"))


RANKED = f"""WITH d AS (SELECT doc_id, {TOK('text')} AS tok FROM documents), n AS (SELECT count(*) AS n, avg(len(tok)) AS a FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS w FROM (SELECT item_id, unnest({TOK('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY ALL)
SELECT item_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


@query(RANKED)
def index_search(spark, d):
    """The ten best documents for every passage of the benchmark, all at once, by the index."""
    built = index.build(table(spark, d, "documents"), "doc_id", f"{new_folder(spark, 'index')}")
    found = index.search(built, table(spark, d, "benchmark"), "item_id", 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


V4 = "((user_id % 256) * 16777216 + (event_id % 256) * 65536 + 256 + event_id % 200)::BIGINT"
NETS = "(SELECT n_name, n_nationkey::BIGINT AS k, 4 + n_nationkey % 21 AS len4, 2 + n_nationkey % 15 AS len6 FROM nation)"


@query(f"""WITH a AS (SELECT event_id, event_id % 3 = 0 AS six, {V4} AS n, ((event_id * 7) % 65536)::BIGINT AS g FROM events),
m AS (SELECT event_id, n_name, CASE WHEN six THEN len6 ELSE len4 END AS prefix FROM a JOIN {NETS} ON CASE WHEN six THEN g >> (16 - len6) = ((k * 2621) >> (16 - len6)) ELSE n >> (32 - len4) = ((k * 167772160 // 2 + k * 65536) >> (32 - len4)) END)
SELECT a.event_id, prefix::INT AS prefix, n_name FROM a LEFT JOIN (SELECT event_id, max(prefix) AS prefix, min(n_name ORDER BY prefix DESC) AS x, arg_max(n_name, prefix * 1000 - k) AS n_name FROM (SELECT m.*, row_number() OVER (PARTITION BY event_id, prefix ORDER BY n_name) AS k FROM m) GROUP BY event_id) USING (event_id)""")
def address_networks(spark, d):
    """The most specific network, of those of all nations, that holds each event's address; a third are IPv6."""
    k = F.col("n_nationkey").cast("long")
    n = F.floor(k * 167772160 / 2).cast("long") + k * 65536
    dotted = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)])
    v4 = F.concat(dotted, F.lit("/"), (4 + k % 21).cast("string"))
    v6 = F.concat(F.hex(k * 2621), F.lit("::/"), (2 + k % 15).cast("string"))
    nets = networks.networks(table(spark, d, "nation").select("n_name", F.explode(F.array(v4, v6)).alias("cidr")), "cidr")
    four = F.concat_ws(".", F.col("user_id") % 256, F.col("event_id") % 256, F.lit("1"), F.col("event_id") % 200)
    user, group = F.coalesce(F.col("user_id"), F.lit(0)).cast("long"), lambda x: F.hex(x.bitwiseAND(F.lit(0xFFFF)))  # a group has four digits at most
    six = F.concat(F.hex((F.col("event_id") * 7) % 65536), F.lit("::"), group(F.shiftright(user, 16)), F.lit(":"), group(user))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, six).otherwise(four).alias("ip"))
    return networks.within(rows, "ip", nets, "n_name").select("event_id", "prefix", "n_name")


@query("""SELECT vendor_id, q AS quantile, CASE q WHEN 0.25 THEN quantile_cont(amount, 0.25) WHEN 0.5 THEN quantile_cont(amount, 0.5) ELSE quantile_cont(amount, 0.99) END AS value, count(amount)::BIGINT AS n FROM sale_lines, (VALUES (0.25::DOUBLE), (0.5), (0.99)) t(q) WHERE amount IS NOT NULL GROUP BY vendor_id, q""")
def amount_quantiles(spark, d):
    """Quartile, median and 99th percentile of every vendor's amounts, exactly; a vendor may have most of the rows."""
    return quantiles.exact_quantiles(table(spark, d, "sale_lines"), ["vendor_id"], "amount", [0.25, 0.5, 0.99], small=500)


@query("SELECT floor(quantile_cont(l_extendedprice::DOUBLE, 0.5))::BIGINT AS median, count(*)::BIGINT AS n FROM lineitem WHERE l_extendedprice IS NOT NULL")
def price_median(spark, d):
    """The floored median of all prices, as a price summary has it."""
    got = quantiles.exact_quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", [0.5])
    return got.select(F.floor("value").cast("long").alias("median"), "n")


@query(BFS.replace("w.depth < 3", "w.depth < 40"))
def crawl_reach(spark, d):
    """All that one customer reaches over the links of all orders, however far."""
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    links = table(spark, d, "orders").select(c(F.col("o_custkey")).alias("src"), c((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500).alias("dst"))
    return crawl.Reach(spark, new_folder(spark, "reach"), 8).run(spark.range(1).select(F.lit("c1").alias("node")), links)


@query("""WITH r AS (SELECT user_id, 'e' || k AS engine, k AS pos, words, status, status = 200 AND k <> 3 AS ok, CASE WHEN status IN (0, 403, 429, 503) THEN true WHEN status <> 200 THEN false ELSE words < 50 END AS more
  FROM (SELECT user_id, k, (user_id * 31 + k * k * 17) % 90 AS words, CASE WHEN (user_id + k) % 5 = 0 THEN 403 ELSE 200 END AS status FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), range(1, 5) t(k))),
w AS (SELECT *, pos = 1 OR (ok AND words > max(CASE WHEN pos = 1 OR ok THEN words END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS taken FROM r),
g AS (SELECT user_id, bool_or(pos = 1 AND NOT more) AS enough, min(pos) FILTER (WHERE taken AND NOT more) AS good, max(pos) FILTER (WHERE taken) AS last FROM w GROUP BY user_id),
c AS (SELECT user_id, CASE WHEN enough THEN 1 ELSE coalesce(good, last) END AS won, CASE WHEN enough THEN 1 ELSE coalesce(good, 4) END AS tried FROM g)
SELECT user_id::VARCHAR AS url, engine, words, tried, CASE WHEN won > 1 THEN 'e1' END AS escalated_from FROM c JOIN r USING (user_id) WHERE pos = won""")
def escalation_climb(spark, d):
    """What a climb of four engines gives for each user's page, and how far it went."""
    users = table(spark, d, "events").where("user_id is not null").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    status = F.when((F.col("user_id") + F.col("k")) % 5 == 0, 403).otherwise(200)
    rows = users.select(F.col("user_id").cast("string").alias("url"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("engine"), F.col("k").alias("tier"), status.alias("status"), ((F.col("user_id") * 31 + F.col("k") * F.col("k") * 17) % 90).alias("words"), ((status == 200) & (F.col("k") != 3)).alias("ok"))
    return policy.escalated(rows)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 6 ELSE least(greatest(event_id, 1), 25) END AS n, CASE WHEN event_id % 5 = 0 THEN '''n'' must be an integer, got ''' || event_id || 'x''' END AS error FROM events")
def clamp_checked(spark, d):
    """An argument that is no whole number is an error; a missing one is the default."""
    k = F.col("event_id")
    value = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("x"))).when(k % 7 != 0, k.cast("string"))
    return table(spark, d, "events").select("event_id", policy.clamped(value, "n", 6, 1, 25).alias("c")).select("event_id", "c.n", "c.error")
