"""Fetching as tables: robots files, bounded crawls, the response cache, and response rows that become documents or errors."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import html as H
from corpusmill.functions import urls as U
from corpusmill.operators import rank
from corpusmill.sources.tables import shared_dir

# Robots files.


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, group, agents, delay, rules) of robots files (host, status, body): a row a group of agents, rules in the file's order.

    A group is a run of user-agent lines and the rules after it, up to an empty line or the next run; rules outside any
    group don't count. Comments and blanks around keys and values go. A file with a status of 400 or more, or
    none at all (null status or body), gives no rows, which allows everything. A host's file is one row, and its lines
    meet in one window; that is as much as a file has. An empty table gives no rows.
    """
    got = files.where((F.col("status") < 400) & F.col("body").isNotNull())
    lines = got.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("host", "pos", (F.col("raw") == "").alias("empty"), F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("key"), F.when(line.contains(":"), F.trim(F.regexp_replace(line, "^[^:]*:", ""))).alias("value"))
    lines = lines.where("empty or value is not null")
    by = Window.partitionBy("host").orderBy("pos")
    agent = (F.col("key") == "user-agent") & ~F.col("empty")
    lines = lines.withColumn("opens", agent & ~F.coalesce(F.lag(agent).over(by), F.lit(False))).withColumn("group", F.sum(F.col("opens").cast("int")).over(by))
    closed = F.sum(F.col("empty").cast("int")).over(Window.partitionBy("host", "group").orderBy("pos"))
    own = lines.withColumn("closed", closed).where("group > 0 and closed = 0")
    rule = F.col("key").isin("allow", "disallow")
    # an empty disallow allows all that the rules before it leave
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    said = own.groupBy("host", "group").agg(
        F.collect_list(F.when(agent, F.lower("value"))).alias("agents"),
        F.first(F.when((F.col("key") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("value").cast("int")), ignorenulls=True).alias("delay"),
        F.array_sort(F.collect_list(F.when(rule, F.struct("pos", F.col("value").alias("prefix"), allow.alias("allow"))))).alias("rules"),
    )
    return said


def robots_group(rules: DataFrame, agent: str) -> DataFrame:
    """(host, delay, rules): the first group that names the agent (by its product name, a part of it is enough), else the first for all."""
    name = F.lit(agent.split("/")[0].lower())
    named = F.exists("agents", lambda a: (a != "*") & (a != "") & name.contains(a))
    place = F.when(named, F.lit(0)).when(F.array_contains("agents", "*"), F.lit(1))
    fit = rules.withColumn("place", place).where("place is not null")
    return fit.groupBy("host").agg(F.min_by(F.struct("delay", "rules"), F.struct("place", "group")).alias("g")).select("host", "g.delay", "g.rules")


def robots_verdict(urls: DataFrame, rules: DataFrame, agent: str, least_delay: float = 1.0) -> DataFrame:
    """urls (host, path, any others) with ``allowed`` and ``delay``: the first rule whose prefix the path begins with decides, none allows.

    Rules come as one array a host and are tried within the row, so a hot host's rows do not multiply. The delay is
    the file's or ``least_delay``, whichever is longer. Null paths are ''. Hosts without rules allow everything.
    """
    group = robots_group(rules, agent).select(F.col("host").alias("__host"), F.col("delay").alias("__delay"), F.col("rules").alias("__rules"))
    got = urls.join(group, urls["host"] == F.col("__host"), "left")
    path = F.coalesce(F.nullif(urls["path"], F.lit("")), F.lit("/"))
    first = F.get(F.filter("__rules", lambda r: path.startswith(r["prefix"])), F.lit(0))
    return got.select(*[urls[c] for c in urls.columns], F.coalesce(first["allow"], F.lit(True)).alias("allowed"), F.greatest(F.lit(least_delay), F.coalesce("__delay", F.lit(0)).cast("double")).alias("delay"))


# Bounded crawls.


def in_scope(url: Column, seed: str, same_site: bool, domains: list[str] | None) -> Column:
    host = U.bare(U.host(url))
    if domains:
        names = [d.lower().lstrip(".") for d in domains]
        hit = F.lit(False)
        for n in names:
            hit = hit | (host == n) | host.endswith("." + n)
        return hit
    return host == U.bare(U.host(F.lit(seed))) if same_site else F.lit(True)


def crawl_pages(seed: str, pages: DataFrame, links: DataFrame, depth: int = 1, max_pages: int = 20, same_site: bool = True, domains: list[str] | None = None) -> DataFrame:
    """(place, url, depth) of the pages that a crawl from seed fetches, in order: breadth first, at most ``max_pages``.

    links: (src, pos, dst) in each page's order; pages: (url, ok), where a page that is not ok (or is unknown) leads on to
    none. A link outside the scope, or to a key (``crawl_key``) seen before, is passed over. Each level is a join of at most ``max_pages``
    pages with the links, cut to the pages still wanted, and is written to the shared folder: what is held grows with
    ``max_pages`` only. Null links are passed over; empty tables leave the seed.
    """
    spark = links.sparkSession
    root = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    seen = spark.createDataFrame([(0, seed, 0)], "place int, url string, depth int").limit(max(0, max_pages)).withColumn("key", U.crawl_key(F.col("url")))
    key = U.crawl_key(F.col("dst"))
    scoped = links.where(F.col("dst").isNotNull()).where(in_scope(F.col("dst"), seed, same_site, domains))
    for d in range(1, depth + 1):
        have = seen.count()
        if have >= max_pages:
            break
        frontier = seen.where(F.col("depth") == d - 1).join(pages.where("ok").select(F.col("url").alias("__ok")).distinct(), F.col("url") == F.col("__ok"), "left_semi")
        met = scoped.join(F.broadcast(frontier.select(F.col("url").alias("src"), F.col("place").alias("from"))), "src").withColumn("key", key)
        new = met.join(F.broadcast(seen.select("key")), "key", "left_anti").groupBy("key").agg(F.min(F.struct("from", "pos", "dst")).alias("at"))
        first = new.select("key", "at.*").orderBy("from", "pos", "dst").limit(max_pages - have)
        level = first.select((F.row_number().over(Window.orderBy("from", "pos", "dst")) + F.lit(have - 1)).alias("place"), F.col("dst").alias("url"), F.lit(d).alias("depth"), "key")
        level.write.parquet(f"{root}/{d}")
        level = spark.read.schema(level.schema).parquet(f"{root}/{d}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("place", "url", "depth")


# The response cache.


def cache_key(engine: Column, url: Column, params: Column) -> Column:
    """SHA-256 of the engine that starts, the address and the parameters in the order of their names."""
    sorted_ = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.sha2(F.concat_ws("|", F.coalesce(engine, F.lit("")), F.coalesce(url, F.lit("")), sorted_), 256)


def cache_put(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """The cache (key, url, status, stored_at, content) with the responses of status 200 in it; of one key the latest stays (of equals the larger content)."""
    both = cache.select("key", "url", "status", "stored_at", "content").unionByName(responses.where("status = 200").select("key", "url", "status", "stored_at", "content"))
    return both.groupBy("key").agg(F.max(F.struct("stored_at", "content", "url", "status")).alias("r")).select("key", "r.url", "r.status", "r.stored_at", "r.content")


def cache_get(requests: DataFrame, cache: DataFrame, now: Column, ttl: float) -> DataFrame:
    """requests (key, any others) with ``cached``: whether the cache has an answer no older than ttl seconds (any age if ttl is 0), and its ``content``."""
    age = now.cast("double") - F.col("stored_at").cast("double")
    fresh = cache.where((age <= ttl) if ttl > 0 else F.lit(True)).select(F.col("key").alias("__key"), F.col("content").alias("__content"))
    got = requests.join(fresh, requests["key"] == F.col("__key"), "left")
    return got.select(*[requests[c] for c in requests.columns], F.col("__key").isNotNull().alias("cached"), F.col("__content").alias("content"))


def cache_kept(cache: DataFrame, budget: int, at: str = "stored_at", size: str = "size") -> DataFrame:
    """The newest entries of the whole cache whose sizes together stay within the budget: oldest go first, until what is left fits.

    Sizes are summed by hour first, newest hour down, so that only the hour in which the budget ends is
    ordered entry by entry; hours are few. Entries of equal time go by key, the smaller first.
    """
    hour = F.floor(F.col(at).cast("double") / 3600)
    hours = cache.groupBy(hour.alias("__hour")).agg(F.sum(size).alias("__size"))
    newest = Window.orderBy(F.desc("__hour"))
    newer = hours.select("__hour", (F.sum("__size").over(newest) - F.col("__size")).alias("__newer"), F.sum("__size").over(newest).alias("__upto")).where(F.col("__newer") < budget)
    held = cache.withColumn("__hour", hour).join(F.broadcast(newer), "__hour")
    whole = held.where(F.col("__upto") <= budget).select(*cache.columns)
    last = held.where(F.col("__upto") > budget)
    upto = F.sum(size).over(Window.partitionBy("__hour").orderBy(F.desc(at), F.desc("key")))
    return whole.unionByName(last.withColumn("__sum", F.col("__newer") + upto).where(F.col("__sum") <= budget).select(*cache.columns))


# Responses as documents.


def media_type(header: Column) -> Column:
    """What stands before the first semicolon, trimmed, in lower case; null for no header."""
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def charset(header: Column) -> Column:
    """The charset that a content type names, in lower case; null if it names none."""
    return F.lower(F.nullif(F.regexp_extract(header, r"(?i)charset=\s*[\"']?([^\s;\"']+)", 1), F.lit("")))


@F.pandas_udf(StringType())
def body_text(body: pd.Series, declared: pd.Series) -> pd.Series:
    """Bytes as text: by the header's charset, else the one that the page's first 2048 bytes name, else UTF-8; an unknown charset is UTF-8, and bytes that don't fit become replacement characters."""
    import re

    own = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
    out = []
    for raw, name in zip(body, declared):
        if raw is None:
            out.append(None)
            continue
        raw = bytes(raw)
        if not isinstance(name, str) or not name:
            found = own.search(raw[:2048])
            name = found[1].decode("ascii") if found else "utf-8"
        try:
            out.append(raw.decode(name, "replace"))
        except LookupError:
            out.append(raw.decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def documents_of(responses: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """A document row of each response (url, status, header, body as bytes, error): url, status, content_type, title, text, words, error. Never fails.

    A response with an error, a status of 400 or more, or a type that is neither HTML, XML nor text, is an error row with empty text;
    no type at all is read as HTML. Null bodies are empty pages; repeated rows each give a row; extra columns are not read.
    ``references``: the named character references that are decoded, all if None.
    """
    kind = media_type(F.col("header"))
    readable = kind.isNull() | (kind == "") | kind.contains("html") | kind.contains("xml") | kind.contains("text")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("status", F.lit(0)) >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(~readable, F.concat(F.lit("unsupported content-type: "), kind))
    rows = responses.select("url", F.coalesce("status", F.lit(0)).alias("status"), kind.alias("content_type"), error.alias("error"), F.when(error.isNull(), body_text("body", charset(F.col("header")))).alias("html"))
    page = H.with_extract(rows, ["title", "text"], references=references)
    text = F.when(F.col("error").isNull(), F.col("page.text")).otherwise("")
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return page.select("url", "status", "content_type", F.when(F.col("error").isNull(), F.col("page.title")).otherwise("").alias("title"), text.alias("text"), words.alias("words"), "error")


# Engines.


def ladder(spark: SparkSession, engines: list[tuple[str, int, bool]], start: str | None = None) -> DataFrame:
    """(engine, tier) of the available engines, weakest first: from the start's tier on if a start is given (an unknown one raises), the start itself only if it is available."""
    tiers = {name: tier for name, tier, _ in engines}
    if start is not None and start not in tiers:
        raise ValueError(f"unknown engine: {start}")
    rows = [(n, t) for n, t, available in engines if available and (start is None or n == start or t > tiers[start])]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "engine string, tier int")


def escalation_targets(spark: SparkSession, engines: list[tuple[str, int, bool]], start: str) -> DataFrame:
    """The ladder above an engine."""
    return ladder(spark, engines, start).where(F.col("engine") != start)


# Composites.


def recovered(urls: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """urls (url) with ``ok``, ``got`` (the address whose document stands for it), ``how`` (own, variant, candidate) and ``error``.

    docs: url, ok, error (one row a url); candidates: url, pos, candidate, found by other means, best first. An address's own document counts, then
    its variants' (see ``url_variants``) in their order, then its candidates'; the first that is ok is taken. Addresses
    without any are failures with their own document's error. Repeated urls give a row each; tries are joined by
    address, so a document that many addresses share is not gathered.
    """
    one = urls.select("url").distinct()
    tries = one.select("url", F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.col("url").alias("got"))
    tries = tries.unionByName(one.select("url", F.lit(1).alias("stage"), F.posexplode(U.url_variants(F.col("url"))).alias("pos", "got")))
    tries = tries.unionByName(candidates.select("url", F.lit(2).alias("stage"), F.col("pos").cast("int").alias("pos"), F.col("candidate").alias("got")).join(one, "url", "left_semi"))
    good = tries.join(docs.where("ok").select(F.col("url").alias("got")), "got").groupBy("url").agg(F.min(F.struct("stage", "pos", "got")).alias("b"))
    own = docs.select("url", F.col("error").alias("__error"))
    how = F.get(F.array(F.lit("own"), F.lit("variant"), F.lit("candidate")), F.col("b.stage"))
    got = urls.join(good, "url", "left").join(own, "url", "left")
    return got.select(*[urls[c] for c in urls.columns], F.col("b").isNotNull().alias("ok"), F.col("b.got").alias("got"), how.alias("how"), F.when(F.col("b").isNull(), F.coalesce("__error", F.lit("not fetched"))).alias("error"))


def research(results: DataFrame, query: str, depth: str = "advanced", cap: int = 1200) -> DataFrame:
    """results (asked, rank, title, url, snippet, score, and for ``advanced`` the document's ok, doc_title, text, passages) as answered: asked, place, title, url, content, score.

    ``basic`` takes snippets and the service's scores in the service's order. ``advanced`` takes a document's four best passages and its
    best passage's score, of a document without matches its text, of none the snippet, up to ``cap`` characters; the best
    score comes first, ties in the service's order. A question's results are few; they are put in order in one window.
    """
    if depth == "basic":
        return results.select("asked", F.col("rank").alias("place"), "title", "url", F.col("snippet").alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"))
    items = F.transform("passages", lambda p, i: F.struct(i.alias("pos"), p.alias("text")))
    best = F.when(F.col("ok"), rank.ranked_items(items, query, 4))
    read = results.withColumn("__best", best)
    joined = F.array_join(F.transform("__best", lambda x: x["text"]), "\n\n")
    content = F.when(F.size("__best") > 0, joined).when(F.col("ok"), F.coalesce(F.nullif("text", F.lit("")), F.col("snippet"))).otherwise(F.col("snippet"))
    out = read.select("asked", "rank", F.coalesce(F.nullif(F.when(F.col("ok"), F.col("doc_title")), F.lit("")), F.col("title")).alias("title"), "url", F.left(content, F.lit(cap)).alias("content"), F.coalesce(F.get("__best", F.lit(0))["score"], F.lit(0.0)).alias("score"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "rank"))).drop("rank")
