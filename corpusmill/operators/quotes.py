"""Site search hits to price quotes: harvested links, quotes, misses and the summary of a lookup."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import prices as P
from corpusmill.functions import urls as U
from corpusmill.operators import keep
from corpusmill.sources.tables import shared_dir

NO_RESULTS = "no results — the site's search page returned nothing to a static fetch"


def site_queries(sites: DataFrame, queries: list[str]) -> DataFrame:
    """Every site with every query and its place in the caller's list."""
    return sites.select("*", F.posexplode(F.array(*map(F.lit, queries))).alias("query_pos", "query"))


def harvest(links: DataFrame, per_site: int) -> DataFrame:
    """(site, rank, title, url) of the result links of search pages, at most per_site a search page.

    links: site, search_url, pos, url, text, pattern (null: any). On-site links that are no homepage, fit the pattern and
    are not the search page itself; of links to one product the first address and the longest text (the first of equals).
    """
    url, key = F.col("url"), U.canon_url(F.col("url"))
    home = U.path(url).isin("", "/") & (U.query(url) == "")
    fits = F.col("pattern").isNull() | F.regexp(url, F.col("pattern"))
    ours = links.where(U.in_domain(F.lower(U.host(url)), F.col("site")) & ~home & fits & (key != U.canon_url(F.col("search_url"))))
    title = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    one = ours.groupBy("site", "search_url", key.alias("key")).agg(
        F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"), F.max_by(title, F.struct(F.length(title), -F.col("pos"))).alias("title")
    )
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("site", "search_url").orderBy("pos")))
    return ranked.where(F.col("rank") <= per_site).select("site", "rank", F.coalesce(F.nullif("title", F.lit("")), U.host(url)).alias("title"), "url")


def quotes(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """A quote for each hit (site, rank, title, url, snippet): the page's price, else the listing's title, else its snippet.

    reads: url, price, method, name, brand, problem (one row a url). A hit whose page was not read has the problem "not fetched".
    """
    page = reads.select("url", F.col("price").alias("__price"), F.col("method").alias("__method"), F.col("name").alias("__name"), F.col("brand").alias("__brand"), F.col("problem").alias("__problem"))
    # in a column of its own: in the last select, lambdas would take the new title for the hit's
    listed = hits.withColumn("__row", F.coalesce(P.price_from_listing(F.col("title")), P.price_from_listing(F.col("snippet"))))
    row = F.col("__row")
    price = F.coalesce("__price", row)
    method = F.when(F.col("__price").isNotNull(), F.col("__method")).when(row.isNotNull(), "listing").otherwise("")
    name = F.when(F.coalesce(P.is_block_title(F.col("__name")), F.lit(False)), "").otherwise(F.coalesce("__name", F.lit("")))
    title = F.trim(F.coalesce(F.nullif(name, F.lit("")), F.col("title")))
    problem = F.when(price.isNotNull(), "").otherwise(F.coalesce("__problem", F.lit("not fetched")))
    return listed.join(page, "url", "left").select("site", "rank", title.alias("title"), "url", price.alias("price"), method.alias("method"), F.coalesce("__brand", F.lit("")).alias("brand"), "snippet", problem.alias("problem"))


def api_quotes(results: DataFrame, site: str, method: str = "naver_api") -> DataFrame:
    """Quotes of a shopping service's results (title, url, low_price, brand, mall), which need no page: its prices are exact."""
    return results.select(F.lit(site).alias("site"), "title", "url", F.col("low_price").alias("price"), F.lit(method).alias("method"), F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("mall", F.lit("")).alias("snippet"))


def answered(sites: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits (asked, site, any others) of each site (site, sibling) that was asked: its own, or its sibling's in its name if it has none.

    ``asked`` is the site a search was sent to, ``site`` the one the hits are on. Sites are few; hits only meet counts.
    """
    own = hits.groupBy("asked").agg(F.count("*").alias("__n")).select(F.col("asked").alias("__own"), "__n")
    has = sites.join(own, sites["site"] == F.col("__own"), "left").select(sites["site"].alias("__site"), F.coalesce(F.when(F.col("__n") > 0, sites["site"]), sites["sibling"]).alias("__from"))
    return hits.join(F.broadcast(has.where("__from is not null")), F.col("asked") == F.col("__from")).drop("asked", "__from").withColumnRenamed("__site", "asked")


def advert(query: Column) -> Column:
    """A listing row that names another model than the query; pages that were read are no adverts."""
    return (F.col("method") == "listing") & P.names_another(F.col("title"), query)


def offers(quoted: DataFrame, query: Column) -> DataFrame:
    return quoted.where(F.col("price").isNotNull() & ~advert(query))


def misses(sites: DataFrame, quoted: DataFrame, query: Column) -> DataFrame:
    """(site, reason) of sites (site) without an offer: no results, only adverts, or the most common problem (the first of equals)."""
    problems = quoted.where("problem <> ''").groupBy("site", "problem").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    why = problems.groupBy("site").agg(F.max_by("problem", F.struct("n", -F.col("first"))).alias("why"))
    counts = quoted.groupBy("site").agg(
        F.count("*").alias("pages"), F.count("price").alias("priced"), F.count_if(F.col("price").isNotNull() & ~advert(query)).alias("kept")
    )
    n = lambda c: F.col(c).cast("string")
    ads = F.concat(n("priced"), F.lit(" result(s) found, all for other products — the site answered with ads, not this model"))
    none = F.concat(n("pages"), F.lit(" page(s) found, none priced"), F.coalesce(F.concat(F.lit(" — "), F.col("why")), F.lit("")))
    reason = F.when(F.col("pages").isNull(), NO_RESULTS).when(F.col("priced") > 0, ads).otherwise(none)
    return sites.join(counts, "site", "left").join(why, "site", "left").where("coalesce(kept, 0) = 0").select("site", reason.alias("reason"))


def cheapest(found: DataFrame) -> DataFrame:
    """(site, price, url): the cheapest offer of each site; ties by rank."""
    return keep.keep_first(found, ["site"], "price", "rank").select("site", "price", "url")


def summary(found: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: count, min, max, floored median and the cheapest address (ties by the site's place, then rank); no row without offers."""
    one = found.join(F.broadcast(sites.select("site", F.col("pos").alias("__pos"))), "site")
    agg = one.agg(
        F.count("*").alias("count"), F.min("price").alias("min"), F.max("price").alias("max"), F.floor(F.median("price")).cast("long").alias("median"),
        F.min_by("url", F.struct("price", "__pos", "rank")).alias("cheapest_url"),
    )
    return agg.where("count > 0")


def places(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their ``place`` from 1 in ``order``, which tells all rows apart: a range sort, and the number of rows before each part."""
    path = f"{shared_dir(rows.sparkSession)}/places-{uuid.uuid4().hex}"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    kept = rows.sparkSession.read.schema(sorted_.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    at = F.col("__at") - F.shiftleft("__part", 33)
    return kept.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + at + 1).alias("place"))
