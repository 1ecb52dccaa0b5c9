"""Keep-first, domain filters and registry joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import urls as U

# Sites, how they search, and what their result links look like.
SITES = [
    ("danawa.com", "https://search.danawa.com/dsearch.php?query={q}", r"prod\.danawa\.com/info"),
    ("compuzone.co.kr", "https://www.compuzone.co.kr/search/search_list.php?actype=list&SearchType=small&SearchText={q}&PreOrder=sale_order&PageCount=20&StartNum=0&PageNum=1&ListType=0&BigDivNo=&MediumDivNo=&DivNo=", r"product_detail\.htm"),
    ("coupang.com", "https://www.coupang.com/np/search?q={q}", "/vp/products/"),
    ("gmarket.co.kr", "https://browse.gmarket.co.kr/search?keyword={q}", r"item\.gmarket\.co\.kr|/Item"),
    ("11st.co.kr", "https://search.11st.co.kr/Search.tmall?kwd={q}", "/products/"),
    ("enuri.com", "https://www.enuri.com/search.jsp?keyword={q}", r"detail\.jsp"),
    ("shopping.naver.com", "https://search.shopping.naver.com/search/all?query={q}", None),
    ("naver.com", "https://search.naver.com/search.naver?query={q}", None),
    ("amazon.com", "https://www.amazon.com/s?k={q}", "/dp/|/gp/product/"),
    ("ebay.com", "https://www.ebay.com/sch/i.html?_nkw={q}", "/itm/"),
    ("aliexpress.com", "https://www.aliexpress.com/wholesale?SearchText={q}", "/item/"),
    ("wikipedia.org", "https://en.wikipedia.org/w/index.php?search={q}", "/wiki/"),
    ("github.com", "https://github.com/search?q={q}&type=repositories", None),
    ("stackoverflow.com", "https://stackoverflow.com/search?q={q}", r"/questions/\d"),
    ("reddit.com", "https://www.reddit.com/search/?q={q}", "/comments/"),
    ("pypi.org", "https://pypi.org/search/?q={q}", "/project/"),
    ("npmjs.com", "https://www.npmjs.com/search?q={q}", "/package/"),
    ("youtube.com", "https://www.youtube.com/results?search_query={q}", r"/watch\?v="),
]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SITES)], "pos int, domain string, template string, pattern string")


def keep_first(df: DataFrame, keys: list, *order: Column | str) -> DataFrame:
    """The first row of each key by an explicit order (dropDuplicates has none)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def domain_filter(df: DataFrame, host: str, domains: list[str], keep: bool) -> DataFrame:
    """Rows whose host is, or is under, one of the named domains (or none of them); null hosts are under none."""
    hit = F.coalesce(F.arrays_overlap(U.suffixes(F.lower(F.col(host))), F.array(*map(F.lit, domains))), F.lit(False))
    return df.where(hit if keep else ~hit)


def registered(df: DataFrame, host: str, registry: DataFrame) -> DataFrame:
    """df with the registered ``domain`` of its host (the first in the registry of those that fit), or null."""
    each = df.select(F.col(host).alias("__h")).distinct().select("__h", F.explode(U.suffixes(F.col("__h"))).alias("domain"))
    best = each.join(F.broadcast(registry.select("domain", "pos")), "domain").groupBy("__h").agg(F.min_by("domain", "pos").alias("domain"))
    return df.join(best, df[host] == best["__h"], "left").drop("__h")


def siblings(df: DataFrame, host: str, registry: DataFrame) -> DataFrame:
    """df (hosts without a registered domain) with ``sibling``: the only registered domain of the same first label, or null."""
    label = F.split_part(F.col("domain"), F.lit("."), F.lit(1))
    one = registry.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min("domain").alias("sibling")).where("n = 1").drop("n")
    loose = registered(df, host, registry).where("domain is null").drop("domain").withColumn("label", F.split_part(F.col(host), F.lit("."), F.lit(1)))
    return loose.join(F.broadcast(one), "label", "left").drop("label")
