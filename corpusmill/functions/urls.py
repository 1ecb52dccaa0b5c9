"""URL keys, filters and variants as Column functions. Parts are cut by RFC 3986's own pattern, as parse_url gives null on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Query parameters that never name a product, and path words that say nothing.
TRACKING = """
keyword query q search searchword kwd kw wd ref referer spm src from cate category cate_c page sort order list view tab
position rank loggroup sess index adid acode trace mc utm_source utm_medium utm_campaign utm_term utm_content gclid
fbclid _trksid _trkparms hash
""".split()
STOP_PARTS = """
www http https view views list lists index page pages product products prod goods good item items detail details info
category categories cate search php html htm asp aspx jsp do shop store mall kr com net org co go or id no idx uid seq
num pcode code
""".split()


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def or_else(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def bare(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def joined(s: Column, h: Column, p: Column, q: Column) -> Column:
    return F.concat(s, F.lit("://"), h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalize_url(url: Column) -> Column:
    return joined(or_else(F.lower(scheme(url)), "https"), F.lower(host(url)), or_else(path(url), "/"), query(url))


def trimmed_path(url: Column) -> Column:
    return or_else(F.regexp_replace(path(url), "/+$", ""), "/")


def crawl_key(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(host(url)), trimmed_path(url), F.lit("?"), query(url))


def decoded(part_: Column) -> Column:
    """A query's name or value without its encoding; left as it is where that is broken."""
    return F.coalesce(F.try_url_decode(part_), part_)


def encoded(text: Column) -> Column:
    """Form encoding in which letters, digits and ``_.-~`` stand for themselves."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canon_url(url: Column) -> Column:
    """Product key: numeric parameters of three digits or more if there are any, else those that don't track; sorted.

    Parameters without a value don't count. They are decoded and encoded anew, so ``a=b%20c`` and ``a=b+c`` are one.
    """
    given = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]+=.+"))
    params = F.transform(given, lambda p: F.struct(decoded(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    digits = F.filter(params, lambda p: p["v"].rlike(r"^\d{3,}$"))
    rest = F.filter(params, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    kept = F.array_sort(F.when(F.size(digits) > 0, digits).otherwise(rest))
    return joined(scheme(url), F.lower(host(url)), trimmed_path(url), F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&"))


def norm_site(site: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(site)), "^https?://", "")
    return F.regexp_replace(F.split_part(s, F.lit("/"), F.lit(1)), r"^www\.", "")


def in_domain(h: Column, domain: Column) -> Column:
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def suffixes(h: Column) -> Column:
    """A host and all its parent domains, longest first: a suffix join becomes an equi-join on these."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_keywords(url: Column) -> Column:
    raw = F.filter(F.split(F.concat(path(url), F.lit(" "), query(url)), "[^0-9A-Za-z가-힣]+"), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(STOP_PARTS) & ~t.rlike(r"^\d+$"))
    first = lambda v: F.filter(v, lambda t, i: F.array_position(F.transform(v, F.lower), F.lower(t)) == i + 1)
    return F.get(F.transform(F.array(raw), first), F.lit(0))


def url_variants(url: Column) -> Column:
    s, h, p, q = scheme(url), host(url), path(url), query(url)
    tail = F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")), part(url, 8))
    made = lambda s_, h_, p_: F.concat(s_, F.lit("://"), h_, p_, tail)
    last = F.regexp_extract(p, "[^/]*$", 0)
    found = F.array(
        F.when(s == "http", made(F.lit("https"), h, p)),
        F.when(h.startswith("www."), made(s, F.substr(h, F.lit(5)), p)).when(h != "", made(s, F.concat(F.lit("www."), h), p)),
        F.when(p.endswith("/") & (F.length(p) > 1), made(s, h, F.regexp_replace(p, "/+$", ""))).when((p != "") & ~last.contains("."), made(s, h, F.concat(p, F.lit("/")))),
    )
    return F.array_except(F.array_distinct(F.array_compact(found)), F.array(url))


def slug(url: Column, n: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9._-]+", "_")
    return or_else(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(n)), "page")


def quote_plus(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/robots.txt"))


def decode_bing(href: Column) -> Column:
    """The target in ``u=a1<base64url>``; other addresses as they are."""
    code = F.regexp_extract(href, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    return F.when(code != "", F.decode(F.unbase64(padded), "UTF-8")).otherwise(href)


def decode_uddg(href: Column) -> Column:
    code = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(code != "", F.url_decode(code)).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
