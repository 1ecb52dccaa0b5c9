"""Fetch policy as columns and small joins: blocks, escalation, retries, robots, throttling."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Fixed values.
BLOCK_MARKERS = ("captcha", "unusual traffic", "verify you are human", "are you a robot", "consent.bing", "/tou/", "before you continue", "cf-browser-verification", "checking your browser", "just a moment", "enable javascript and cookies", "access denied", "ddos protection by")
BLOCK_STATUSES = (403, 429, 503)
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
ERROR_STATUS = {"unknown_provider": 400, "no_key": 428, "no_model": 428, "not_installed": 428, "unauthorized": 401, "rate_limit": 429, "unreachable": 502, "server_error": 502, "bad_response": 502}
ENGINES = [("static", 0, True), ("scrapling", 1, True), ("chrome", 2, True), ("dynamic", 3, False), ("stealth", 4, False)]


def looks_blocked(status: Column, body: Column) -> Column:
    low = F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(20_000)))
    hit = F.lit(False)
    for m in BLOCK_MARKERS:
        hit = hit | low.contains(m)
    return status.isin(*BLOCK_STATUSES) | hit


def should_escalate(status: Column, words: Column, thin: int = 50) -> Column:
    return F.when((status == 0) | status.isin(*BLOCK_STATUSES), True).when(status != 200, False).otherwise(words < thin)


def retry_after(value: Column) -> Column:
    """Delta seconds, at most 30; null for garbage. Dates are measured against the session's clock."""
    v = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, "^[A-Za-z]+, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    secs = F.unix_timestamp(date) - F.unix_timestamp(F.current_timestamp())
    return F.when(v.rlike(r"^\d+$"), F.least(v.cast("double"), F.lit(30.0))).when(date.isNotNull(), F.greatest(F.lit(0.0), F.least(secs.cast("double"), F.lit(30.0))))


def ip_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    at = lambda i: F.get(p, F.lit(i)).try_cast("long")
    return ((at(0) * 256 + at(1)) * 256 + at(2)) * 256 + at(3)


@F.pandas_udf(BooleanType())
def private_v6(ip: pd.Series) -> pd.Series:
    """Whether an IPv6 address is private, loopback, link-local, reserved, multicast or unspecified (an IPv4 address within one counts as that); null for what is none."""

    def one(x):
        try:
            a = ipaddress.IPv6Address(x.split("%")[0])
        except (ValueError, AttributeError):
            return None
        a = a.ipv4_mapped or a
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified

    return pd.Series([one(x) for x in ip], dtype=object)


def private_ip(ip: Column) -> Column:
    """An address in a private, loopback, link-local, reserved or multicast range; null for what is none. IPv4 stays in the JVM."""
    n, hit = ip_number(ip), F.lit(False)
    for net in PRIVATE:
        base, bits = net.split("/")
        low = int.from_bytes(bytes(map(int, base.split("."))), "big")
        hit = hit | n.between(low, low + 2 ** (32 - int(bits)) - 1)
    return F.when(n.isNotNull(), hit).when(ip.contains(":"), private_v6(F.when(ip.contains(":"), ip)))


def error_kind(status: Column) -> Column:
    return F.when(status.isin(401, 403), "unauthorized").when(status == 429, "rate_limit").when(status >= 500, "server_error").otherwise("http")


def error_status(kind: Column) -> Column:
    """The status that an error kind answers with; 500 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_STATUS.items() for x in kv]), kind), F.lit(500))


def result_budget(budget: int, results: Column) -> Column:
    """Characters for each of some results, at least one."""
    return F.floor(F.lit(budget) / F.greatest(results, F.lit(1)))


def clamp(value: Column, default: int, lo: int, hi: int) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(lo)), F.lit(hi))


def throttled(requests: DataFrame, host: str, arrival: str, order: str, gap: float) -> DataFrame:
    """requests with the ``slot`` when each may start: a host's slots are at least ``gap`` apart.

    slot_k = max(arrival_k, slot_(k-1) + gap), which is gap * k plus the running maximum of arrival_j - gap * j: a window, no
    fold over the host's requests.
    """
    by = Window.partitionBy(host).orderBy(arrival, order)
    k = F.row_number().over(by) - 1
    lead = F.max(F.col(arrival) - gap * F.col("__k")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("__k", k).withColumn("slot", gap * F.col("__k") + lead).drop("__k")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with ``allowed``: the first rule (by pos) of the host whose prefix fits decides; none allows.

    Rules come as one array a host and are tried within the row, so a hot host's rows do not multiply.
    """
    by_host = rules.groupBy(F.col("host").alias("__host")).agg(F.array_sort(F.collect_list(F.struct("pos", "prefix", "allow"))).alias("__rules"))
    first = F.get(F.filter("__rules", lambda r: F.coalesce(F.col("path"), F.lit("")).startswith(r["prefix"])), F.lit(0))
    return urls.join(by_host, urls["host"] == F.col("__host"), "left").select(*[urls[c] for c in urls.columns], F.coalesce(first["allow"], F.lit(True)).alias("allowed"))


def best_render(renders: DataFrame) -> DataFrame:
    """The fullest render of each url, the weaker engine on ties."""
    return renders.groupBy("url").agg(F.max_by(F.struct("engine", "words"), F.struct("words", -F.col("tier"))).alias("b")).select("url", "b.engine", "b.words")


def first_nonempty(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of the candidates of each group, those of its first source (by priority) that has any."""
    return candidates.withColumn("__p", F.min("priority").over(Window.partitionBy(*by))).where("priority = __p").drop("__p")


def escalated(renders: DataFrame, thin: int = 50) -> DataFrame:
    """(url, engine, words, tried, escalated_from) of renders (url, engine, tier, status, words, ok): what a climb of the engines gives.

    The weakest engine's render counts first. If that calls for another engine, each stronger one's is taken if it is ok and
    fuller than all before, and the climb stops at the first taken one that doesn't call for more; ``tried`` are the engines up to there.
    ``escalated_from`` names the first engine where another one's render won. Null words are none.
    """
    by = Window.partitionBy("url").orderBy("tier", "engine")
    words = F.coalesce("words", F.lit(0))
    counts = F.when((F.row_number().over(by) == 1) | F.col("ok"), words)
    rows = renders.select("url", "engine", "tier", words.alias("words"), F.row_number().over(by).alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), should_escalate(F.col("status"), words, thin).alias("more"), counts.alias("counts"))
    before = F.max("counts").over(by.rowsBetween(Window.unboundedPreceding, -1))
    taken = rows.withColumn("taken", (F.col("at") == 1) | (F.col("ok") & (F.col("words") > before)))
    one = F.struct("at", "engine", "words")
    agg = taken.groupBy("url").agg(F.min(F.when(F.col("at") == 1, one)).alias("start"), F.max(F.when((F.col("at") == 1) & ~F.col("more"), True)).alias("enough"), F.min(F.when(F.col("taken") & ~F.col("more"), one)).alias("good"), F.max(F.when(F.col("taken"), one)).alias("last"), F.max("at").alias("all"))
    won = F.when(F.col("enough"), F.col("start")).otherwise(F.coalesce("good", "last"))
    told = agg.select("url", "start", won.alias("won"), F.coalesce(F.when(F.col("enough"), 1), F.col("good.at"), "all").alias("tried"))
    return told.select("url", "won.engine", "won.words", "tried", F.when(F.col("won.at") > 1, F.col("start.engine")).alias("escalated_from"))


def clamped(value: Column, name: str, default: int, lo: int, hi: int) -> Column:
    """struct(n, error): a whole number within bounds, the default for null; what is no whole number has no n and an error that names it."""
    n = F.trim(value).try_cast("int")
    told = F.concat(F.lit(f"'{name}' must be an integer, got '"), value, F.lit("'"))
    bounded = F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(lo)), F.lit(hi))
    return F.struct(F.when(value.isNull() | n.isNotNull(), bounded).alias("n"), F.when(value.isNotNull() & n.isNull(), told).alias("error"))
