"""Prices in text and listings as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a price is written, and which words beside an amount say that it is none.
WON = r"(?:₩\s*([0-9][0-9,]*)|([0-9][0-9,]*)\s*(?:원|KRW))"
DIGITS = r"[0-9][0-9,]*(?:\.[0-9]+)?"
LABELS_BEFORE = "배송비|쿠폰|포인트|마일리지|적립"
LABELS_AFTER = "적립|쿠폰|포인트|마일리지"
MODEL_CODE = r"[a-z0-9]*\d{3,}[a-z0-9]*"
ROW_NOISE = r"[0-9][0-9,]*\s*(?:원|KRW)|\d+\s*%|\d+/\d+"
BLOCK_PAGE = r"access denied|forbidden|attention required|just a moment|are you a robot|page not found|error \d{3}|접근이 (?:거부|차단)|잘못된 (?:접근|요청)"


def as_won(raw: Column) -> Column:
    """Whole won; null for what is no number and for less than 100."""
    n = F.regexp_replace(raw, ",", "").try_cast("double")
    return F.when(n >= 100, F.floor(n).cast("long"))


def price_from_text(text: Column) -> Column:
    """The first amount, which must carry its currency."""
    return as_won(F.coalesce(F.nullif(F.regexp_extract(text, WON, 1), F.lit("")), F.nullif(F.regexp_extract(text, WON, 2), F.lit(""))))


def price_from_field(value: Column) -> Column:
    return as_won(F.nullif(F.regexp_extract(value.cast("string"), DIGITS, 0), F.lit("")))


def price_from_listing(row: Column) -> Column:
    """The amount after a discount, else the first; amounts beside words for shipping, points or coupons don't count.

    Match positions come from cutting the row at its amounts: what is left of an amount is the fragment before it.
    """
    found = F.regexp_extract_all(row, F.lit(WON), F.lit(0))
    gaps = F.split(F.regexp_replace(row, WON, "\u0001"), "\u0001")

    def item(match: Column, i: Column) -> Column:
        before, after = F.right(_left_of(found, gaps, i), F.lit(8)), F.left(_right_of(found, gaps, i), F.lit(4))
        ok = ~before.rlike(LABELS_BEFORE) & ~after.rlike(LABELS_AFTER)
        return F.struct(price_from_text(match).alias("price"), ok.alias("ok"), before.rlike(r"\d{1,2}\s*%\s*$").alias("cut"))

    items = F.filter(F.transform(found, item), lambda x: x["price"].isNotNull() & x["ok"])
    cut = F.filter(items, lambda x: x["cut"])
    return F.coalesce(F.get(cut, F.lit(0))["price"], F.get(items, F.lit(0))["price"])


def _left_of(found: Column, gaps: Column, i: Column) -> Column:
    """The last characters before amount i: its gap, preceded by the amount and gap before, which is more than look-behind needs."""
    earlier = F.when(i > 0, F.concat(F.get(gaps, i - 1), F.get(found, i - 1))).otherwise(F.lit(""))
    return F.concat(earlier, F.get(gaps, i))


def _right_of(found: Column, gaps: Column, i: Column) -> Column:
    return F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))


def model_codes(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ROW_NOISE, " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(MODEL_CODE), F.lit(0))))


def names_another(title: Column, query: Column) -> Column:
    want, got = model_codes(query), model_codes(title)
    return (F.size(want) > 0) & (F.size(got) > 0) & ~F.arrays_overlap(want, got)


def is_block_title(title: Column) -> Column:
    return (F.length(title) <= 60) & title.rlike("(?i)" + BLOCK_PAGE)


def won_range(start: Column, top: Column) -> Column:
    money = lambda c: F.format_number(c, 0)
    none = (F.coalesce(start, F.lit(0)) == 0) & (F.coalesce(top, F.lit(0)) == 0)
    return F.when(none, F.lit("가격문의")).when((F.coalesce(top, F.lit(0)) != 0) & (top != start), F.concat(money(start), F.lit("~"), money(top), F.lit("원"))).otherwise(F.concat(money(start), F.lit("원")))


def summary(quotes, by: list[str]):
    """Count, least, greatest, floored median and cheapest title of quotes (price, pos, url); null prices sort as 0."""
    return quotes.groupBy(*by).agg(
        F.count("*").alias("count"), F.min("price").alias("min"), F.max("price").alias("max"), F.floor(F.median("price")).cast("long").alias("median"),
        F.min_by("url", F.struct(F.coalesce("price", F.lit(0)), "pos")).alias("cheapest_url"),
    )
