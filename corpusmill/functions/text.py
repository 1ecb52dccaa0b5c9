"""Text cleaning, quality and token estimates as Column functions; everything runs in the JVM but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as boilerplate, separators and blanks.
BOILERPLATE = (
    r"^\s*("
    r"(accept|manage)\s+(all\s+)?cookies?|we\s+use\s+cookies|cookie\s+(policy|settings)|"
    r"subscribe( now)?|sign\s?up|log\s?in|sign\s?in|create an account|"
    r"share (this|on)|follow us|read more|related articles?|"
    r"advertisement|sponsored|©\s?\d{4}|all rights reserved|"
    r"skip to (main )?content|back to top|print this page|"
    r"이 사이트는 쿠키|쿠키를 사용|로그인|회원가입|구독|공유하기|광고|더 보기"
    r")"
)
NAV_LINE = r"^[\s>|•·\-–—*]+$"
BARE_URL = r"^\s*<?https?://\S+>?\s*$"
BLANKS = "[ \t ​‌‍﻿]+"
CJK_CHUNK = "[가-힣一-鿿ぁ-ゟ゠-ヿ]"
CJK_USAGE = "[ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯]"


WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside lambdas Catalyst would compute it wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalize(text: Column) -> Column:
    """Line ends, hyphenated line breaks, blanks and empty lines; NFKC is ``nfkc``. Null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, BLANKS, " "), r" *\n *", "\n")
    return strip(squeeze(t))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(df: DataFrame, name: str) -> DataFrame:
    """NFKC of a column, by an Arrow function over those rows alone that have a character it could change (see ``gated``)."""
    return gated(df, F.col(name).rlike(r"[^\x00-\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž]"), lambda d: d.withColumn(name, _nfkc(name)))


def gated(df: DataFrame, needed: Column, change) -> DataFrame:
    """change(rows that need it) and the other rows: a Python function inside CASE would run on every row."""
    need = F.coalesce(needed, F.lit(False))
    return df.where(~need).unionByName(change(df.where(need)))


def flatten_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^>\s?", ""), r"[*_`#]", "")


def _is_noise(line: Column) -> Column:
    def noise(s: Column) -> Column:
        return (s != "") & ((F.length(s) < 3) | s.rlike("(?U)" + NAV_LINE) | s.rlike("(?iU)" + BOILERPLATE + r"\b") | s.rlike("(?U)" + BARE_URL))

    return let(strip(line), noise)


def strip_boilerplate(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x: ~_is_noise(x))
    return F.array_join(F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x)), "\n")


def dedupe_lines(text: Column) -> Column:
    """Without later copies of lines whose lower-cased, blank-squeezed form is over 25 characters."""
    key = lambda x: F.regexp_replace(strip(F.lower(x)), BLANKS, " ")

    def kept(lines: Column) -> Column:
        # equal keys are neighbours once sorted, the first line first; so no line is sought among all others
        keyed = F.sort_array(F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        first = let(keyed, lambda v: F.filter(v, lambda x, j: (F.length(x["k"]) <= 25) | (j == 0) | (F.get(v, j - 1)["k"] != x["k"])))
        return F.transform(F.sort_array(F.transform(first, lambda x: x["i"])), lambda i: F.get(lines, i))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def clean(text: Column, flatten: bool = False) -> Column:
    t = normalize(text)
    t = flatten_markdown(t) if flatten else t
    return strip(squeeze(dedupe_lines(strip_boilerplate(t))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def quality_score(text: Column) -> Column:
    """0.5 for the share of letters, 0.4 for 200 words, 0.1 for words of 6 characters; rounded to 3, 0 for empty."""
    return let(text, _quality)


def _quality(text: Column) -> Column:
    w = words(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    mean = F.length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1))
    score = F.least(letters / F.length(text), F.lit(1.0)) * 0.5 + F.least(F.size(w) / 200.0, F.lit(1.0)) * 0.4 + F.least(mean / 6, F.lit(1.0)) * 0.1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(score, 3))


def est_tokens_chunk(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK_CHUNK))
    return F.greatest(F.lit(1), F.floor(cjk / 2) + F.floor((F.length(text) - cjk) / 4)).cast("long")


def est_tokens_usage(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK_USAGE))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.floor(cjk * 1.1 + (F.length(text) - cjk) / 4) + 1).cast("long")


def strip_md(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"[*`#>|]+", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def is_prose(s: Column) -> Column:
    """Mostly letters, five words, no row of numbers, few quotes."""
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    straight, curly = F.length(F.regexp_replace(s, r'[^"]', "")), F.length(F.regexp_replace(s, "[^“”]", ""))
    prose = (letters / F.length(s) >= 0.55) & (F.size(words(s)) >= 5) & ~s.rlike(r"(?U)(?:\b\d+\b[ ]){3,}") & (straight < 4) & (curly < 3)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(False)).otherwise(prose)


def sentences(text: Column, lines: bool = False) -> Column:
    """Split after sentence ends and blanks; ``lines``: at line ends as well."""
    return F.split(text, r"(?U)(?<=[.!?。！？])[\s\x1c-\x1f]+" + (r"|\n+" if lines else ""))


def trim_site_suffix(title: Column, site: Column) -> Column:
    """Without a tail that is a separator and exactly the site's name, if something is left."""
    own, out = F.lower(strip(F.coalesce(site, F.lit("")))), None
    for sep in (" | ", " - ", " – ", " — ", " · ", " :: "):
        cut = strip(F.left(title, F.length(title) - F.length(own) - len(sep)))
        hit = (own != "") & F.lower(title).endswith(F.concat(F.lit(sep), own)) & (cut != "")
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(title)


def truncate(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit(mark)))
