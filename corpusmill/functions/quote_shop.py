"""A quote shop: a site without a keyword search, whose menu lists categories and whose product pages state parts and prices.

Pages are read once into structs by Arrow functions; ranking, prices, Markdown and passages are Column functions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import prices as P
from corpusmill.functions.html import Laid, Node, tree
from corpusmill.functions.urls import host as host_of
from corpusmill.operators import rank
from corpusmill.sources.tables import shared_dir

# The shop's domains, addresses, class names, labels and wordings.
DOMAINS = ("itmaya.co.kr", "itmaya.com")
LIST_PAGE, PRODUCT_PAGE = "server_list.php", "server_view.php"
MENU_SET, MENU_TITLE, TITLE = "sub_set", "menu_tit", "tit"
BASE_LOW, BASE_HIGH, GROUP, GROUP_NAME = "price_system_start", "price_system_top", "group_component", "name"
OPTION_NAME, OPTION_LOW, OPTION_HIGH = "agree_txt", "pay_start", "pay_top"
MODEL_BOXES, MODEL_TITLE, PHONE, PHONE_NUMBER = ("r_box_fixed", "r_box"), "title", "tel", "num"
DELIVERY, QUOTE_TIME = "예상딜리버리", "예상견적시간"
CAVEAT = "예상가(VAT 별도), 최종 견적은 구성 확정 후 엔지니어 검토"
NAMELESS, NO_LIST_PRODUCTS = "Itmaya 서버", "구성별 견적"
OPTIONS_IN_PASSAGE = 15

OPTION = "struct<name:string,low:long,high:long>"
PRODUCT = f"struct<model:string,tel:string,delivery:string,quote_time:string,base_low:long,base_high:long,groups:array<struct<name:string,required:boolean,most:string,options:array<{OPTION}>>>>"
LINKS = "array<struct<label:string,url:string,key:string>>"


def handles(host: Column) -> Column:
    """Whether the shop's adapter is for a host: one of its domains, or a host below it; www. counts for nothing."""
    own = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", "")
    hit = F.lit(False)
    for d in DOMAINS:
        hit = hit | (own == d) | own.endswith("." + d)
    return hit


def amount(text: Column) -> Column:
    """All digits of a text as one number, 0 if there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def label(text: Column) -> Column:
    """One line without the colons and dots at its end."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(line, "[ :：·]+$", ""))


# Reading.


def line(n: Node | None) -> str:
    return " ".join(n.text().split()) if n is not None else ""


def digits(n: Node | None) -> int:
    found = re.sub("[^0-9]", "", line(n))
    return int(found) if found else 0


def classed(n: Node, name: str, whole: bool = True) -> bool:
    given = n.attrs.get("class", "")
    return name in (given.split() if whole else given)


def below(n: Node, *names: str, whole: bool = False) -> Node | None:
    """The first element under n whose class has the last name, within ones that have the names before it."""
    for x in n.walk():
        if x is not n and classed(x, names[0], whole):
            found = x if len(names) == 1 else below(x, *names[1:], whole=whole)
            if found is not None:
                return found
    return None


def above(n: Node) -> Iterator[Node]:
    while (n := n.parent) is not None:
        yield n


def links_to(root: Node, page: str, base: str) -> Iterator[tuple[Node, str, str]]:
    """(anchor, address, query) of the links to a kind of page, each query once."""
    seen = set()
    for n in root.walk():
        if n.tag == "a" and page in n.attrs.get("href", ""):
            try:
                url = urljoin(base, n.attrs["href"])
                key = urlsplit(url).query
            except ValueError:
                continue
            if key and key not in seen:
                seen.add(key)
                yield n, url, key


def read_menu(page: str | None, base: str) -> list[dict]:
    """Categories of a homepage's menu; a label is the link's text and the titles around it, each once."""
    out, seen = [], set()
    for a, url, key in links_to(tree(page or ""), LIST_PAGE, base):
        titles = [line(a)] + [line(n) for n in reversed(list(above(a))) if classed(n, TITLE, False)]
        block = next((n for n in above(a) if n.tag == "div" and classed(n, MENU_SET, False)), None)
        heads = [n for n in block.walk() if n.tag == "div" and classed(n, MENU_TITLE, False)] if block else []
        titles += [line(t) for h in heads for t in h.walk() if t is not h and classed(t, TITLE, False)]
        text = " ".join(dict.fromkeys(filter(None, titles)))
        if text and key not in seen:
            seen.add(key)
            out.append({"label": text, "url": url, "key": key})
    return out


def read_products(page: str | None, base: str) -> list[dict]:
    """Product links of a category's page."""
    return [{"label": line(a), "url": url, "key": key} for a, url, key in links_to(tree(page or ""), PRODUCT_PAGE, base)]


def read_group(group: Node) -> dict:
    name = next((line(c) for c in group.children if isinstance(c, Node) and classed(c, GROUP_NAME)), "")
    options = []
    for n in group.walk():
        if n.tag == "input" and "data-idx" in n.attrs:
            own = re.sub(r"^x\s+", "", line(below(n.parent, OPTION_NAME)))
            if own:
                options.append({"name": own, "low": digits(below(n.parent, OPTION_LOW)), "high": digits(below(n.parent, OPTION_HIGH))})
    return {"name": name, "required": group.attrs.get("data-required") == "y", "most": group.attrs.get("data-max", ""), "options": options}


def read_product(page: str | None) -> dict:
    """What a product page states. The totals that its script writes over are not read, only what they are made of."""
    root = Laid(tree(page or ""))
    said: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "dt":
            rest = n.parent.children[n.parent.children.index(n) + 1 :]
            answer = next((c for c in rest if isinstance(c, Node) and c.tag == "dd"), None)
            key = re.sub("[ :：·]+$", "", line(n)).strip()
            if answer is not None:
                said[key] = line(answer)
    model = next((m for box in MODEL_BOXES if (m := line(below(root, box, MODEL_TITLE)))), "")
    groups = [read_group(n) for n in root.walk() if classed(n, GROUP)]
    return {
        "model": model, "tel": line(below(root, PHONE, PHONE_NUMBER)), "delivery": said.get(DELIVERY, ""), "quote_time": said.get(QUOTE_TIME, ""),
        "base_low": digits(below(root, BASE_LOW, whole=True)), "base_high": digits(below(root, BASE_HIGH, whole=True)),
        "groups": [g for g in groups if g["name"] and g["options"]],
    }


def with_product(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``product`` (see PRODUCT); a null page states nothing. A page is read once: filters on ``product`` don't repeat the function."""

    @F.pandas_udf(PRODUCT)
    def run(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_product(x) for x in htmls], columns=["model", "tel", "delivery", "quote_time", "base_low", "base_high", "groups"])

    return pages.withColumn("product", run.asNondeterministic()(F.col(html)))


def with_links(pages: DataFrame, menu: bool, html: str = "html", url: str = "url") -> DataFrame:
    """pages with ``links``: a homepage's categories, or a category page's products."""

    @F.pandas_udf(LINKS)
    def run(htmls: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([(read_menu if menu else read_products)(h, u or "") for h, u in zip(htmls, urls)], dtype=object)

    return pages.withColumn("links", run.asNondeterministic()(F.col(html), F.col(url)))


# Prices, Markdown and passages of what was read.


def price_note() -> Column:
    base = P.won_range(F.col("product.base_low"), F.col("product.base_high"))
    return F.when(F.col("product.base_low") > 0, F.concat(F.lit("시스템 기본가 "), base, F.lit(f"~ (구성요소 추가 시 합산, {CAVEAT})"))).otherwise(f"구성별 견적 ({CAVEAT})")


def model_name() -> Column:
    return F.coalesce(F.nullif(F.col("product.model"), F.lit("")), F.lit(NAMELESS))


def parts_of(pages: DataFrame) -> DataFrame:
    """A row an option of each product: the other columns, part, option, low, high."""
    rest = [c for c in pages.columns if c != "product"]
    one = pages.select(*rest, F.explode("product.groups").alias("g"))
    return one.select(*rest, F.col("g.name").alias("part"), F.explode("g.options").alias("o")).select(*rest, "part", F.col("o.name").alias("option"), "o.low", "o.high")


def _priced(o: Column, between: str) -> Column:
    return F.concat(o["name"], F.lit(between), P.won_range(o["low"], o["high"]))


def markdown() -> Column:
    """The product page as Markdown: model, base price, contact, times, and parts with their prices."""
    p = lambda f: F.col(f"product.{f}")
    some = lambda c, text: F.when(c, text)
    base = F.when(p("base_low") > 0, F.concat(F.lit("**시스템 기본가:** "), P.won_range(p("base_low"), p("base_high")), F.lit(f"  ({CAVEAT})"))).otherwise(f"**가격:** 구성별 견적 — {CAVEAT}")

    def group(g: Column) -> Column:
        terms = F.array_compact(F.array(some(g["required"], F.lit("필수")), some(~g["most"].isin("", "0"), F.concat(F.lit("최대 "), g["most"], F.lit("개")))))
        head = F.concat(F.lit("### "), g["name"], F.when(F.size(terms) > 0, F.concat(F.lit(" ("), F.array_join(terms, ", "), F.lit(")"))).otherwise(""))
        return F.concat(head, F.lit("\n"), F.array_join(F.transform(g["options"], lambda o: F.concat(F.lit("- "), _priced(o, ": "))), "\n"))

    lines = F.array_compact(F.array(
        F.concat(F.lit("# "), model_name(), F.lit("\n")), base, some(p("tel") != "", F.concat(F.lit("**견적 문의:** "), p("tel"))),
        some(p("delivery") != "", F.concat(F.lit(f"**{DELIVERY}:** "), p("delivery"))), some(p("quote_time") != "", F.concat(F.lit(f"**{QUOTE_TIME}:** "), p("quote_time"))),
        some(F.size(p("groups")) > 0, F.lit("\n## 구성요소별 가격 (기본가에 합산)")),
    ))
    return F.array_join(F.concat(lines, F.transform(p("groups"), group)), "\n")


def passages() -> Column:
    """What can be ranked of a product: model and base price first, then times, then each group's first options."""
    p = lambda f: F.col(f"product.{f}")
    base = F.when(p("base_low") > 0, F.concat(F.lit("시스템 기본가 "), P.won_range(p("base_low"), p("base_high")), F.lit(f" ({CAVEAT})"))).otherwise("구성별 견적")
    lead = F.concat(model_name(), F.lit(" — "), base, F.when(p("tel") != "", F.concat(F.lit(" · 문의 "), p("tel"))).otherwise(""))
    times = [F.when(p(f) != "", F.concat(F.lit(f"{name}: "), p(f))) for f, name in (("delivery", DELIVERY), ("quote_time", QUOTE_TIME))]
    group = lambda g: F.concat(g["name"], F.lit(" 가격: "), F.array_join(F.transform(F.slice(g["options"], 1, OPTIONS_IN_PASSAGE), lambda o: _priced(o, " ")), "; "))
    return F.concat(F.array_compact(F.array(lead, *times)), F.transform(p("groups"), group))


# Search.


def search(categories: DataFrame, lists: DataFrame, products: DataFrame, query: str, n: int) -> DataFrame:
    """(rank, title, url, snippet): the products of the categories whose labels score best for the query, at most n; without any, the categories.

    categories: label, url (each once, in the menu's order ``pos``); lists: url of a category, and its product ``links`` or the page's html;
    products: url, and product or the page's html. Of pages given as html only those that a shopper would open are read. Labels are ranked by BM25 among each other, and only those that score count. A product that
    several categories list stands with the first. A menu has a few hundred categories; what is ordered in one task is
    at most the products that they list.
    """
    from pyspark.sql import Window

    if not query.strip():
        return categories.sparkSession.createDataFrame([], "rank int, title string, url string, snippet string")
    scored = rank.scores(categories.select("pos", "url", F.col("label").alias("text")), query).where("score > 0")
    best = scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "pos")))
    lists = lists if "links" in lists.columns else with_links(lists.join(F.broadcast(best.select("url").distinct()), "url", "left_semi").select("url", "html"), False)
    each = best.join(lists.select("url", F.posexplode("links").alias("at", "link")), "url").select("place", "at", F.col("text").alias("category"), F.col("link.url").alias("to"), F.col("link.key").alias("key"))
    one = each.groupBy("key").agg(F.min(F.struct("place", "at", "category", "to")).alias("l")).select("l.*").orderBy("place", "at").limit(n)
    path = f"{shared_dir(one.sparkSession)}/found-{uuid.uuid4().hex}"  # n rows, used three times
    one.write.parquet(path)
    one = one.sparkSession.read.schema(one.schema).parquet(path)
    if "product" not in products.columns:
        products = with_product(products.join(F.broadcast(one.select(F.col("to").alias("url")).distinct()), "url", "left_semi").select("url", "html"))
    found = one.join(products.select(F.col("url").alias("to"), "product"), "to", "left")
    tel = F.when(F.coalesce(F.col("product.tel"), F.lit("")) != "", F.concat(F.lit(" · ☎"), F.col("product.tel"))).otherwise("")
    snippet = F.concat(F.lit("["), F.element_at(F.split("category", " "), -1), F.lit("] "), price_note(), tel)
    rows = found.select("place", "at", model_name().alias("title"), F.col("to").alias("url"), snippet.alias("snippet"))
    plain = best.select("place", F.lit(0).alias("at"), F.col("text").alias("title"), "url", F.lit(NO_LIST_PRODUCTS).alias("snippet")).orderBy("place").limit(n)
    none = plain.join(F.broadcast(one.agg(F.count("*").alias("have"))), F.col("have") == 0).drop("have")
    return rows.unionByName(none).select(F.row_number().over(Window.orderBy("place", "at")).alias("rank"), "title", "url", "snippet")


def routed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with ``adapter``: whether this shop reads them itself, which it does with product pages only."""
    return pages.withColumn("adapter", handles(host_of(F.col(url))) & F.col(url).contains(PRODUCT_PAGE))
