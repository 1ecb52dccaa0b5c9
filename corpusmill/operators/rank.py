"""Tokens, BM25, passage ranking and extractive answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Token characters and stop words.
TOKEN = "[0-9A-Za-zÀ-ɏ가-힣一-鿿]+"
STOP = """
a an and are as at be by for from has have he in is it its of on that the to was were will with
this these those or nor not but if then else when while do does did done being been
그 이 저 것 수 등 및 는 은 이 가 을 를 에 의 와 과 도 로 으로 에서 부터 까지 그리고 그러나 하지만
""".split()
K1, B = 1.5, 0.75


def tokenize(text: Column) -> Column:
    """Lower-cased tokens over one character that are no stop words; a token with Hangul or Han adds its character pairs."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    plain = F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(plain, lambda t: F.when(t.rlike(T.CJK_CHUNK), F.concat(F.array(t), pairs(t))).otherwise(F.array(t))))


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, repeats kept, as the column function makes them."""
    out: list[str] = []
    for t in re.findall(TOKEN, query):
        t = t.lower()
        if len(t) > 1 and t not in STOP:
            out.append(t)
            if re.search(T.CJK_CHUNK, t):
                out += [t[i : i + 2] for i in range(len(t) - 1)]
    return out


def term_freq(passages: DataFrame, key: str) -> DataFrame:
    return passages.select(key, F.explode_outer(tokenize(F.col("text"))).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scores(passages: DataFrame, query: str, group: list[str] | None = None) -> DataFrame:
    """passages (with ``text``) and their BM25 ``score``; statistics over all passages, or within ``group``.

    Only the query's terms are counted, in place, so no postings are shuffled. Over all passages the statistics (a few
    numbers) come from one aggregation with map-side combining; within a group from a window by the group.
    """
    terms = query_tokens(query)
    uniq = list(dict.fromkeys(terms))
    tok = passages.withColumn("__t", tokenize(F.col("text")))
    is_term = lambda w: lambda x: x == w
    counts = [F.size(F.filter("__t", is_term(w))).alias(f"__tf{i}") for i, w in enumerate(uniq)]
    tok = tok.select(*passages.columns, F.size("__t").alias("__dl"), *counts)
    stats = [F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(uniq))]]
    if group is None:
        row = tok.agg(*stats).first().asDict()
        value = lambda name: F.lit(row[name])
    else:
        over = Window.partitionBy(*group)
        tok = tok.select("*", F.count("*").over(over).alias("__n"), F.avg("__dl").over(over).alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).over(over).alias(f"__df{i}") for i in range(len(uniq))])
        value = F.col
    total = F.lit(0.0)
    for t in terms:
        i = uniq.index(t)
        tf = F.col(f"__tf{i}")
        part = idf(value("__n"), value(f"__df{i}")) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("__dl") / F.coalesce(F.nullif(value("__avg"), F.lit(0.0)), F.lit(1.0))))
        total = total + F.when(tf > 0, part).otherwise(F.lit(0.0))
    return tok.select(*passages.columns, total.alias("score"))


def normalized(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Scores over the greatest, rounded to 4; all zero where the greatest is not positive."""
    if group is None:
        top = scored.agg(F.max("score")).first()[0] or 0.0
        hi = F.lit(float(top))
    else:
        hi = F.max("score").over(Window.partitionBy(*group))
    return scored.withColumn("score", F.when(hi > 0, F.round(F.col("score") / hi, 4)).otherwise(F.lit(0.0)))


def top_passages(passages: DataFrame, query: str, group: list[str], order: str, k: int) -> DataFrame:
    """The k best positive passages of each group, with scores of their own group; ties by order."""
    raw = scores(passages, query, group)
    best = raw.withColumn("__hi", F.max("score").over(Window.partitionBy(*group))).where("score > 0")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round("score", 9)), order)))
    return ranked.where(F.col("rank") <= k).withColumn("score", F.round(F.col("score") / F.col("__hi"), 4)).drop("__hi")


def scored_items(items: Column, query: str) -> Column:
    """array<struct<neg, pos, text, score>> of an array<struct<pos, text>>: BM25 among the items of one row, those that score, best first, ties by pos.

    All statistics are the row's own, so nothing is shuffled; null or no items give none.
    """
    terms = query_tokens(query)
    uniq = list(dict.fromkeys(terms))
    is_term = lambda w: lambda x: x == w
    has = lambda i: lambda x: x[f"tf{i}"] > 0
    counted = F.transform(items, lambda x: T.let(tokenize(x["text"]), lambda t: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), F.size(t).alias("dl"), *[F.size(F.filter(t, is_term(w))).alias(f"tf{i}") for i, w in enumerate(uniq)])))

    def all_(v: Column) -> Column:
        stats = F.struct(F.size(v).alias("n"), (F.aggregate(v, F.lit(0), lambda acc, x: acc + x["dl"]) / F.greatest(F.size(v), F.lit(1))).alias("avg"), *[F.size(F.filter(v, has(i))).alias(f"df{i}") for i in range(len(uniq))])

        def score(x: Column, st: Column) -> Column:
            total = F.lit(0.0)
            for t in terms:
                i = uniq.index(t)
                tf = x[f"tf{i}"]
                part = idf(st["n"], st[f"df{i}"]) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * x["dl"] / F.coalesce(F.nullif(st["avg"], F.lit(0.0)), F.lit(1.0))))
                total = total + F.when(tf > 0, part).otherwise(F.lit(0.0))
            return total

        some = F.filter(v, lambda x: F.greatest(F.lit(0), *[x[f"tf{i}"] for i in range(len(uniq))]) > 0)
        return T.let(stats, lambda st: F.transform(some, lambda x: T.let(score(x, st), lambda s: F.struct((-F.round(s, 9)).alias("neg"), x["pos"].alias("pos"), x["text"].alias("text"), s.alias("score")))))

    return F.sort_array(F.filter(T.let(counted, all_), lambda x: x["score"] > 0))


def ranked_items(items: Column, query: str, k: int) -> Column:
    """array<struct<rank, pos, text, score>>: the k best of ``scored_items``, scores over the greatest, rounded to 4."""
    return T.let(scored_items(items, query), lambda v: F.transform(F.slice(v, 1, k), lambda x, i: F.struct((i + 1).alias("rank"), x["pos"].alias("pos"), x["text"].alias("text"), F.round(x["score"] / F.array_max(F.transform(v, lambda y: y["score"])), 4).alias("score"))))


def line_items(text: Column, least: int = 40) -> Column:
    """The lines of a text that are long enough, as passages with their place."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"))), lambda x: F.length(x["text"]) >= least)


def sentence_items(text: Column) -> Column:
    """The sentences of a text that are prose, without Markdown, 30 to 400 characters long, with their place."""
    raw = F.filter(F.transform(T.sentences(text, lines=True), lambda x, i: F.struct(i.alias("pos"), x.alias("text"))), lambda x: F.length(x["text"]) >= 30)
    plain = F.transform(raw, lambda x: F.struct(x["pos"].alias("pos"), T.strip_md(x["text"]).alias("text")))
    return F.filter(plain, lambda x: F.length(x["text"]).between(30, 400) & T.is_prose(x["text"]))


def may_match(text: Column, query: str) -> Column:
    """False only for texts in which no term of the query can be a token."""
    low, hit = F.lower(text), F.lit(False)
    for t in dict.fromkeys(query_tokens(query)):
        hit = hit | low.contains(t)
    return hit


def document_passages(docs: DataFrame, query: str, k: int = 4) -> DataFrame:
    """(doc_id, rank, pos, text, score): the k best lines of each document, chosen within its row. Null texts have none."""
    return docs.where(may_match(F.col("text"), query)).select("doc_id", F.explode(ranked_items(line_items(F.col("text")), query, k)).alias("p")).select("doc_id", "p.*")


def document_answers(docs: DataFrame, query: str, top: int = 6, budget: int = 700) -> DataFrame:
    """(doc_id, answer) of the documents that have one, as ``answer`` makes it of a document's sentences, within its row."""

    def join(v: Column) -> Column:
        keys = F.transform(v, lambda x: F.lower(F.left(x["text"], F.lit(60))))
        own = F.filter(v, lambda x, i: F.array_position(keys, F.lower(F.left(x["text"], F.lit(60)))) == i + 1)  # of ``top`` sentences
        run = lambda u, i: F.aggregate(F.slice(u, F.lit(1), i + 1), F.lit(0), lambda acc, y: acc + F.length(y["text"]))
        return T.let(own, lambda u: F.array_join(F.transform(F.filter(u, lambda x, i: (i == 0) | (run(u, i) <= budget)), lambda x: x["text"]), " "))

    best = F.slice(scored_items(sentence_items(F.col("text")), query), 1, top)
    return docs.where(may_match(F.col("text"), query)).select("doc_id", T.let(best, lambda v: F.when(F.size(v) > 0, join(v))).alias("answer")).where("answer is not null")


def passages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): the lines of a document, as passages."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.length("text") >= 40)


def answer(passages: DataFrame, query: str, group: list[str], order: list[str], top: int = 6, budget: int = 700) -> DataFrame:
    """An extractive answer for each group: its six best prose sentences, without repeats of their first 60 characters, up to the first that goes over the budget."""
    cut = passages.select(*group, *order, F.posexplode_outer(T.sentences(F.col("text"), lines=True)).alias("spos", "raw")).where("spos is not null and length(raw) >= 30")
    sents = cut.select(*group, *order, "spos", T.strip_md(F.col("raw")).alias("text")).where(F.length("text").between(30, 400) & T.is_prose(F.col("text")))
    by = Window.partitionBy(*group)
    seq = sents.withColumn("seq", F.row_number().over(by.orderBy(*order, "spos")))
    best = top_passages(seq, query, group, "seq", top)
    key = F.lower(F.left("text", F.lit(60)))
    first = best.withColumn("__k", F.row_number().over(Window.partitionBy(*group, key).orderBy("rank"))).where("__k = 1")
    run = first.withColumn("__sum", F.sum(F.length("text")).over(by.orderBy("rank"))).withColumn("__n", F.row_number().over(by.orderBy("rank")))
    kept = run.where((F.col("__sum") <= budget) | (F.col("__n") == 1))
    return kept.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("answer"))
