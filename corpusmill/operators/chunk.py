"""Chunking in Catalyst: where pieces and chunks end is found by adding up lengths, and their texts are cut out once.

A fold over sentences or pieces carries numbers (the length so far, the number of the first item) and touches text only where a piece or
chunk ends, so a document costs its own length. Sums of lengths hold as long as items have no blanks at their ends. That is so but
for the pieces of a wrapped sentence and for control characters that some blanks are; texts with these go item by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

EMPTY = "struct(cast(array() as array<string>) as parts, '' as cur)"
NONE = "cast(array() as array<string>)"


def bare(items: Column) -> Column:
    """No item has blanks at its ends or is empty."""
    return F.forall(items, lambda x: (x != "") & (T.strip(x) == x))


def joined(items: Column, first: Column, upto: Column, by: str) -> Column:
    """Items number first to upto (exclusive) as one text."""
    return F.array_join(F.slice(items, first + 1, upto - first), by)


def wrapped(text: Column, size: int) -> Column:
    """A last remainder: cut every ``size`` characters if it is longer; none if it is empty."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > size, pieces).when(text != "", F.array(text)).otherwise(F.expr(NONE))


def packed_sentences(sentences: Column, size: int) -> Column:
    """Sentences without blanks at their ends, packed by the sums of their lengths."""
    init = F.struct(F.expr("cast(array() as array<int>)").alias("cuts"), F.lit(0).alias("len"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["i"] > 0) & (acc["len"] + F.length(s) + 1 > size)
        return F.struct(
            F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(full | (acc["i"] == 0), F.length(s)).otherwise(acc["len"] + F.length(s) + 1).alias("len"), (acc["i"] + 1).alias("i"),
        )

    def cut(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), ends)
        whole = F.transform(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("a"), ends.alias("b")), lambda x: joined(sentences, x["a"], x["b"], " "))
        return F.concat(whole, T.let(joined(sentences, F.element_at(starts, -1), F.size(sentences), " "), lambda rest: wrapped(rest, size)))

    return T.let(F.aggregate(sentences, init, step, lambda acc: acc["cuts"]), cut)


def folded_sentences(sentences: Column, size: int) -> Column:
    """Any sentences, packed text by text."""

    def step(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) + 1 > size)
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(T.strip(acc["cur"])))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, s).otherwise(T.strip(F.concat(acc["cur"], F.lit(" "), s))).alias("cur"),
        )

    return F.aggregate(sentences, F.expr(EMPTY), step, lambda acc: F.concat(acc["parts"], wrapped(acc["cur"], size)))


def split_long(paragraph: Column, size: int = 1000) -> Column:
    """Sentences packed up to size; only an oversize last remainder is hard-wrapped."""
    packed = T.let(T.sentences(paragraph), lambda s: F.when(bare(s), packed_sentences(s, size)).otherwise(folded_sentences(s, size)))
    return F.when(F.length(paragraph) <= size, F.array(paragraph)).otherwise(packed)


def pieces(text: Column, size: int = 1000) -> Column:
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), T.strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: split_long(p, size)))


def packed_pieces(items: Column, size: int, overlap: int) -> Column:
    """Pieces without blanks at their ends, packed by the sums of their lengths. ``lead``: the blanks that the carried tail begins with, which go when a second piece is added."""
    init = F.struct(F.expr(NONE).alias("parts"), F.lit("").alias("tail"), F.lit(0).alias("first"), F.lit(0).alias("len"), F.lit(0).alias("lead"), F.lit(0).alias("i"))
    left = lambda c: F.ltrim(c, F.lit(T.WHITE))

    def current(acc: Column) -> Column:
        text = F.concat(F.when(acc["tail"] != "", F.concat(acc["tail"], F.lit("\n\n"))).otherwise(""), joined(items, acc["first"], acc["i"], "\n\n"))
        return F.when(acc["i"] - acc["first"] >= 2, left(text)).otherwise(text)

    def state(parts, tail, first, length, lead, i) -> Column:
        return F.struct(parts.alias("parts"), tail.alias("tail"), first.alias("first"), length.cast("int").alias("len"), lead.cast("int").alias("lead"), i.alias("i"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["i"] > 0) & (acc["len"] + F.length(p) + 2 > size)
        ended = lambda c: T.let(F.right(c, F.lit(overlap)), lambda t: state(F.concat(acc["parts"], F.array(T.strip(c))), t, acc["i"], F.length(t) + F.when(t != "", 2).otherwise(0) + F.length(p), F.length(t) - F.length(left(t)), acc["i"] + 1))
        more = acc["len"] + 2 + F.length(p) - F.when(acc["i"] - acc["first"] == 1, acc["lead"]).otherwise(0)
        on = state(acc["parts"], acc["tail"], acc["first"], F.when(acc["i"] == 0, F.length(p)).otherwise(more), acc["lead"], acc["i"] + 1)
        return F.when(full, T.let(current(acc), ended)).otherwise(on)

    return F.aggregate(items, init, step, lambda acc: F.when(acc["i"] > 0, F.concat(acc["parts"], F.array(T.strip(current(acc))))).otherwise(acc["parts"]))


def folded_pieces(items: Column, size: int, overlap: int) -> Column:
    """Any pieces, packed text by text."""

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (cur != "") & (F.length(cur) + F.length(p) + 2 > size)
        tail = F.right(cur, F.lit(overlap))
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(T.strip(cur)))).otherwise(acc["parts"]).alias("parts"),
            F.when(full & (tail != ""), F.concat(tail, F.lit("\n\n"), p)).when(full | (cur == ""), p).otherwise(T.strip(F.concat(cur, F.lit("\n\n"), p))).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(T.strip(acc["cur"]) != "", F.concat(acc["parts"], F.array(T.strip(acc["cur"])))).otherwise(acc["parts"])

    return F.aggregate(items, F.expr(EMPTY), step, finish)


def chunk_text(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Pieces packed up to size; a new chunk begins with the last ``overlap`` characters of the one before."""
    return T.let(pieces(text, size), lambda v: F.when(bare(v), packed_pieces(v, size, overlap)).otherwise(folded_pieces(v, size, overlap)))


def chunk_records(docs: DataFrame, size: int = 1000, overlap: int = 150, min_quality: float = 0.25, flatten: bool = False) -> DataFrame:
    """docs (url, title, text) to chunks: id, text, index, source_url, title, n_chars, n_tokens_est, quality.

    The gate is the document's quality, the stored quality the chunk's. Null text makes no chunk.
    """
    # the outer form: for the inner one Spark adds a filter on the whole expression, which would then run twice
    gated = T.let(T.clean(F.col("text"), flatten), lambda t: F.when(T.quality_score(t) >= min_quality, chunk_text(t, size, overlap)))
    each = docs.select("url", "title", F.posexplode_outer(gated).alias("index", "text")).where("index is not null")
    key = F.concat(F.coalesce("url", F.lit("")), F.lit("#"), F.col("index").cast("string"), F.lit(":"), F.left("text", F.lit(64)))
    return each.select(
        F.left(F.sha1(key), F.lit(16)).alias("id"), "text", F.col("index").cast("long").alias("index"), F.col("url").alias("source_url"), "title",
        F.length("text").cast("long").alias("n_chars"), T.est_tokens_chunk(F.col("text")).alias("n_tokens_est"), T.quality_score(F.col("text")).alias("quality"),
    )


def langchain(chunks: DataFrame) -> DataFrame:
    meta = F.struct("id", "source_url", "title", F.col("index").alias("chunk_index"), "n_chars", "n_tokens_est", "quality")
    return chunks.select(F.col("text").alias("page_content"), meta.alias("metadata"))


def rag_jsonl(chunks: DataFrame) -> DataFrame:
    meta = F.struct("source_url", "title", F.col("index").alias("chunk_index"), "n_chars", "n_tokens_est", "quality")
    return chunks.select(F.to_json(F.struct("id", "text", meta.alias("metadata"))).alias("line"))
