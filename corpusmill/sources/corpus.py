"""Corpus folders: documents, chunks and page files written by tasks, and a one-row manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import urls as U
from corpusmill.operators import chunk, keep


def admitted(pages: DataFrame) -> DataFrame:
    """Pages that opened, the first of each url by ``pos``: url, title, text, markdown, meta."""
    body = F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"))
    ok = pages.where((F.col("status") == 200) & (F.coalesce(body, F.lit("")) != ""))
    return keep.keep_first(ok, ["url"], "pos")


def documents(pages: DataFrame) -> DataFrame:
    """(url, title, host, text, meta, word_count) with cleaned texts; Markdown stays."""
    body = F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"))
    cleaned = pages.select("url", "title", F.coalesce(F.col("meta")["host"], F.lit("")).alias("host"), T.clean(body).alias("text"), "meta")
    return cleaned.withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long"))


def chunks(pages: DataFrame, size: int = 1000, overlap: int = 150, min_quality: float = 0.25) -> DataFrame:
    """Chunk records of pages; Markdown is flattened here."""
    body = F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"))
    return chunk.chunk_records(pages.select("url", "title", body.alias("text")), size, overlap, min_quality, flatten=True)


def markdown_files(pages: DataFrame) -> DataFrame:
    """(name, value): a page file with title and source above the text; names that two addresses share hold both."""
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n> source: "), F.col("url"), F.lit("\n\n"))
    return pages.select(U.slug(F.col("url")).alias("name"), F.concat(head, F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"), F.lit(""))).alias("value"))


def save(pages: DataFrame, root: str, **chunking) -> dict:
    """Writes documents, chunks and pages below root, each whole or not at all, then the manifest; gives the counts.

    documents and chunks are folders of JSON lines, pages has one folder a name (name=…). The counts are read back from
    what was written, so they hold after a lost executor; addresses are a folder too, as they grow with the corpus.
    """
    spark, kept = pages.sparkSession, admitted(pages)
    documents(kept).write.mode("overwrite").json(f"{root}/documents")
    chunks(kept, **chunking).write.mode("overwrite").json(f"{root}/chunks")
    markdown_files(kept).write.mode("overwrite").partitionBy("name").text(f"{root}/pages")
    counts = {f"n_{k}": spark.read.text(f"{root}/{k}").count() for k in ("documents", "chunks")}
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), *[F.lit(v).alias(k) for k, v in counts.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return counts
