"""An inverted index with block maxima, and the best documents for a table of queries at once.

Documents are dealt to ranges by a hash. A block is a term's postings in one range, a row: (term, range, n, most, postings), postings being
(key, tf, dl) and most the largest impact, without the term's weight (idf). For a query, the sums of its terms'
block maxima bound all scores in a range. The ranges with the best bounds are scored first, which gives the score that the k-th document has at least; of
all other ranges, only those whose bound reaches it are scored. The result is that of scoring everything.

What moves is texts, not postings: a text is sent once to the task of its range, which counts its terms and makes the blocks. A search
sends blocks of its own terms to the task of their range, where documents are scored and the best are taken; only those move on.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.rank import B, K1, idf, tokenize
from corpusmill.sources.tables import shared_dir

RANGE_DOCS, FIRST_RANGES, TASK_RANGES = 1 << 10, 2, 4
BLOCKS = "term string, range int, n long, most double, postings array<struct<key: long, tf: long, dl: int>>"


class Index(NamedTuple):
    """``blocks`` and ``terms`` (term, df) as written; ``docs`` and ``average``: the number of documents and their mean length."""

    blocks: DataFrame
    terms: DataFrame
    docs: int
    average: float


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that its size is known to what joins it."""
    path = f"{shared_dir(df.sparkSession)}/corpusmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def impact(tf, dl, average: float):
    """What a document's count of a term adds to its score, without the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def build(docs: DataFrame, key: str, root: str, range_docs: int = RANGE_DOCS) -> Index:
    """Writes the index of docs (key: long, text) to a folder and opens it. Null texts are empty documents; rows that repeat a key are one document with all their words; null keys are left out."""
    spark = docs.sparkSession
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), "text")
    lengths = texts.groupBy("key").agg(F.sum(F.size(tokenize(F.col("text")))).alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    n, average = stats["n"], stats["average"] or 1.0
    ranges = max(1, -(-n // range_docs))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ranges // TASK_RANGES))
    dealt = texts.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")).repartition(tasks, "range")
    one = dealt.groupBy("range", "key").agg(F.concat_ws("\n", F.collect_list("text")).alias("text")).select("range", "key", tokenize(F.col("text")).alias("tokens"))
    counted = one.select("range", "key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("range", "key", "dl", "term").agg(F.count("*").alias("tf"))
    posting = F.struct("key", "tf", "dl")
    blocks = counted.groupBy("term", "range").agg(F.count("*").alias("n"), F.max(impact(F.col("tf"), F.col("dl"), average)).alias("most"), F.collect_list(posting).alias("postings"))
    blocks.write.parquet(f"{root}/blocks")
    spark.read.schema(BLOCKS).parquet(f"{root}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{root}/terms")
    spark.createDataFrame([(n, float(average))], "docs long, average double").write.parquet(f"{root}/stats")
    return load(spark, root)


def load(spark: SparkSession, root: str) -> Index:
    stats = spark.read.parquet(f"{root}/stats").first()
    return Index(spark.read.schema(BLOCKS).parquet(f"{root}/blocks"), spark.read.schema("term string, df long").parquet(f"{root}/terms"), stats["docs"], stats["average"])


def known(index: Index, terms: DataFrame) -> DataFrame:
    """terms (query, term, weight) that the index has, weighed by how rare they are too; those that are already stay."""
    if "worth" in terms.columns:
        return terms
    return terms.join(index.terms, "term").select("query", "term", (F.col("weight") * idf(F.lit(index.docs), F.col("df"))).alias("worth"))


def bounds(index: Index, terms: DataFrame) -> DataFrame:
    """(query, range, bound): no document of the range scores more for the query."""
    met = known(index, terms).join(index.blocks.select("term", "range", "most"), "term")
    return met.groupBy("query", "range").agg((F.sum(F.col("worth") * F.col("most")) * (1 + 1e-12)).alias("bound"))


def scored(index: Index, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, range, key, score) of the documents of the wanted (query, range) that have a term of the query."""
    terms = known(index, terms)
    own = index.blocks.join(terms.select("term").distinct(), "term", "left_semi").join(wanted.select("range").distinct(), "range", "left_semi")
    placed = own.select("term", "range", "postings").repartition("range")
    met = placed.join(terms, "term").join(wanted.select("query", "range"), ["range", "query"], "left_semi")
    each = met.select("query", "range", "worth", F.explode("postings").alias("posting"))
    part = F.col("worth") * impact(F.col("posting.tf"), F.col("posting.dl"), index.average)
    return each.groupBy("query", "range", F.col("posting.key").alias("key")).agg(F.sum(part).alias("score"))


def best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, key: str) -> DataFrame:
    """(query, term, weight) of queries (key, text): a term that repeats weighs as often."""
    return queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("weight"))


def search(index: Index, queries: DataFrame, key: str, k: int, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """(query, rank, key, score): the k best documents of every query by BM25, ties by key. Queries without a known term have none; rows that repeat a query's key are one query."""
    terms = kept(known(index, query_terms(queries, key)), "terms")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "range"))
    ordered = kept(bounds(index, terms).withColumn("place", place), "bounds")
    first = kept(ordered.where(F.col("place") <= first_ranges).select("query", "range"), "first")
    early = kept(best(scored(index, terms, first), k, "query", "range").drop("rank"), "early")
    least = best(early, k, "query").groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = ordered.where(F.col("place") > first_ranges).join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") * (1 - 1e-9)))
    late = best(scored(index, terms, kept(rest.select("query", "range"), "rest")), k, "query", "range").drop("rank")
    return best(early.unionByName(late), k, "query").select("query", "rank", "key", "score")
