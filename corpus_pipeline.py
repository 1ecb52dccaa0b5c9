"""A training-data pipeline over ``documents``: each stage is an operator of corpusmill.llm, written and read again.

Quality classifier (rejected documents go), exact dedup, near-dedup (one document of each group stays), secret
scans (found secrets are masked), best-fit packing (pieces with their places).

In every stage null text counts as empty, rows that repeat a doc_id are rows of their own, other columns are carried
along untouched whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, packing, quality, secrets, simhash
from corpusmill.llm.bpe import byte_bpe
from corpusmill.llm.common import scratch, table
from corpusmill.llm.queries import CAPACITY, END_PACK, ready, tokenizer_path


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under the threshold go; a row is judged by its text alone, so equal rows share their fate. Without labels every score is 0.5, which keeps all."""
    ready(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space counted as one blank) the rows of the smallest doc_id stay; a null id stays only if no other id has the text."""
    ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike (five-word shingles, similarity 0.8 or more) the row of the smallest doc_id stays; rows with a null id stay."""
    ready(spark)
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; no row goes, null text stays null, and n_chars, if there, is that of the masked text."""
    ready(spark)
    masked = secrets.mask_secrets(docs, secrets.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's token ids with their places in sequences of at most CAPACITY ids; null and empty texts are their end id alone."""
    ready(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack_documents(docs, partial(byte_bpe, path), CAPACITY, END_PACK)


STAGES = [("quality", judge_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: The first stage is a trained model, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
