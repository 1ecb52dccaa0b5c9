"""Tables as DataFrames, and the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to all cores by keys, several tasks a core. A narrow table is one file of a few blocks, which two or three tasks would read; what is costly a row must not stay with these."""
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def fetched_pages(pages: DataFrame) -> DataFrame:
    """A crawl snapshot in the shape of fetched responses: url, status, content_type, body; a page that is not there is status 0."""
    return pages.select("page_id", "url", F.when(F.col("html").isNull(), 0).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("header"), F.col("html").alias("body"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a folder of our own if all runs on this machine, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
