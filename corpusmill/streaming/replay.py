"""A table fed to a stream in the order of a column, slice by slice, so that every micro-batch is known beforehand."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.tables import shared_dir


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; it is left there, as readers of the result need it."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def slices(rows: DataFrame, order: str, parts: int) -> list[DataFrame]:
    """rows cut at ``parts`` - 1 values of ``order`` into parts about equal in size, in that order; rows without it come first. All rows of a value are in one part."""
    at = F.col(order)
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    cuts = sorted({*(cuts or [])})
    bounds = zip([None, *cuts], [*cuts, None])
    return [rows.where((at.isNull() if low is None else F.lit(False)) | ((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))) for low, high in bounds]


def replay(rows: DataFrame, order: str, parts: int, start: Callable[[DataFrame], StreamingQuery], folder: str) -> None:
    """Writes slice after slice to ``folder`` and runs ``start(stream)`` to its end after each: a run goes on from the checkpoint of the one before.

    ``start`` must begin a query with trigger availableNow and a checkpoint of its own.
    """
    spark = rows.sparkSession
    for part in slices(rows, order, parts):
        part.write.mode("append").parquet(folder)
        query = start(spark.readStream.schema(rows.schema).parquet(folder))
        query.awaitTermination()
