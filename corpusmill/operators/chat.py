"""Conversations: turn merging and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_turns(turns: DataFrame) -> DataFrame:
    """Runs of turns of one role become one turn; texts joined by an empty line, in order."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    runs = turns.withColumn("__new", F.when(F.col("role") == F.lag("role").over(by), 0).otherwise(1)).withColumn("run", F.sum("__new").over(by).cast("long"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), texts.alias("text"))


def flatten_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, system, prompt): system texts, and the rest as Human and Assistant lines."""
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    system = F.filter("rows", lambda r: r["role"] == "system")
    rest = F.filter("rows", lambda r: ~r["role"].isin("system", "tool"))
    line = lambda r: F.concat(F.when(r["role"] == "user", "Human: ").otherwise("Assistant: "), r["text"])
    return rows.select("conv_id", F.array_join(F.transform(system, lambda r: r["text"]), "\n\n").alias("system"), F.array_join(F.transform(rest, line), "\n\n").alias("prompt"))
