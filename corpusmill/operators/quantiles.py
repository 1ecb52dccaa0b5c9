"""Exact quantiles of any number of groups, with no group's values in one task.

Groups up to a size are small: their values meet in one task. The others are few (at most GROUPS), so what is known of them is broadcast. Each
pass counts a large group's values by histogram between the bounds that are known for a wanted place, with map-side
combining, and keeps the bin that holds the place, with the least and greatest value in it. It ends where a bin is one value, or holds so few
that they are gathered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import shared_dir

GROUPS, SMALL, BINS = 1 << 14, 1 << 14, 1 << 10


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/quantiles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _between(low: Column, high: Column, q: Column, n: Column) -> Column:
    at = q * (n - 1)
    return low + (high - low) * (at - F.floor(at))


def places(rows: DataFrame, wanted: DataFrame, small: int, bins: int = BINS) -> DataFrame:
    """(group, place, value) for every wanted (group, place): the value at that place (from 0) of the group's values (group, value) in order."""
    found, open_ = None, wanted.select("group", "place", F.col("place").alias("left"), "low", "high", "n")
    while True:
        done = open_.where("low = high").select("group", "place", F.col("low").alias("value"))
        few = open_.where(f"low < high and n <= {small}")
        near = rows.join(F.broadcast(few), "group").where("value between low and high")
        order = Window.partitionBy("group", "place").orderBy("value")
        picked = near.withColumn("at", F.row_number().over(order) - 1).where("at = left").select("group", "place", "value")
        step = written(done.unionByName(picked))
        found = step if found is None else found.unionByName(step)
        open_ = open_.where(f"low < high and n > {small}")
        if open_.isEmpty():
            return found
        width = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
        each = rows.join(F.broadcast(open_), "group").where("value between low and high").withColumn("bin", F.least(F.floor(width * bins), F.lit(bins - 1)))
        counted = each.groupBy("group", "place", "left", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("group", "place").orderBy("bin"))
        held = counted.withColumn("upto", upto).where("upto > left and upto - n <= left")
        open_ = written(held.select("group", "place", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "low", "high", "n"))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(by, quantile, value, n): linear between neighbours, as a sorted list would give it. Null values don't count, null keys are a key; a group without values has no row; values must be finite numbers."""
    data = written(rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("group") if by else F.struct(F.lit(0).alias("all")).alias("group"), F.col(value).cast("double").alias("value")))
    groups = written(data.groupBy("group").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    limit = max(small, total // GROUPS)  # so at most GROUPS groups are larger
    asked = F.explode(F.array(*map(F.lit, map(float, quantiles))))
    told = groups.where(F.col("n") > limit).select("group", "n", "low", "high", asked.alias("quantile"))
    at = F.col("quantile") * (F.col("n") - 1)
    ends = told.select("group", "n", "low", "high", "quantile", F.floor(at).alias("under"), F.ceil(at).alias("over"))
    wanted = ends.select("group", F.explode(F.array_distinct(F.array("under", "over"))).alias("place"), "low", "high", "n").distinct()
    large_rows = data.join(F.broadcast(told.select("group").distinct()), "group", "left_semi")
    got = places(large_rows, wanted, small, bins)
    one = lambda x: got.select(F.col("group"), F.col("place").alias(x), F.col("value").alias(f"{x}_value"))
    large = ends.join(one("under"), ["group", "under"]).join(one("over"), ["group", "over"])
    large = large.select("group", "quantile", _between(F.col("under_value"), F.col("over_value"), F.col("quantile"), F.col("n")).alias("value"), "n")
    less = data.join(groups.where(F.col("n") > limit).select("group").hint("broadcast"), "group", "left_anti")
    mine = less.groupBy("group").agg(F.percentile("value", F.array(*map(F.lit, map(float, quantiles)))).alias("v"), F.count("*").alias("n"))
    mine = mine.select("group", F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, quantiles))).alias("quantile"), F.col("v").alias("value"))).alias("z"), "n").select("group", "z.quantile", "z.value", "n")
    keys = [F.col(f"group.{b}").alias(b) for b in by]
    return large.unionByName(mine).select(*keys, "quantile", "value", "n")
