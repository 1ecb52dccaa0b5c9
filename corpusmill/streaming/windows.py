"""Event-time windows over streams, with late rows set apart, and an interval join of two streams.

A row is late if it arrived more than ``allowed`` after it happened. Late rows are set apart by a filter on the row itself, so which they
are does not depend on how a stream was cut into batches. The watermark lags by the same time: as long as rows come in the
order of their arrival, it never passes a row that is on time, and state of windows that can't change any more goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_time(rows: DataFrame, happened: str, arrived: str, allowed: str) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows); rows without either time are in neither."""
    late = F.col(arrived) > F.col(happened) + F.expr(f"interval {allowed}")
    return rows.where(~late), rows.where(late)


def sessions(rows: DataFrame, key: str, happened: str, gap: str, allowed: str, *measures: Column) -> DataFrame:
    """A row a session: rows of one key with at most ``gap`` between neighbours. ``began`` is the first row's time, ``ended`` the last one's plus the gap."""
    by = F.session_window(happened, gap)
    return rows.withWatermark(happened, allowed).groupBy(key, by.alias("w")).agg(*measures).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), *[m for m in _names(measures)])


def sliding(rows: DataFrame, key: str, happened: str, length: str, slide: str, allowed: str, *measures: Column) -> DataFrame:
    """A row a key and window of ``length`` that begins at every ``slide``; a row counts in each that covers it."""
    by = F.window(happened, length, slide)
    return rows.withWatermark(happened, allowed).groupBy(key, by.alias("w")).agg(*measures).select(key, F.col("w.start").alias("began"), *[m for m in _names(measures)])


def _names(measures: tuple[Column, ...]) -> list[str]:
    return [m._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for m in measures]


def replies(calls: DataFrame, replies: DataFrame, key: str, called: str, replied: str, within: str, allowed: str) -> DataFrame:
    """Inner join of two streams by key: replies not before their call and at most ``within`` after it.

    Both sides have a watermark, so a call's state goes when no reply can come any more, and a reply's when no call can.
    Columns other than the key must have different names.
    """
    a = calls.withWatermark(called, allowed).alias("a")
    b = replies.withWatermark(replied, allowed).withColumnRenamed(key, f"__{key}").alias("b")
    near = (F.col(replied) >= F.col(called)) & (F.col(replied) <= F.col(called) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col(f"__{key}")) & near).drop(f"__{key}")
