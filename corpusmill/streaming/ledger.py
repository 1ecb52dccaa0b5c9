"""The usage ledger as a stream: a log of calls, and a roll-up that is swapped whole.

A ledger is a folder. ``log`` has a folder a stream and micro-batch, written anew if the batch is. ``rollup`` has one folder a version;
``current.json`` names the one that holds, and for every stream the last batch that is in it. A batch adds its buckets to those of
the current version, writes them as a version of its own and swaps ``current.json`` by a rename. A batch that comes again after a
failure is found in ``current.json`` and adds nothing; one that failed before the swap left a version nobody reads.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.usage import add_sums, rollup, sums
from corpusmill.sources import files

#: A bucket is for all calls (all three null), a day, a provider, or a provider and model.
BUCKET = ("day", "provider", "model")
ROLLUP = "day string, provider string, model string, requests long, prompt_tokens long, completion_tokens long, cached_tokens long, total_tokens long, cost_usd double, unpriced_requests long"


def daily_ledger(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily buckets of a stream (or table) of priced calls; days close ``delay`` after their last call."""
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(*sums()).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "*").drop("w")


def latest_days(buckets: DataFrame, days: int) -> DataFrame:
    """The buckets of the latest ``days`` days, and all others. A window over the days alone, of which a roll-up keeps few."""
    own = buckets.where("day is not null")
    rank = F.dense_rank().over(Window.orderBy(F.desc("day")))
    return buckets.where("day is null").unionByName(own.withColumn("__rank", rank).where(F.col("__rank") <= days).drop("__rank"))


class Ledger:
    """Calls are priced rows (ts, provider, model, prompt_tokens, completion_tokens, cached_tokens, cost_usd; others are only logged).

    Null providers count as ``?``, null models as an empty name, null token counts as none. ``session`` has the counts since the ledger was opened. With ``strict`` off,
    a folder that can't be written costs the history and not the run: the batch is counted in ``session`` and in ``lost``.
    """

    def __init__(self, spark: SparkSession, root: str, keep_days: int = 90, strict: bool = True):
        self.spark, self.root, self.keep_days, self.strict, self.lost = spark, root.rstrip("/"), keep_days, strict, 0
        self.restart()

    def restart(self) -> None:
        self.session: dict = {}
        self.started = datetime.now(timezone.utc)

    def current(self) -> dict:
        """version (None: no calls yet), the last batch of every stream, and since when; begins anew where the file is missing or no JSON."""
        try:
            got = json.loads(files.read_text(self.spark, f"{self.root}/current.json") or "null")
        except ValueError:
            got = None
        fresh = {"version": None, "batches": {}, "since": datetime.now(timezone.utc).strftime("%Y-%m-%d")}
        return fresh | got if isinstance(got, dict) else fresh

    def rollup(self) -> DataFrame:
        """The buckets that hold now."""
        version = self.current()["version"]
        return self.spark.read.schema(ROLLUP).parquet(f"{self.root}/rollup/{version}") if version else self.spark.createDataFrame([], ROLLUP)

    def log(self, schema: str) -> DataFrame:
        """All logged calls, of every stream and batch."""
        if not files.names(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], f"{schema}, stream string, batch long, month string")
        return self.spark.read.schema(f"{schema}, stream string, batch long, month string").json(f"{self.root}/log")

    def store(self, calls: DataFrame, batch: int, stream: str) -> None:
        """Logs the calls of a batch and adds them to the roll-up, once however often it comes."""
        now = self.current()
        if batch <= now["batches"].get(stream, -1):
            return
        month = calls.withColumn("month", F.date_format("ts", "yyyy-MM"))
        month.write.mode("overwrite").partitionBy("month").json(f"{self.root}/log/stream={stream}/batch={batch}")
        before = self.rollup() if now["version"] else None
        both = rollup(calls).select(*BUCKET, *[c for c in calls.sparkSession.createDataFrame([], ROLLUP).columns if c not in BUCKET])
        both = both if before is None else add_sums(before.unionByName(both), BUCKET)
        version = f"v-{uuid.uuid4().hex}"
        latest_days(both, self.keep_days).coalesce(1).write.parquet(f"{self.root}/rollup/{version}")  # days, providers and models: few rows
        files.put_text(self.spark, f"{self.root}/current.json", json.dumps(now | {"version": version, "batches": now["batches"] | {stream: batch}}))
        for old in files.names(self.spark, f"{self.root}/rollup"):
            if old not in (version, now["version"]):  # a reader may still be at the one before
                files.delete(self.spark, f"{self.root}/rollup/{old}")

    def record(self, calls: DataFrame, batch: int, stream: str = "calls") -> None:
        """One micro-batch: into the session's counts, the log and the roll-up."""
        calls = calls.withColumns({"provider": F.coalesce("provider", F.lit("?")), "model": F.coalesce("model", F.lit("")), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")}})
        got = calls.agg(*sums()).first().asDict()
        if got["requests"]:
            self.session = {k: (self.session.get(k) or 0) + (v or 0) for k, v in got.items()}
        try:
            self.store(calls, batch, stream)
        except Exception:
            if self.strict:
                raise
            self.lost += got["requests"]

    def start(self, calls: DataFrame, checkpoint: str, stream: str = "calls", **trigger) -> StreamingQuery:
        """Records a stream of calls; ``stream`` names it in the ledger and goes with its checkpoint."""
        return calls.writeStream.foreachBatch(lambda df, batch: self.record(df, batch, stream)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def reset(self, scope: str = "session") -> None:
        """``session``: its counts begin anew. ``all``: the roll-up too; the log stays, and batches that are in it are not counted again."""
        if scope not in ("session", "all"):
            raise ValueError(f"unknown scope: {scope}")
        self.restart()
        if scope == "all":
            now = self.current()
            files.put_text(self.spark, f"{self.root}/current.json", json.dumps(now | {"version": None, "since": datetime.now(timezone.utc).strftime("%Y-%m-%d")}))
