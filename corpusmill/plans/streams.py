"""Queries that run as streams over the tables, replayed in their order, and the SQL of what they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.plans.catalog import COSTED, SUMS, _costed, query
from corpusmill.sources.tables import table
from corpusmill.streaming import throttle, windows
from corpusmill.streaming.ledger import Ledger
from corpusmill.streaming.replay import new_folder, replay, slices

KEPT_DAYS, SLICES, GAP_US = 20, 3, 1_000_000


def to_table(out: DataFrame, folder: str) -> StreamingQuery:
    """Appends what a stream gives to folder/out as far as there is input; the checkpoint lies beside it."""
    return out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def run(rows: DataFrame, order: str, make, last: str | None = None) -> DataFrame:
    """What ``make(stream)`` gives of rows replayed in ``order``. ``last``: a time column of which one more row, far later than all, closes what is open; the row is the stream's own end mark and gives no result."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "stream")
    start = lambda stream: to_table(make(stream), folder)
    replay(rows, order, SLICES, start, f"{folder}/in")
    if last:
        end = spark.range(1).select(*[F.lit("9999-01-01").cast(t).alias(c) if c in (last, order) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        replay(end, order, 1, start, f"{folder}/in")
    return spark.read.schema(make(rows).schema).parquet(f"{folder}/out")


@query(f"SELECT day, provider, model, {SUMS} FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM {COSTED}) GROUP BY GROUPING SETS ((), (day), (provider), (provider, model)) QUALIFY day IS NULL OR dense_rank() OVER (ORDER BY day DESC NULLS LAST) <= {KEPT_DAYS}")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up that a ledger holds after all events came as a stream, with the latest days kept."""
    folder, calls = new_folder(spark, "ledger"), _costed(spark, d)
    ledger = Ledger(spark, f"{folder}/ledger", KEPT_DAYS)
    replay(calls, "ts", SLICES, lambda stream: ledger.start(stream, f"{folder}/checkpoint"), f"{folder}/in")
    return ledger.rollup()


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).cast("string").alias("host"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("arrival"))


@query(f"""SELECT id, host, k * {GAP_US} + max(arrival_us - k * {GAP_US}) OVER (PARTITION BY host ORDER BY arrival_us, id) AS slot_us FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival_us, id) - 1 AS k FROM (SELECT event_id AS id, (user_id % 7)::VARCHAR AS host, epoch_us(date_trunc('hour', ts)) AS arrival_us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))""")
def throttle_stream(spark: SparkSession, d: str) -> DataFrame:
    """Requests that come in bursts, a stream of many micro-batches, a second or more apart on each host."""
    with throttle.keyed_state(spark):
        return run(_requests(spark, d), "arrival", lambda s: throttle.throttled_stream(s, GAP_US)).select("id", "host", "slot_us")


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    """All clicks, those that repeat too, with times as streams want them."""
    return table(spark, d, "clicks").select("click_id", F.col("ts").cast("timestamp").alias("ts"), F.col("arrived_at").cast("timestamp").alias("arrived_at"), "client_id", "kind", "value")


ON_TIME = "(SELECT * FROM clicks WHERE arrived_at <= ts + INTERVAL 1 DAY)"


@query(f"""SELECT client_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS ended_us, count(*)::BIGINT AS n, count(DISTINCT click_id)::BIGINT AS n_clicks FROM (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY client_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {ON_TIME})) GROUP BY client_id, nr""")
def click_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of all clients: clicks at most half an hour apart. Clicks that arrived more than a day late are set apart; a null client has sessions as any."""
    def make(stream):
        rows = windows.on_time(stream, "ts", "arrived_at", "1 day")[0]
        return windows.sessions(rows, "client_id", "ts", "30 minutes", "1 day", F.count("*").alias("n"), F.size(F.collect_set("click_id")).cast("long").alias("n_clicks"))

    told = run(_clicks(spark, d), "arrived_at", make, last="ts").where("began < '9000-01-01'")
    return told.select("client_id", F.unix_micros("began").alias("began_us"), F.unix_micros("ended").alias("ended_us"), "n", "n_clicks")


@query(f"""SELECT kind, epoch_us(began) AS began_us, count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS value FROM (SELECT kind, value, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS began FROM {ON_TIME}) GROUP BY ALL""")
def click_windows(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of each kind in every hour that begins at a quarter; late ones are set apart."""
    def make(stream):
        rows = windows.on_time(stream, "ts", "arrived_at", "1 day")[0]
        return windows.sliding(rows, "kind", "ts", "1 hour", "15 minutes", "1 day", F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("value"))

    told = run(_clicks(spark, d), "arrived_at", make, last="ts").where("began < '9000-01-01'")
    return told.select("kind", F.unix_micros("began").alias("began_us"), "n", "value")


@query("""SELECT sale_id, line_no, item_id, epoch_us(sold_at) AS sold_us, epoch_us(shipped_at) AS shipped_us FROM sales JOIN sale_lines USING (sale_id) WHERE shipped_at >= sold_at AND shipped_at <= sold_at + INTERVAL 7 DAY""")
def sale_shipments(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were shipped within a week of their sale: an interval join of two streams, each replayed in the order of its time."""
    folder = new_folder(spark, "stream")
    sales = table(spark, d, "sales").select("sale_id", F.col("sold_at").cast("timestamp").alias("sold_at")).where("sold_at is not null")
    lines = table(spark, d, "sale_lines").select("sale_id", "line_no", "item_id", F.col("shipped_at").cast("timestamp").alias("shipped_at")).where("shipped_at is not null")
    streams = [f"{folder}/sales", f"{folder}/lines"]
    for part, more in zip(slices(sales, "sold_at", SLICES), slices(lines, "shipped_at", SLICES)):
        part.write.mode("append").parquet(streams[0])
        more.write.mode("append").parquet(streams[1])
        a, b = (spark.readStream.schema(x.schema).parquet(path) for x, path in zip((sales, lines), streams))
        to_table(windows.replies(a, b, "sale_id", "sold_at", "shipped_at", "7 days", "60 days"), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("sale_id", "line_no", "item_id", F.unix_micros("sold_at").alias("sold_us"), F.unix_micros("shipped_at").alias("shipped_us"))
