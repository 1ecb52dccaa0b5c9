"""Streams: the ledger's batches and restarts, state of the throttle, windows and joins with late rows."""

import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import usage
from corpusmill.plans.streams import to_table
from corpusmill.sources import files
from corpusmill.streaming import throttle, windows
from corpusmill.streaming.ledger import BUCKET, Ledger
from corpusmill.streaming.replay import replay, slices

CALLS = "ts timestamp, provider string, model string, prompt_tokens long, completion_tokens long, cached_tokens long, cost_usd double"
T0 = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp()


def calls(spark, *rows):
    return spark.createDataFrame([(T0 + timedelta(days=d), p, m, i, o, 0, c) for d, p, m, i, o, c in rows], CALLS)


def buckets(ledger):
    return {tuple(r[b] for b in BUCKET): (r.requests, r.total_tokens, r.cost_usd, r.unpriced_requests) for r in ledger.rollup().collect()}


def test_counts_persist_and_scopes_reset(spark, folder):
    ledger = Ledger(spark, folder)
    ledger.record(calls(spark, (0, "anthropic", "m", 1_000_000, 0, 5.0), (0, "nvidia", "unpriced", 10, 5, None)), 0)
    assert ledger.session["requests"] == 2 and ledger.session["total_tokens"] == 1_000_015 and ledger.session["cost_usd"] == 5.0 and ledger.session["unpriced_requests"] == 1
    again = Ledger(spark, folder)  # another ledger of the folder sees what was counted
    assert buckets(again)[None, None, None] == (2, 1_000_015, 5.0, 1) and buckets(again)[None, "anthropic", None][0] == 1 and not again.session
    again.record(calls(spark, (1, None, None, None, 5, 0.25)), 0, "another stream")
    got = buckets(again)
    assert got[None, None, None] == (3, 1_000_020, 5.25, 1) and got[None, "?", ""] == (1, 5, 0.25, 0) and got["2024-03-02", None, None][0] == 1
    again.reset("session")
    assert not again.session and buckets(again)[None, None, None][0] == 3
    again.reset("all")
    assert buckets(again) == {} and again.log(CALLS).count() == 3
    again.record(calls(spark, (1, "p", "m", 1, 1, None)), 0)  # that batch is in the log already
    again.record(calls(spark, (1, "p", "m", 1, 1, None)), 1)
    assert buckets(again)[None, None, None] == (1, 2, 0.0, 1)
    with pytest.raises(ValueError):
        again.reset("other")


def test_a_batch_counts_once(spark, folder, monkeypatch):
    """Again after it was swapped in; again after a failure before the swap; and the folder holds two versions at most."""
    ledger = Ledger(spark, folder)
    one, two = calls(spark, (0, "a", "x", 1, 2, 0.5), (3, "a", "y", 3, 4, None)), calls(spark, (3, "b", "x", 5, 6, 1.0))
    for _ in range(2):
        ledger.record(one, 0)
    assert buckets(ledger)[None, None, None] == (2, 10, 0.5, 1)
    with monkeypatch.context() as m:
        m.setattr(files, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.record(two, 1)
    assert buckets(ledger)[None, None, None][0] == 2
    for _ in range(3):
        Ledger(spark, folder).record(two, 1)
    assert buckets(ledger)[None, None, None] == (3, 21, 1.5, 1) and ledger.log(CALLS).count() == 3
    ledger.record(two, 2)
    assert len(files.names(spark, f"{folder}/rollup")) == 2
    files.put_text(spark, f"{folder}/current.json", "{not json")  # as if never written: begins anew
    ledger.record(one, 0)
    assert buckets(ledger)[None, None, None][0] == 2


def test_the_latest_days_stay(spark, folder):
    ledger = Ledger(spark, folder, keep_days=3)
    ledger.record(calls(spark, *[(d, "a", "x", 1, 0, None) for d in range(4)]), 0)
    ledger.record(calls(spark, (9, "a", "x", 1, 0, None), (-5, "a", "x", 1, 0, None)), 1)
    got = buckets(ledger)
    assert sorted(k[0] for k in got if k[0]) == ["2024-03-03", "2024-03-04", "2024-03-10"] and got[None, None, None][0] == 6


def test_a_folder_that_cannot_be_written(spark):
    ledger = Ledger(spark, "file:///proc/no/such/folder", strict=False)
    ledger.record(calls(spark, (0, "a", "x", 1, 0, None)), 0)
    assert ledger.session["requests"] == 1 and ledger.lost == 1
    with pytest.raises(Exception):
        Ledger(spark, "file:///proc/no/such/folder").record(calls(spark, (0, "a", "x", 1, 0, None)), 0)


def test_a_stream_goes_on_where_it_stopped(spark, folder, monkeypatch):
    """A run that fails after a batch was swapped in but before the stream noted it: the next run counts that batch once."""
    ledger = Ledger(spark, f"{folder}/ledger")
    rows = calls(spark, *[(d, "a", "x", d, 1, 0.5) for d in range(6)])
    first, second = slices(rows, "ts", 2)
    start = lambda s: ledger.start(s, f"{folder}/checkpoint")
    replay(first, "ts", 1, start, f"{folder}/in")
    record = Ledger.record
    with monkeypatch.context() as m:
        m.setattr(Ledger, "record", lambda self, *a: (record(self, *a), 1 / 0))
        with pytest.raises(Exception):
            replay(second, "ts", 1, start, f"{folder}/in")
    assert buckets(ledger)[None, None, None][0] == 6
    replay(calls(spark, (7, "a", "x", 1, 1, None)), "ts", 1, start, f"{folder}/in")
    want = usage.rollup(rows.union(calls(spark, (7, "a", "x", 1, 1, None)))).collect()
    assert buckets(ledger) == {(r.day, r.provider, r.model): (r.requests, r.total_tokens, r.cost_usd, r.unpriced_requests) for r in want}


def stream(spark, folder, schema, make, *batches):
    """The rows that make(stream) gives of batches that come one after another, batch by batch, and the last run's progress."""
    out, query, rows = [], None, None
    for batch in batches:
        rows = spark.createDataFrame(batch, schema)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = to_table(make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
        query.awaitTermination()
        out.append(sorted(map(tuple, spark.read.schema(make(rows).schema).parquet(f"{folder}/out").collect()), key=repr))
    return out, query.recentProgress


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_throttle_keeps_slots_over_batches(spark, folder):
    schema = "id long, host string, arrival timestamp"
    with throttle.keyed_state(spark):
        make = lambda s: throttle.throttled_stream(s, 2_000_000, "60 seconds").select("id", "host", F.col("slot_us") - int(T0.timestamp()) * 10**6)
        got, progress = stream(
            spark, folder, schema, make,
            [(1, "a", at(0)), (2, "a", at(0)), (3, "b", at(1)), (4, None, at(0)), (5, "a", None)],
            [(6, "a", at(1)), (7, "a", at(30)), (8, "b", at(-20))],  # 8 comes after later ones, but in time
            [(9, "a", at(500)), (10, "c", at(400))],
            [(11, "a", at(20)), (12, "c", at(450))],  # 11 is later than the watermark allows
            [(13, "z", at(9000))], [(14, "z", at(9000))],
        )
    slot = {i: s / 1e6 for i, _, s in got[-1]}
    assert slot == {1: 0, 2: 2, 3: 1, 6: 4, 7: 30, 8: 3, 9: 500, 10: 400, 12: 450, 13: 9000, 14: 9002}
    assert progress[-1].stateOperators[0].numRowsTotal <= 3 and sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 0  # hosts a, b and c are forgotten


def test_slots_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, free, gap = np.sort(rng.integers(0, 100, 20)), int(rng.integers(0, 100)), int(rng.integers(1, 9))
        want, at_ = [], free
        for x in a:
            want.append(max(int(x), at_))
            at_ = want[-1] + gap
        assert throttle.slots(a, free, gap).tolist() == want


CLICK = "id long, key string, ts timestamp, arrived timestamp"


def test_late_rows_are_set_apart_or_left_out(spark, folder):
    day = 86400
    batches = [[(1, "k", at(0), at(1)), (2, "k", at(60), at(61))], [(3, "k", at(3 * day), at(3 * day))], [(4, "k", at(90), at(3 * day)), (5, "k", at(3 * day - 60), at(3 * day + 1)), (6, "k", None, at(5))], [(7, "z", at(9 * day), at(9 * day))], [(8, "z", at(9 * day), at(9 * day))]]
    counted = lambda rows: windows.sessions(rows, "key", "ts", "5 minutes", "1 day", F.count("*").alias("n"), F.min("id").alias("first"))
    raw, progress = stream(spark, folder, CLICK, counted, *batches)
    assert {(r[4], r[3]) for r in raw[-1]} == {(1, 2), (3, 2)}  # row 4 came when its session was closed
    assert raw[0] == [] and {(r[4], r[3]) for r in raw[1]} == {(1, 2)}
    everything = [r for b in batches for r in b]
    good, late = windows.on_time(spark.createDataFrame(everything, CLICK), "ts", "arrived", "1 day")
    assert [r.id for r in late.collect()] == [4] and sorted(r.id for r in good.collect()) == [1, 2, 3, 5, 7, 8]


def test_sliding_windows_hold_a_row_several_times(spark, folder):
    make = lambda s: windows.sliding(s, "key", "ts", "10 minutes", "5 minutes", "1 hour", F.count("*").alias("n"))
    got, _ = stream(spark, folder, CLICK, make, [(1, "k", at(0), at(0)), (2, "k", at(299), at(299)), (3, None, at(300), at(300))], [(9, "z", at(10**6), at(10**6))], [(9, "z", at(10**6), at(10**6))])
    minute = lambda t: (t.replace(tzinfo=timezone.utc) - T0).total_seconds() / 60
    assert {(k, minute(t), n) for k, t, n in got[-1]} == {("k", -5, 2), ("k", 0, 2), (None, 0, 1), (None, 5, 1)}


def test_replies_within_their_time(spark, folder):
    """Replies in the same, a later and a too late batch; state of what can't be met any more goes."""
    def batch(asked, said):
        spark.createDataFrame(asked, "key string, id long, called timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/calls")
        spark.createDataFrame(said, "key string, reply long, replied timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/replies")
        a = spark.readStream.schema("key string, id long, called timestamp").parquet(f"{folder}/calls")
        b = spark.readStream.schema("key string, reply long, replied timestamp").parquet(f"{folder}/replies")
        query = to_table(windows.replies(a, b, "key", "called", "replied", "10 minutes", "1 minute"), folder)
        query.awaitTermination()
        return sorted((r.id, r.reply) for r in spark.read.parquet(f"{folder}/out").collect()), query.recentProgress[-1].stateOperators[0].numRowsTotal

    assert batch([("a", 1, at(0)), ("b", 2, at(0))], [("a", 10, at(5)), ("a", 11, at(-5)), ("b", 12, at(601)), (None, 13, at(1))])[0] == [(1, 10)]
    assert batch([("a", 3, at(300))], [("a", 14, at(600)), ("b", 15, at(600))])[0] == [(1, 10), (1, 14), (2, 15), (3, 14)]
    assert batch([("z", 4, at(10**6))], [("z", 16, at(10**6))])[0][-1] == (4, 16)
    rows, state = batch([("z", 5, at(10**6))], [("a", 17, at(310))])
    assert (3, 17) not in rows and state <= 4
