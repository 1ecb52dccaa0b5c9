"""The climb of engines against the plain loop, and the checked clamp."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import policy


def slow(rows):
    """(engine, words, tried, escalated_from) of one url's (engine, status, words, ok) in order of tier."""
    more = lambda r: r[1] in (0, 403, 429, 503) or r[1] == 200 and (r[2] or 0) < 50
    best, tried = rows[0], 1
    if more(best):
        for r in rows[1:]:
            tried += 1
            if r[3] and (r[2] or 0) > (best[2] or 0):
                best = r
                if not more(best):
                    break
    return best[0], best[2] or 0, tried, rows[0][0] if best is not rows[0] else None


def test_climb(spark):
    rng = np.random.default_rng(11)
    pages = {f"u{k}": [(f"e{t}", int(rng.choice([200, 200, 200, 403, 404, 0])), None if rng.random() < 0.1 else int(rng.integers(0, 90)), None if rng.random() < 0.1 else bool(rng.random() < 0.7)) for t in range(int(rng.integers(1, 6)))] for k in range(300)}
    rows = [(u, e, t, s, w, ok) for u, rs in pages.items() for t, (e, s, w, ok) in enumerate(rs)]
    df = spark.createDataFrame(rows, "url string, engine string, tier int, status int, words int, ok boolean").repartition(5)
    got = {r.url: (r.engine, r.words, r.tried, r.escalated_from) for r in policy.escalated(df).collect()}
    assert got == {u: slow(rs) for u, rs in pages.items()} and policy.escalated(df.limit(0)).count() == 0


def test_checked_clamp(spark):
    values = [None, "7", " 9 ", "-3", "999", "x", "", "2.5"]
    got = [tuple(r.c) for r in spark.createDataFrame([(v,) for v in values], "v string").select(policy.clamped(F.col("v"), "n", 6, 1, 25).alias("c")).collect()]
    assert [g[0] for g in got] == [6, 7, 9, 1, 25, None, None, None] and [g[1] for g in got[5:]] == [f"'n' must be an integer, got '{v}'" for v in values[5:]]
