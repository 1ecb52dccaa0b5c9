"""The unbounded crawl: depths by brute force, rounds that are begun again, and plans that move the frontier alone."""

import tempfile

import numpy as np

from corpusmill.operators.crawl import Reach
from corpusmill.sources import files


def brute(seeds, links):
    out, level, depth = {}, {s for s in seeds if s}, 0
    while level:
        out |= dict.fromkeys(level, depth)
        depth += 1
        level = {b for a, b in links if a in level and b} - set(out)
    return out


def test_reach_and_rounds_begun_again(spark):
    rng = np.random.default_rng(8)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 200, (260, 2))] + [(f"d{k}", f"d{k + 1}") for k in range(6)] + [("n1", "n1"), (None, "n2"), ("n3", None), ("n0", "d0"), ("n0", "d0")]
    edges, seeds = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("n0",), ("n0",), ("n5",), (None,)], "node string")
    want = brute(["n0", "n5"], links)
    root = "file://" + tempfile.mkdtemp()
    part = {r.node: r.depth for r in Reach(spark, root, 4).run(seeds, edges, rounds=2).collect()}
    assert part == {n: d for n, d in want.items() if d <= 2} and max(want.values()) > 6
    again = Reach(spark, root, 4)
    again._put(spark.createDataFrame([("ghost",)], "node string"), 3)  # a round that was written but not noted
    files.put_text(spark, f"{root}/done.json", '{"round": 2}')
    got = [tuple(r) for r in Reach(spark, root, 4).run(seeds, edges).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert Reach(spark, "file://" + tempfile.mkdtemp(), 4).run(seeds.where("false"), edges).count() == 0


def test_only_the_frontier_moves(spark):
    reach = Reach(spark, "file://" + tempfile.mkdtemp(), 4)
    reach.run(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, seen = spark.table(f"{reach.name}_links"), spark.table(f"{reach.name}_visited")
        plan = reach.step(seen, edges, 1)._jdf.queryExecution().sparkPlan().toString(), reach.step(seen, edges, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 1 <= plan[1].count("Exchange hashpartitioning") <= 2 and "ENSURE_REQUIREMENTS" not in plan[1]
