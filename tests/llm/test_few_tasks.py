"""On many partitions the rounds of near-dedup stay small: the driver keeps a record of every task, so a few edges or draws must not have thousands."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.llm import simhash
from corpusmill.llm.common import packed


def tasks(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    try:
        got = run()
        told = sc.statusTracker()
        jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup("counted")]
        return got, sum(told.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if told.getStageInfo(s).numCompletedTasks)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_edges_take_few_tasks(spark):
    chains = [(10 * k + i, 10 * k + i + 1) for k in range(40) for i in range(6)] + [(1000, 1001 + i) for i in range(300)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame(chains, "u long, v long").coalesce(1)
        got, n = tasks(spark, lambda: {r.node: r.component for r in simhash.components(edges).collect()})
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {**{10 * k + i: 10 * k for k in range(40) for i in range(7)}, **{1000 + i: 1000 for i in range(301)}}
    assert n < 1500, n


def test_packed_keeps_large_tables_spread(spark):
    assert [packed(spark.range(0, 1000, 1, 40), n).rdd.getNumPartitions() for n in (0, 10, 500_001, 10**9)] == [8, 8, 11, 40]


def before(order):
    return F.last("row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def test_draws_are_one_plan_and_the_same_rows(spark):
    rows = spark.range(600).select((F.col("id") % 7).alias("key"), F.struct(F.col("id").alias("doc_id"), (20 + F.col("id") % 9).cast("int").alias("n"), (F.col("id") % 5).cast("int").alias("place")).alias("row"), (F.col("id") % 90).alias("group"))
    hot = spark.createDataFrame([(3, 5000)], "key long, times long")
    together = simhash.shuffled(rows, before, hot, 600, range(4, 12))
    plan = together._jdf.queryExecution().executedPlan().toString()
    alone = [r for s in range(4, 12) for r in simhash.shuffled(rows, before, hot, 600, range(s, s + 1)).collect()]
    assert alone and sorted(together.collect()) == sorted(alone)
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2
