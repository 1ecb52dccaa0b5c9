"""Packing fills sequences however many pieces a task has, and keeps every piece."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import packing

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lengths_like_documents(n):
    """Mostly half a sequence or less, some whole ones, as cut documents are."""
    rng = np.random.default_rng(7)
    return np.where(rng.random(n) < 0.25, 2048, np.clip(rng.lognormal(6.3, 0.8, n), 2, 2048)).astype(int)


@pytest.mark.parametrize("n", [7_000, 300_000])
def test_fill_does_not_fall_with_the_pieces_of_a_task(spark, n):
    length = lengths_like_documents(n)
    table = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "length": length})).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.lit(1).cast("long").alias("ids_crc32"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all of them in one task
    try:
        got = packing.pack(table).select("doc_id", "length", "sequence_id", "offset").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == n and got.doc_id.is_unique
    made = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (made["length"].sum() <= 2048).all() and (made["length"].cumsum() - made.obj["length"] == made.obj["offset"]).all()
    assert -(-int(length.sum()) // 2048) / made.ngroups >= 0.98


def test_blocks_keep_rows_in_order():
    parts = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 3), (3, 3), (3, 17), (17, 18), (18, 30))]
    got = list(packing.blocks(iter(parts), 5))
    assert [len(b) for b in got] == [5] * 6 and pd.concat(got).x.tolist() == list(range(30))
    assert list(packing.blocks(iter([]), 5)) == []


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, 0, 0, 5, 1), (1, 0, 0, 2048, 2), (1, 0, 0, 2048, 2), (2, 0, 0, 1, 3)]
    table = spark.createDataFrame(rows, PIECES).withColumn("sequence_id", F.lit("mine")).withColumn("offset", F.lit("mine")).withColumn("kind:of", F.lit("x"))
    got = packing.pack(table).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 2048), ("1", 2048), ("2", 1), ("None", 5)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4 and {r["kind:of"] for r in got} == {"x"}
    assert packing.pack(table.where("false")).count() == 0
