"""Saved responses of many pages lie in a bounded number of blocks."""

import os

from corpusmill.plans import lookups
from corpusmill.sources import responses as R


def test_blocks_don_t_grow_with_the_pages(spark, tmp_path):
    rows = [(f"Supplier#{k}", k) for k in range(0, 3000, 7)]
    spark.createDataFrame(rows, "s_name string, s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = lookups._saved(spark, str(tmp_path))
    root = (got if isinstance(got, str) else got[0]).removeprefix("file://")
    assert all(len(os.listdir(f"{root}/{p}")) <= R.MOST_BLOCKS for p in os.listdir(root) if p.startswith("provider="))
    feed = {r.provider: (r.pages, r.last_page) for r in lookups.response_feed(spark, str(tmp_path)).collect()}
    assert feed and set(feed.values()) == {(len(rows), rows[-1][1])}
