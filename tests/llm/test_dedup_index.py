"""The extendible-hash index: no bucket stays overfull, chains, probes through the directory, hot texts, dropped rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup as X


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    clump = spark.range(1, 3001).select(F.shiftleft("id", 20).alias("h"))  # alike in their first 32 bits
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h")).union(clump).distinct()
    found = X.directory(hashes, 20, 4)
    cells = [c for _, frame in found.levels for c in frame.collect()]
    assert max(c.local_depth for c in cells) >= 40 and {c.owner for c in cells} == {0, 1, 2, 3}
    placed = found.place(hashes).collect()
    held: dict = {}
    for r in placed:
        held.setdefault(r.bucket, []).append(r.h % 2**64)
    depth = {c.bucket: c.local_depth for c in cells}
    assert len(placed) == hashes.count() and max(map(len, held.values())) <= 20
    assert all({h >> (64 - depth[b]) for h in hs} == {b % 2**64 >> (64 - depth[b])} for b, hs in held.items())
    order = sorted((b % 2**64, owner) for b, owner in {(r.bucket, r.owner) for r in placed})
    assert [o for _, o in order] == sorted(o for _, o in order)  # owners hold ranges


def test_texts_of_one_hash_are_a_chain(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 3)
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every text collides
    texts = ["a", "b", "a", "c", "b", "a", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (3, 100):  # merged before they move, and not
        monkeypatch.setattr(X, "HOT", hot)
        rows, index = X.build(docs)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in rows.collect()}
        assert got == {i: (min(j for j, u in enumerate(texts) if (u or "") == (t or "")), sum((u or "") == (t or "") for u in texts)) for i, t in enumerate(texts)}
        assert sorted(r.link for r in index.links.collect()) == [1, 2, 3, 4]


def test_probe_reads_the_bucket_that_the_directory_names(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3000).cast("string")).alias("text"))
    _, index = X.build(docs, capacity=16)
    asked = [("text 5", 5), ("text 2999", 2999), ("text 3000", None), ("", None)]
    rows = spark.createDataFrame(asked, "norm string, want long").select("want", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    assert sorted((r.want, r.keep_id, r.group_size) for r in X.probe(rows, index).collect()) == [(5, 5, 2), (2999, 2999, 1)]
    elsewhere = X.Index(index.directory, index.links.withColumn("bucket", F.col("bucket") + 1))
    assert X.probe(rows, elsewhere).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_copies_go_by_row(spark, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT", hot)
    rows = [(1, "A"), (2, "A"), (2, "B"), (None, "A"), (None, "C"), (3, " "), (4, "\t\n"), (5, None), (6, ""), (7, "A"), (7, "A")]
    docs = spark.createDataFrame([(i, t, "o", 1, "h") for i, t in rows], "doc_id long, text string, owner string, cell int, sha string")
    left = X.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect() if r.text is not None) == [("1", "A"), ("2", "B"), ("3", " "), ("None", "C")]
    assert [r.doc_id for r in left.where("text is null").collect()] == [5] and X.drop_copies(docs.where("false")).count() == 0
    told = X.exact_dedup(docs).collect()
    assert len(told) == len(rows) and {(r.keep_id, r.group_size) for r in told if r.text_sha256 == hashlib.sha256(b"A").hexdigest()} == {(1, 5)}
