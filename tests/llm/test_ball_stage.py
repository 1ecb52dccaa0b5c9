"""The pipeline's near-dedup begins with ball hashing of fingerprints, and ends with exact groups."""

import corpus_pipeline as P
from corpusmill.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def groups(edges):
    at = {}
    for u, v in edges:
        a, b = at.setdefault(u, {u}), at.setdefault(v, {v})
        if a is not b:
            a |= b
            at.update((x, a) for x in b)
    return {x: min(s) for x, s in at.items()}


def test_ball_pairs_connect_what_op8_connects(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = groups([(r.u, r.v) for r in simhash.ball_pairs(docs.selectExpr("doc_id", "coalesce(text, '') as text")).collect()])
    told = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found and told == {i: found.get(i, i) for i in told}


def test_the_stage_takes_its_candidates_from_balls(spark, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda heads, radius=2: seen.append(radius) or links(heads, radius))
    P.drop_near_copies(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert seen == [2]
