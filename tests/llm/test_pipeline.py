"""The pipeline's stages on a small table, each against what it must do to its input."""

import re

import corpus_pipeline as P
from corpusmill.llm import secrets, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    assert all(d.columns == columns for d in seen[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    lost = set(texts[0]) - set(texts[1])
    assert lost and sum(labels.get(i) == 1 for i in lost) <= 0.05 * sum(v == 1 for v in labels.values())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first: dict = {}
    for i in sorted(texts[1]):
        first.setdefault(norm(texts[1][i]), i)
    assert set(texts[2]) == set(first.values())
    sets = {i: simhash.shingle_set(t or "", 5) for i, t in texts[2].items()}
    for i in set(texts[2]) - set(texts[3]):
        assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)
    assert set(texts[4]) == set(texts[3])
    assert not any(secrets.rule_spans(t or "") for t in texts[4].values())
    assert {r.doc_id for r in seen[-1].collect()} == set(texts[4])
