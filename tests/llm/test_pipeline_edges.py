"""Every stage with nulls, repeated ids, ties, clashing columns, long texts, and empty tables."""

import pytest

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, __gone int, key string, score string, sequence_id long"
PROSE = "The and then of thing thble attion with words that make a fine document here. " * 6


@pytest.fixture(scope="module")
def docs(spark):
    near = PROSE.rstrip()[:-5] + "there."
    texts = [(1, PROSE), (2, PROSE.replace(" ", "  ")), (2, "other words of the id that comes twice, long enough to be kept apart"), (3, near), (None, PROSE), (None, None), (4, None), (5, ""), (6, "token = abcdef123456 " + PROSE[::-1]), (6, "token = abcdef123456 " + PROSE[::-1]), (7, "x " * 30_000)]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "a", 1, "k", "0.9", 3) for i, t in texts], SCHEMA).repartition(3)


def rows(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_exact_copies(spark, docs):
    left = P.drop_exact_copies(spark, docs, FOLDER)
    assert left.columns == docs.columns
    assert [(i, t[:5]) for i, t in rows(left)] == [("1", PROSE[:5]), ("2", "other"), ("3", PROSE[:5]), ("4", ""), ("6", "token"), ("6", "token"), ("7", "x x x")]


def test_near_copies(spark, docs):
    left = P.drop_near_copies(spark, docs, FOLDER)
    assert left.columns == docs.columns
    got = [(i, t[:5]) for i, t in rows(left)]
    assert got == [("1", PROSE[:5]), ("2", "other"), ("4", ""), ("6", "token"), ("6", "token"), ("7", "x x x"), ("None", ""), ("None", PROSE[:5])]


def test_masked_secrets(spark, docs):
    left = P.mask_secrets(spark, docs, FOLDER)
    assert left.columns == docs.columns and left.count() == docs.count()
    got = left.collect()
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None) and sum(r.text is None for r in got) == 2
    assert [r.text.startswith("[SECRET] ") for r in got if r.doc_id == 6] == [True, True] and not any("abcdef123456" in (r.text or "") for r in got)


def test_quality(spark, docs):
    left = P.judge_quality(spark, docs, FOLDER)
    assert left.columns == docs.columns and set(rows(left)) <= set(rows(docs))
    assert sum(i == "6" for i, _ in rows(left)) in (0, 2)


def test_packing(spark, docs):
    got = P.pack(spark, docs, FOLDER).collect()
    places = {(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}
    assert len(places) == sum(r.length for r in got) and all(r.offset + r.length <= P.CAPACITY for r in got)
    assert sum(r.length == 1 for r in got) == 3 and max(r.piece for r in got) >= 10


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_tables(spark, docs, name, stage):
    left = stage(spark, docs.where("false"), FOLDER)
    assert left.count() == 0 and (name == "packing" or left.columns == docs.columns)
