"""Quality and toxicity against independent solutions, and both queries on whole tables."""

import zlib

import numpy as np
import pytest

from corpusmill.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n = (y > 0).sum()
    return (order[y > 0].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def table_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join(word() for _ in range(40)) + ("." if i % 3 else " #!" * int(rng.integers(0, 12))), int(i % 3 > 0)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_weights_solve_the_ridge_problem(spark):
    rows, table = table_of(spark, 400, 1)
    model = quality.fit(table, table.select("doc_id", "quality"))
    learn = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    x = np.stack([quality.statistics(t) for t, _ in learn])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z, y = model.lift(x), np.array([y for _, y in learn], float)
    gaps = []
    for ridge in (0.01, 0.1, 1.0, 10.0):  # least squares with a penalty, as one longer system without one
        rows_ = np.vstack([z, np.diag(np.sqrt([ridge] * (z.shape[1] - 1) + [1e-6]))])
        gaps.append(np.abs(np.linalg.lstsq(rows_, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0] - model.weights).max())
    assert min(gaps) < 1e-4


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    gamma = 0.5 / quality.SIZE
    model = quality.Model(np.zeros(quality.SIZE), np.ones(quality.SIZE), 20_000, gamma, 3)
    x = rng.normal(0, 1, (12, quality.SIZE))
    z = model.lift(x)[:, :-1]
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.05


def slow_isotonic(y):
    """Non-decreasing means: the greatest, over where a run begins, of the least mean over where it ends."""
    n = len(y)
    return np.array([max(min(np.mean(y[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_equals_the_slow_one():
    rng = np.random.default_rng(4)
    score = np.sort(rng.random(60))
    y = (rng.random(60) < score).astype(float)
    knots, levels = quality.isotonic(score, y)
    want, base = slow_isotonic(y), y.mean()
    for level in np.unique(np.round(want, 9)):
        own = np.abs(want - level) < 1e-9
        got = np.interp(score[own], knots, levels)
        assert np.allclose(got, (y[own].sum() + base) / (own.sum() + 1))
    # shrinking a run towards the mean never makes the levels fall
    assert (np.diff(levels) >= -1e-12).all()


@pytest.mark.parametrize("name, label, threshold, least", [("op5_quality", "quality", 0.3, 0.95), ("op7_toxicity", "toxic", 0.5, 0.6)])
def test_queries_on_the_whole_table(spark, name, label, threshold, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    assert auc(np.array([got[i].score for i in held]), np.array([labels[i] for i in held])) >= least


def test_held_out_labels_change_nothing(spark):
    _, table = table_of(spark, 200, 5)
    flipped = table.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = (quality.fit(table, x) for x in (table.select("doc_id", "quality"), flipped))
    assert (a.weights == b.weights).all() and (a.levels == b.levels).all()


def test_toxicity_fits_from_tables(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(1200):
        words = [word() for _ in range(50)]
        if i % 4 == 0:
            for k in rng.integers(0, 50, 3):
                words[k] = rng.choice(["vile", "awful"])
        rows.append((i, " ".join(words), int(i % 4 == 0), "x", None))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string, score string")
    net = toxicity.fit(table, table.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(table, net).join(table.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.9
    assert toxicity.fit(table, table.select("doc_id", "toxic"), longest=10).slope == 0.0


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_no_labels_nulls_repeats_and_an_empty_table(spark, kind):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "c", "z"), (2, None, None), (3, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    module, score = (quality, quality.score_quality) if kind == "quality" else (toxicity, toxicity.score_toxicity)
    for given in (labels, labels.where("false")):
        model = module.fit(docs, given)
        got = score(docs, model).collect()
        assert len(got) == 5 and {round(r.score, 9) for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    assert score(docs.where("false"), model).count() == 0
    if kind == "quality":
        assert quality.keep_good(docs, model).count() == 5 and quality.keep_good(docs.where("false"), model).columns == docs.columns
