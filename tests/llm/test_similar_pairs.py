"""Near-duplicates are found whole: every pair that is alike ends up in one component."""

import numpy as np

from corpusmill.llm import simhash


def brute(texts, similarity=0.8):
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def groups(pairs, ids):
    least = {i: i for i in ids}
    for _ in ids:
        for u, v in pairs:
            least[u] = least[v] = min(least[u], least[v])
    return least


def held(spark, texts):
    want = brute(texts)
    got = {(r.u, r.v) for r in simhash.similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got <= want and groups(got, texts) == groups(want, texts)
    return want


def test_appended_removed_and_replaced_passages(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50_000, n))
    texts = {}
    for k in range(60):
        n = 12_000 if k % 20 == 19 else int(rng.integers(40, 900))
        text, share = words(n), float(rng.uniform(0.80, 0.85))
        cut = text.split()
        edit = int(n * (1 - share))
        texts[2 * k] = text
        texts[2 * k + 1] = [f"{text} {words(int(n / share) - n - 4)}", " ".join(cut[edit:]), " ".join([*cut[: n // 2], *words(edit // 2).split(), *cut[n // 2 + edit // 2 :]])][k % 3]
    assert len(held(spark, texts)) > 50


def test_partners_behind_a_shared_passage(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50_000, n))
    shared, texts = words(60), {}
    for k in range(40):  # of A < B < C only A and C are alike, and all hold the passage
        own = words(60)
        texts[k], texts[1000 + k], texts[2000 + k] = f"{shared} {own}", f"{shared} {words(60)}", f"{shared} {own} {words(8)}"
    assert len(held(spark, texts)) >= 40


def test_alike_to_one_text_only(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    texts = {50: " ".join(base)}
    for k in range(100):  # each is alike to the text in the middle, few to each other
        own = list(base)
        for at in rng.choice(400, 9, replace=False):
            own[at] = f"x{rng.integers(1 << 30)}"
        texts[k if k < 50 else k + 1] = " ".join(own)
    held(spark, texts)


def test_every_link_of_a_whole_table(spark):
    """All documents of a table, of every length, against all pairs: recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = brute(texts)
    got = {(r.u, r.v) for r in simhash.similar_pairs(docs).collect()}
    assert got <= want and groups(got, texts) == groups(want, texts) and len(want) > 20


def test_large_groups_with_outliers(spark):
    """One large group whose members differ at the limit, a passage that most texts begin with, and a few texts alike to single members."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    base, opening, texts = words(120), words(60), {}
    for k in range(300):
        own = list(base)
        for at in rng.choice(115, int(rng.integers(1, 4)), replace=False):
            own[at] = f"x{rng.integers(1 << 30)}"
        texts[k] = " ".join(own)
        texts[1000 + k] = " ".join(opening + words(int(rng.integers(5, 80))))
    held(spark, texts)


def test_repeated_ids_keep_all_their_texts(spark):
    long = [f"w{i}" for i in range(100)]
    x, y, z = " ".join(long), " ".join([*long[:99], "other"]), " ".join(f"z{i}" for i in range(50))
    rows = [(1, z, "a"), (1, x, "b"), (2, y, "c"), (2, z + " end", "d"), (3, "alone in here", "e"), (3, "alone in here", "f"), (None, x, "g"), (4, None, "h"), (5, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.node for r in left.collect()) == ["a", "b", "e", "f", "g", "h"]


def test_hot_nodes_do_not_change_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    monkeypatch.setattr(simhash.hot_keys, "__defaults__", (5,))
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(59, 200), (None, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(60), 200]} | {100 + i: 100 for i in range(31)}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_parities_bound_the_difference(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    for n, m in ((10, 12), (250, 260), (500, 540), (3000, 2500)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: min(n, m) * 9 // 10], rng.integers(0, 2**63, m // 5).astype(np.uint64)]))
        x, y = simhash.parities(a), simhash.parities(b)
        least = simhash.least_difference(x, y)
        assert least <= len(np.setxor1d(a, b)) and least >= 0.5 * len(np.setxor1d(a, b))
        row = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>").select(simhash.differing(F.col("a"), F.col("b")).alias("d"), simhash.differing(F.col("b"), F.col("a")).alias("e")).first()
        assert (row.d, row.e) == (least, least)


def test_merging_groups(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9), (10, 9)], "node long, group long")
    links = spark.createDataFrame([(2, 6), (1, 2), (7, 10), (20, 21)], "u long, v long")
    assert {r.node: r.group for r in simhash.merged(labels, links).collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 9: 7, 10: 7, 7: 7, 20: 20, 21: 20}


def test_ids_that_repeat_at_both_ends_of_64_bits(spark):
    """Rows of one id with several texts are told apart by numbers of their own, which no real id can meet."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50_000, n))
    a, b, c = words(100), words(100), words(100)
    rows = [(2**63 - 1, a), (2**63 - 1, b), (2**63 - 2, f"{b} more"), (2**62 + 5, c), (2**62 + 6, f"{c} more"), (-(2**63), f"{a} more"), (7, words(50)), (7, words(60)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.similar_pairs(docs).collect()} == {(-(2**63), 2**63 - 1), (2**63 - 2, 2**63 - 1), (2**62 + 5, 2**62 + 6)}
    left = sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs).collect())
    assert left == sorted(map(str, [-(2**63), 2**63 - 2, 2**62 + 5, 7, 7, None]))  # of each group the least id stays, with its text


def test_unlike_texts_on_one_key_meet_in_blocks(spark):
    """Many texts that share a passage but no more: their common keys are dealt to blocks, no task of the last join gets a key whole, and the pairs are those of brute force."""
    from corpusmill.llm import common

    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, i) for i in range(40)], "key int, node long")
    hot = common.hot_blocks(rows, "key")
    assert [(r.key, r.blocks) for r in hot.collect()] == [(1, 15)]
    met = common.block_pairs(rows, "key", "node", hot)
    sizes = [r["n"] for r in met.groupBy("a.key", "a.__x", "a.__y").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 15 * 16 // 2 + 1 and sum(sizes) == 3000 * 2999 // 2 + 40 * 39 // 2 and max(sizes) < 300 * 300
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = {k: f"{passage} " + " ".join(f"w{i}" for i in rng.integers(0, 10**6, 6)) for k in range(500)}
    texts |= {1000 + k: texts[k] + " end" for k in range(0, 500, 50)}
    assert len(held(spark, texts)) >= 10
