"""Spelling variants against brute force: the whole table, and nulls, repeats, ties, long words, hot keys and clashing columns."""

import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import common, queries, spelling

SF = "/root/testdata/sf0.001"


def counted(rows, least=7):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 2}


def apart(a, b):
    """Exactly one edit: what is left of both after their common beginning and end."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:]


def slow(n):
    near = {w: [] for w in n}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(k, ()) if apart(w, v)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def told(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = told(queries.queries()["op12_spelling_variants"](spark, SF))
    assert got == slow(counted(docs)) and sum(r[4] for r in got) > 0


def test_edges(spark):
    rows = [(i, f"{'banana ' * 30} bananas bananas Bananás BANANÁS {'cabbages ' * 3}") for i in range(40)]
    rows += [(None, "cabbage cabbage cebbage cebbage Ünterhalt ünterhalt"), (None, None), (7, ""), (7, "cabbage cabbage"), (7, "cabbage cabbage"), (-5, "aaaaaaa aaaaaaaa aaaaaaaaa " * 2)]
    rows += [(2**63 - 1, f"{'x' * 5000}y {'x' * 5000}z " * 2), (3, "÷×÷×÷×÷ ÷×÷×÷×÷ sevenchr-sevenchr1sevenchar"), (4, "zebrafi zebrafi zebrafo zebrafo zebrafu zebrafu " + "zebrafx " * 20 + "zebrafy " * 20)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    assert told(spelling.spelling_variants(docs)) == slow(counted(rows))
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, least_chars=3)


def test_roots_follow_every_form(spark):
    """n grows tenfold with every step of a chain of forms."""
    chain = ["aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [(k, f"{w} " * (2 * 10**k)) for k, w in enumerate(chain)]
    n = counted(rows)
    got = told(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == slow(n) and {r[2] for r in got} == {chain[-1]}


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.integers(0, 40), st.sampled_from("abé"), st.sampled_from(["put", "drop", "change"]), st.randoms())
def test_words_one_edit_apart_share_a_key(word, at, letter, how, rng):
    at %= len(word)
    other = {"put": word[:at] + letter + word[at:], "drop": word[:at] + word[at + 1 :], "change": word[:at] + letter + word[at + 1 :]}[how]
    grams = sorted({w[i : i + 2] for w in (word, other) for i in range(len(w) - 1)})
    rng.shuffle(grams)
    counts = {g: k for k, g in enumerate(grams)}
    assert other == word or spelling.keys_of(word, counts) & spelling.keys_of(other, counts)


def test_blocks_give_the_same_pairs(spark):
    rows = spark.createDataFrame([(k % 3 if k % 4 else 0, k) for k in range(400)], "key int, v long")
    want = {(a, b) for a in range(400) for b in range(a) if (a % 3 if a % 4 else 0) == (b % 3 if b % 4 else 0)}
    hot = common.hot_blocks(rows, "key", block=30)
    assert hot.count() == 3
    for h in (None, hot):
        got = [(r[0], r[1]) for r in common.block_pairs(rows, "key", "v", h).selectExpr("greatest(a.v, b.v)", "least(a.v, b.v)").collect()]
        assert len(got) == len(set(got)) and set(got) == want
