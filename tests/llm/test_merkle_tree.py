"""The tree against a slow one written out by recursion, its size, its comparison from the root, and op10 on a whole table."""

import base64
import hashlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corpusmill.llm import merkle, queries

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
PLACE, LENGTH, LEVEL, LINE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def above(children, level):
    """A branch's digest from its children's (digest, words)."""
    if len(children) == 1:
        return children[0][0]
    total = sum(mixed((d + (k + 1) * PLACE + n * LENGTH) & M) for k, (d, n) in enumerate(children)) & M
    return mixed(total ^ ((sum(n for _, n in children) * LENGTH + level * LEVEL) & M))


def heights(hashes):
    out = []
    for h in hashes:
        x, n = mixed(h ^ PLACE), 0
        while n < 15 and not x >> n & 1:
            n += 1
        out.append(n)
    for k in range(1, 16):
        below, run = [i for i, h in enumerate(out) if h >= k - 1], 0
        if len(below) <= 8:
            break
        for i in below:
            run += 1
            if out[i] >= k:
                run = 0
            elif run == 8:
                out[i], run = k, 0
    return out


def slow(text):
    lines = [[xxh64_intdigest(w.encode(), 10) for w in line.split(" ")] for line in text.split("\n")]
    words = [w for line in lines for w in line]
    ends, at = heights(words), -1
    for line, high in zip(lines, heights([above([(w, 1) for w in line], 16) for line in lines])):
        at += len(line)
        ends[at] = 16 + high
    ends[-1] = 31
    words = [mixed(w ^ LINE) if k + 1 == len(line) else w for line in lines for k, w in enumerate(line)]
    root = hashlib.blake2b(b"".join(w.to_bytes(8, "big") for w in words), digest_size=16).hexdigest()
    level, nodes = 0, [(w, e, 1) for w, e in zip(words, ends)]
    while sum(e >= level for e in ends) > merkle.NODES:
        level += 1
    for k in range(1, level + 1):
        out, held, size = [], [], 0
        for d, e, n in nodes:
            held.append((d, n))
            size += n
            if e >= k:
                out.append((above(held, k), e, size))
                held, size = [], 0
        nodes = out
    raw = b"".join(d.to_bytes(8, "big") + ((e << 27) | n).to_bytes(4, "big") for d, e, n in nodes)
    return f"{root}:{level:02x}:{base64.b64encode(raw).decode()}"


def some_texts():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 8))))
    for n in (0, 1, 2, 40, 49, 200, 900, 5000):
        yield " ".join(word() for _ in range(n))
        yield "".join(word() + ("\n" if rng.random() < 0.2 else " ") for _ in range(n))
    yield "same " * 3000
    yield "a line\n" * 500
    yield "\n\n  \n x"


def test_trees_equal_the_slow_ones():
    for text in some_texts():
        assert merkle.fingerprint(text) == slow(text), text[:60]
        assert str(merkle.Tree.parse(merkle.fingerprint(text))) == merkle.fingerprint(text)


def other_texts(text, rng):
    """The text with one small change each: a separator turned, a letter changed, neighbours swapped, a word twice, a piece moved."""
    at = [k for k, c in enumerate(text) if c in " \n"]
    if at:
        k = int(rng.choice(at))
        yield text[:k] + (" " if text[k] == "\n" else "\n") + text[k + 1 :]
        yield text[:k] + text[k] + text[k:]
        yield text[:k] + text[k + 1 :]
        words = text.split(" ")
        i = int(rng.integers(len(words)))
        yield " ".join([*words[: i + 1], *words[i:]])
        yield " ".join([*words[i:], *words[:i]])
        if i:
            yield " ".join([*words[: i - 1], words[i], words[i - 1], *words[i + 1 :]])
    if text:
        k = int(rng.integers(len(text)))
        yield text[:k] + ("x" if text[k] != "x" else "y") + text[k + 1 :]
    yield text + " "
    yield text + "\n"


def test_roots_test_equality():
    """Any change anywhere gives another root and a likeness under 1, on every text of a table and on texts made to fool sums and polynomials."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for text in [*texts, *some_texts()]:
        own = merkle.Tree.of(text)
        for other in other_texts(text, rng):
            if other != text:
                tree = merkle.Tree.of(other)
                assert tree.root != own.root and merkle.alike(own, tree)[0] < 1 and merkle.alike(tree, own)[0] < 1
    lines = "\n".join(" ".join(f"w{i}" for i in rng.integers(0, 1000, 9)) for _ in range(3000))
    breaks = [k for k, c in enumerate(lines) if c == "\n"]
    assert len({merkle.fingerprint(lines[:k] + " " + lines[k + 1 :]) for k in rng.choice(breaks, 50, False)} | {merkle.fingerprint(lines)}) == 51
    for n in (4096, 8192, 32768):  # Thue-Morse order, which defeats polynomials modulo a power of two
        one = " ".join("ab"[i.bit_count() % 2] for i in range(n))
        a, b = merkle.Tree.of(one), merkle.Tree.of(one.translate(str.maketrans("ab", "ba")))
        assert a.root != b.root and merkle.alike(a, b)[0] < 1


def test_size_is_bounded():
    rng = np.random.default_rng(7)
    long = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 400_000))
    assert max(len(merkle.fingerprint(t)) for t in [long, long.replace(" ", "\n"), "x " * 400_000, "\n" * 400_000]) <= 32 + 4 + merkle.NODES * 16


def test_differing_branches_locate_edits():
    rng = np.random.default_rng(8)
    for n in (30, 45, 300, 3000):
        words = [f"w{i}" for i in rng.integers(0, 10**6, n)]
        at = n // 2
        for changed in ([*words[:at], "new", *words[at + 1 :]], [*words[:at], *words[at + 1 :]], [*words[:at], "one", "more", *words[at:]]):
            a, b = merkle.fingerprint(" ".join(words)), merkle.fingerprint(" ".join(changed))
            found = merkle.edits(a, b) + merkle.edits(b, a)  # words that went, and words that came
            assert found and all(x <= at + 16 * n / merkle.NODES and y >= at - 16 * n / merkle.NODES for x, y in found)
            assert sum(y - x for x, y in found) <= max(3, n / 2) and merkle.likeness(a, b) >= 0.7
        assert merkle.likeness(a, a) == 1.0 and merkle.edits(a, a) == []
    assert merkle.likeness(merkle.fingerprint("one two"), merkle.fingerprint("three four")) == 0.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0


def test_query_on_the_whole_table(spark):
    rows = {r.doc_id: r for r in queries.queries()["op10_fingerprints"](spark, SF).collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: -d.doc_id)
    assert len(rows) == len(docs)
    for k, d in enumerate(docs):
        own, following = d.text or "", docs[(k + 1) % len(docs)].text or ""
        changed, r = own[: len(own) - len(own) // 3] + following[: len(own) // 3], rows[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (slow(own), slow(changed))
        assert r.near_edited == merkle.likeness(slow(own), slow(changed)) and r.near_next == merkle.likeness(slow(own), slow(following))
        same = 0  # words before the edit
        for x, y in zip(own.replace("\n", " ").split(" "), changed.replace("\n", " ").split(" ")):
            if x != y:
                break
            same += 1
        if own.count("\n") < 20 > changed.count("\n") and min(len(set(own.split(" "))), len(set(changed.split(" ")))) > 60:  # leaves of repetitive texts are coarse
            share = 2 * same / (len(own.split(" ")) + len(changed.split(" ")))
            assert abs(r.near_edited - share) < 0.25 and all(int(x.split("-")[1]) > same * 0.7 for x in r.edits.split(","))


@pytest.mark.parametrize("parts", [1, 4])
def test_nulls_repeats_clashes_and_an_empty_table(spark, parts):
    rows = [(1, "a b c", "p"), (1, "a b c", "q"), (None, "x", "r"), (2, None, "s"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = merkle.compare_with_edits(docs, parts).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 5), ("1", 5), ("2", 0), ("None", 0), ("None", 1)]
    assert len({r.fingerprint for r in got}) == 3 and merkle.compare_with_edits(docs.where("false"), parts).count() == 0
    assert merkle.fingerprint_documents(docs).count() == 5
