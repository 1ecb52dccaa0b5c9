"""Line dedup against brute force: the whole table, and nulls, repeats, ties, blanks and clashing columns."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def slow(rows, least_chars=20, least_docs=3):
    """(doc_id, text, n_lines, n_dropped) of rows (doc_id, text); None is the least id."""
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= least_chars and len(holders[k]) >= least_docs and max(holders[k], key=order) != i for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in slow(docs)), key=repr)
    got = sorted(map(tuple, queries.queries()["op11_line_dedup"](spark, SF).collect()), key=repr)
    assert got == want and sum(r[2] for r in got) > 0


LONG = "the quick brown fox jumps"
EDGES = [
    (1, f"{LONG}\nmine"), (2, f"  {LONG.upper()}\t\r\n\n{LONG}\nyours\n"), (3, f"{LONG}"), (None, f"x\n{LONG} "), (None, f"{LONG}\ny"), (None, LONG),
    (4, f"{LONG} "), (5, f"{LONG} "), (5, f"{LONG} \nagain"), (5, None), (6, ""), (7, None), (8, "É" * 20), (9, "é" * 20), (10, "É" * 20), (11, "É" * 20 + "\n" + "É" * 19),
    (12, "nineteen characters"), (13, "nineteen characters"), (14, "nineteen characters"), (2**63 - 1, LONG), (-(2**63), LONG), (15, "\n\n\n"), (16, f"{LONG}\n" * 3000 + "end"),
]


def test_edges(spark):
    docs = spark.createDataFrame([(*r, 0, b"") for r in EDGES], "doc_id long, text string, keep_id int, hash binary")
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr) == slow(EDGES)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_hot_lines_are_spread(spark, monkeypatch):
    """With a low bound the commonest lines go by broadcast and the rest by the shuffle, with the same result."""
    rows = [(i, f"{LONG}\n{LONG} {i % 20}\nonly in document number {i}") for i in range(300)]
    monkeypatch.setattr(line_dedup, "HOT", 100)
    assert sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == slow(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.text("aB \n\té", max_size=14)), max_size=30))
def test_any_rows(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=2, least_docs=2)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows, 2, 2)
