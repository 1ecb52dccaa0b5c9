"""op3 on a whole table against rules written out by hand, and what the network is given to score."""

import hashlib
import string

import numpy as np
import pytest

from corpusmill.llm import queries, secrets

SF = "/root/testdata/sf0.01"
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"


def lowered(c):
    return chr(ord(c) + 32) if "A" <= c <= "Z" else c


def assign_at(text, i):
    """(start of the value, end) of an assignment that begins at i, or None; step by step."""
    low = "".join(map(lowered, text[i : i + 8]))
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if low.startswith(word):
            j = i + len(word)
            for quoted in ((1, 0) if text[j : j + 1] in ("'", '"') and text[j : j + 1] else (0,)):
                k = j + quoted
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "="):
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                end = k
                while end < len(text) and text[end] in VALUE:
                    end += 1
                if end > k:
                    return k, end
    return None


def brute(text):
    out, i = [], 0
    while i < len(text):
        got = assign_at(text, i) if lowered(text[i]) in "psta" else None
        if got:
            out += [("assign", i, got[1])] * (got[1] - got[0] >= 6)
            i = got[1]
        else:
            i += 1
    for kind, first, allowed, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            if not text.startswith(first, i):
                i += 1
                continue
            end = i + len(first)
            while end < len(text) and text[end] in allowed:
                end += 1
            if end > i + len(first):
                out += [(kind, i, end)] * (end - i >= least)
            i = max(end, i + 1)
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def test_rules_by_hand():
    for text in ("token = 'abcdef", "PassWD\":  x1y2z3", "api-key=abcdef", "secret=token: abcdefgh", "APIKEY=" + "a" * 6, "AKIAAKIA" + "B" * 12, "AKIA" + "b" * 20, "f" * 23 + "g" + "f" * 24, "token='short secret:longer_one", "toKen=abcdef", ""):
        assert secrets.rule_spans(text) == brute(text), text


def test_query_on_the_whole_table(spark):
    rows = {r.doc_id: r for r in queries.queries()["op3_secret_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 0
    for d in docs:
        want = brute(d.text or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = rows[d.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return secrets.fit(docs)


def test_every_candidate_and_rule_span_is_scored(net):
    texts = ["a plainlowercaserunofletters b", "card 4417744280351547 c", "token = abcdef", "x " + "-" * 40 + " y", JWT]
    seen = []
    score = net.scores
    net.scores = lambda x: seen.append(len(x)) or score(x)
    try:
        rules, found = secrets.find(texts, net)
    finally:
        del net.scores
    assert sum(seen) == 4 + len(secrets.windows(0, len(JWT)))
    assert [len(f) for f in found[:4]] == [0, 0, 1, 0] and [(k, a, b) for k, a, b in found[4]] == [("model", 0, len(JWT))]


def test_held_findings_and_documents(net, spark):
    held = secrets.written_findings(1500, 99)
    top = np.array([net.scores(np.stack([secrets.codes(t, *w) for w in secrets.windows(a, b)])).max() for t, a, b, _ in held]) >= net.threshold
    label = np.array([y for *_, y in held]) > 0
    assert top[label].mean() >= 0.97 and top[~label].mean() <= 0.03
    lines = [x for d in spark.read.parquet(f"{SF}/documents.parquet").collect() for x in secrets.labelled_lines(d.text or "")]
    score, y = net.scores(np.stack([secrets.coded(x) for x, _ in lines])) >= net.threshold, np.array([y for _, y in lines]) > 0
    assert y.sum() > 10 and score[y].mean() >= 0.95 and score[~y].mean() <= 0.01


def test_nulls_repeats_clashes_and_an_empty_table(spark, net):
    rows = [(1, "token=abcdef", "a"), (1, "token=abcdef", "b"), (None, "f" * 30, "c"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.scan(docs, net).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", "assign:0:12"), ("1", "assign:0:12"), ("2", ""), ("None", "hex:0:30")]
    masked = secrets.mask_secrets(docs, net)
    assert masked.columns == docs.columns and sorted(str(r.text) for r in masked.collect()) == ["None", "[SECRET]", "[SECRET]", "[SECRET]"]
    assert secrets.scan(docs.where("false"), net).count() == 0 and secrets.mask_secrets(docs.where("false"), net).count() == 0
    plain = spark.createDataFrame([(5, "no long runs at all")], "doc_id long, text string")
    assert secrets.sample_findings(plain) == [] and secrets.fit(docs.where("false"), written=200).threshold > 0
