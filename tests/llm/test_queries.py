"""The queries op1, op2, op4, op8 and op9 on a whole table against brute force; repeated and null ids of op8."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corpusmill.llm import queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_op1(spark, texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    ids: dict = {}
    for i, n in norm.items():
        ids.setdefault(n, []).append(i)
    got = {r.doc_id: tuple(r) for r in run(spark, "op1_exact_dedup")}
    assert got == {i: (i, min(ids[n]), len(ids[n]), min(ids[n]) == i, hashlib.sha256(n.encode()).hexdigest()) for i, n in norm.items()}


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), run(spark, "op2_best_fit_packing")
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for i, text in texts.items():
        ids, at = t.encode(text, add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
        total += at
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 5  # one bin a task may stay open


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    got = {r.doc_id: tuple(r) for r in run(spark, "op4_token_file")}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [1]
        assert got[i] == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(fps):
    label = dict.fromkeys(fps)
    label = {i: i for i in fps}
    while True:
        new = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == label:
            return label
        label = new


def test_op8(spark, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    label = classes(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash")} == {i: (f"{fps[i]:016x}", label[i]) for i in texts}


def test_op8_with_repeated_and_null_ids(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (1, "x y z"), (3, "x y z"), (None, "q r s"), (None, None), (7, ""), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    f = lambda t: f"{fingerprint(t):016x}"
    assert got == sorted([("3", f("a b c d"), 3)] * 2 + [("None", f("a b c d"), 3), ("1", f("x y z"), 1), ("3", f("x y z"), 1), ("None", f("q r s"), None), ("None", f(""), 7), ("7", f(""), 7)], key=lambda r: (r[0], r[1], str(r[2])))


def test_op9(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op9_sentencepiece")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t)
        assert (got[i].n_ids, got[i].ids_crc32, got[i].same) == (len(ids), crc(ids), sp.decode(ids) == t)
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op8_with_ids_of_any_size(spark):
    """Ids at both ends of 64 bits beside null and repeated ones: links and names as by brute force."""
    big, low = 2**63 - 1, -(2**63)
    texts = ["a b c d e f g h", "a b c d e f g h", "x y z", "x y z", "q r s t", "", "a b c d e f g h", "k l m", "k l m", "n o p"]
    ids = [big, big - 1, 2**62 + 10, 2**62 + 11, low, low + 1, None, None, 2**62 + 12, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    fps = [fingerprint(t) for t in texts]
    label = classes(dict(enumerate(fps)))
    name = [min((j for k, j in zip(label, ids) if label[k] == label[i] and j is not None), default=None) for i in label]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((str(i), f"{f:016x}", str(n)) for i, f, n in zip(ids, fps, name))


def test_links_of_any_fingerprints(spark):
    """Fingerprints are nodes themselves, negative ones too."""
    heads = spark.createDataFrame([(fp, fp) for fp in (0b1011, 0b1010, 0xFF00FF, 0xFF00FE, -1, -2, -4)], "fp long, head long")
    pairs = {tuple(r) for r in simhash.components(simhash.links(heads)).collect()}
    assert pairs == {(0b1011, 0b1010), (0b1010, 0b1010), (0xFF00FF, 0xFF00FE), (0xFF00FE, 0xFF00FE), (-1, -4), (-2, -4), (-4, -4)}
