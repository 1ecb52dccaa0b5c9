"""Shards of bounded size, boundaries by select, nulls, repeats, clashing columns, empty tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import token_file


@pytest.fixture(scope="module")
def letters():
    """A tokenizer for tests, made within a function so that workers need not import this file: a character's number is its id."""

    class Letters:
        def ids(self, text):
            return np.array([ord(c) for c in text], dtype=np.uint32)

    return Letters


def crc(text):
    return zlib.crc32(np.array([*map(ord, text), 1], dtype="<u4").tobytes())


@pytest.mark.parametrize("shard_ids, shard_docs", [(1 << 26, 1 << 20), (50, 1 << 20), (1 << 26, 3)])
def test_shards_are_bounded_and_whole(spark, letters, tmp_path, shard_ids, shard_docs):
    rng = np.random.default_rng(2)
    texts = {i * 7: "ab" * int(rng.integers(0, 40)) for i in range(300)}
    rows = [(i, t, "file", 5) for i, t in texts.items()] + [(None, "zz", "f", 1), (None, None, "f", 1), (14, "same", "f", 1), (14, "same", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, base int").repartition(5)
    manifest = token_file.write_tokens(docs, letters, f"file://{tmp_path}/t", parts=4, shard_ids=shard_ids, shard_docs=shard_docs)
    told = manifest.collect()
    assert all(r.n_docs <= shard_docs and r.n_ids < shard_ids + 100 for r in told) and (len(told) > 50 or shard_ids > 50) and len(told) >= 4
    got = sorted(token_file.read_tokens(manifest).collect(), key=lambda r: r.start)
    want = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array([*map(ord, r[1]), 1], "<u2").tobytes()))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(t) + 1, crc(t))
        at += r.n_tokens


def test_one_document_by_select(tmp_path):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 60_000, int(n)).astype("<u2") for n in rng.integers(0, 30, 3000)]
    out = pa.BufferOutputStream()
    w = token_file.Writer(out, 2)
    for i, x in enumerate(ids):
        w.add(None if i == 5 else i, x.tobytes())
    w.close()
    raw = out.getvalue()
    shard = token_file.Shard(pa.BufferReader(raw))
    assert len(shard) == 3000 and shard.doc_ids[5] is None and all((shard.ids(i) == x).all() for i, x in enumerate(ids))
    assert [len(b) - 1 for b, _ in shard.documents()] == [512] * 5 + [440]
    assert len(raw) - 2 * sum(map(len, ids)) - 9 * 3000 <= 3001 * (2 + np.log2(sum(map(len, ids)) / 3000) + 1) / 8 + 100
    with pytest.raises(ValueError):
        token_file.Shard(pa.BufferReader(b"CMT1 something else that is long enough to have a trailer"))


def test_too_wide_ids_raise(spark, letters, tmp_path):
    docs = spark.createDataFrame([(1, "\U0001f600")], "doc_id long, text string")
    with pytest.raises(Exception, match="needs more than 2 bytes"):
        token_file.write_tokens(docs, letters, f"file://{tmp_path}/t")
    assert token_file.read_tokens(token_file.write_tokens(docs.where("false"), letters, f"file://{tmp_path}/e")).count() == 0
