"""Ids at both ends of 64 bits come through every operator exactly, beside null ids in the same batch."""

from functools import partial

import pytest

from corpusmill.llm import merkle, packing, queries, secrets, sentencepiece_codec, simhash, token_file
from corpusmill.llm.bpe import byte_bpe, word_bpe

IDS = [2**63 - 1, 2**63 - 2, 2**53 + 1, -(2**63), -(2**53) - 1, None, None, 0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"some words, number {k}") for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("name", ["simhash", "merkle", "marks", "packing", "secrets", "tokens", "pieces", "coded"])
def test_ids(spark, docs, name):
    path = queries.tokenizer_path
    run = {
        "simhash": lambda: simhash.near_duplicates(docs),
        "merkle": lambda: merkle.compare_with_edits(docs, 2),
        "marks": lambda: merkle.fingerprint_documents(docs),
        "packing": lambda: packing.pack_documents(docs, partial(byte_bpe, path("byte_bpe_50k.json")), 2048, 0),
        "secrets": lambda: secrets.scan(docs, secrets.fit(docs)),
        "tokens": lambda: token_file.read_tokens(token_file.write_tokens(docs, partial(word_bpe, path("word_bpe_49k.json")), token_file.new_folder(spark), 1)),
        "pieces": lambda: sentencepiece_codec.round_trip(docs, path("piece_bpe_32k.model")),
        "coded": lambda: sentencepiece_codec.encode_documents(docs, path("piece_bpe_32k.model")),
    }[name]
    assert ids(run()) == sorted(IDS, key=lambda i: (i is not None, i or 0))
