"""Streams in any parts, with and without the memory of words, give the library's ids."""

import numpy as np
import pytest
import sentencepiece

from corpusmill.llm import sentencepiece_codec as S
from corpusmill.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = np.random.default_rng(9)
    out = ["", " ", "a", "x" * 3000 + " y", " " * 900 + "z" + " " * 600, "ab " * 700, "日本語 " * 50 + "🙂" * 300, "▁▁ x▁", "the cat " * 40 + "q" * 700 + " end of it"]
    for _ in range(20):
        out.append("".join(rng.choice(list("  abcdeühnßt\n.,"), int(rng.integers(1, 1500)))))
    return out


@pytest.mark.parametrize("most", [2_000_000, 0, 5])
def test_parts_do_not_matter(most):
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Codec(PATH, most), np.random.default_rng(1)
    for text in texts():
        want = sp.encode(text)
        assert codec.encode(text).tolist() == want
        marked, on, out = (S.BLANK + text.replace(" ", S.BLANK)) if text else "", S.Stream(codec), b""
        while marked:
            n = int(rng.integers(1, 400))
            out, marked = out + on.feed(marked[:n]), marked[n:]
        assert np.frombuffer(out + on.finish(), "<u4").tolist() == want
    assert len(codec.known) <= max(most, 1)


def test_held_text_is_bounded():
    codec = S.Codec(PATH)
    on, most = S.Stream(codec), 0
    for _ in range(3000):
        on.feed("abcdefgh")
        most = max(most, len(on.open), on.on.kept_most if on.on else 0)
    assert most <= 3 * S.CHECK


def test_nulls_repeats_clashes_and_an_empty_table(spark):
    rows = [(1, "one two", "x"), (1, "one two", "y"), (None, "three", "z"), (2, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.round_trip(docs, PATH).collect()
    assert len(got) == 4 and all(r.same for r in got) and {r.n_ids for r in got if r.doc_id == 2} == {0}
    assert S.round_trip(docs.where("false"), PATH).count() == 0 and S.encode_documents(docs, PATH).count() == 4
