"""SentencePiece encoding and decoding by a streaming Viterbi pass.

For every end of a prefix the pass keeps the best path's last piece. Scores live in a window of the longest piece's
length; backpointers are kept until the paths of all ends in that window run through one boundary, and the
ids before it are committed and forgotten. A unigram model's paths are weighed by the sum of its scores. In a BPE
model merges decide, not sums: a segmentation is the merges' result exactly if each two neighbouring pieces are
(the merges, run over the two together, give the two back). So a BPE path may continue only with a piece that can
follow its last one, and the one path left is the library's. No piece has a blank after another character, so the
start of a word (a run of blanks and what follows it) is a boundary of every path: there the stream commits without looking
back, and what a whole word's pass gave is remembered for its next occurrence. Within a long word the pass itself
commits wherever its paths converge. A stream takes text in parts and holds no more than an open word's window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusmill.llm.common import crc_u32, map_frames, text_rows

BLANK = "▁"
WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
#: What of a text still belongs to an open word, before and after its first character that is no blank.
REST, BODY = re.compile(f"{BLANK}*[^{BLANK}]*").match, re.compile(f"[^{BLANK}]*").match
CHECK, PART = 256, 1 << 16


def merges(text: str, rank: dict[str, float]) -> list[str]:
    """BPE of a short string: again and again the best-ranked (then leftmost) neighbours that form a piece become one."""
    parts = list(text)
    while len(parts) > 1:
        best = max(((rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            break
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Lattice:
    """A vocabulary for the pass: pieces, their scores, and what may follow what."""

    def __init__(self, scores: dict[str, float], bpe: bool, most: int = 1_000_000):
        self.scores, self.bpe, self.most = scores, bpe, most
        self.longest = max(map(len, scores), default=1)
        #: Every end of a piece, and whether it is a piece itself.
        self.tails = {p[i:]: False for p in scores for i in range(len(p))} | dict.fromkeys(scores, True)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.pairs: dict[tuple[str, str], bool] = {}

    def follows(self, a: str | None, b: str) -> bool:
        if a is None:
            return False
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            known = self.pairs[key] = merges(a + b, self.scores) == ([a, b] if a else [b])
        return known


class Viterbi:
    """feed(text) and finish() return the pieces committed so far; ``held`` characters wait."""

    def __init__(self, lattice: Lattice, check: int = CHECK):
        self.lattice, self.check = lattice, check
        self.text, self.last, self.sums, self.looked, self.kept_most = "", [""], [0.0], 0, 0

    def feed(self, text: str) -> list[str]:
        out = []
        for at in range(0, len(text), self.check):
            self._extend(text[at : at + self.check])
            if len(self.text) >= self.check:
                out += self._commit()
        return out

    def _extend(self, more: str) -> None:
        lat, last, sums, begin = self.lattice, self.last, self.sums, len(self.text)
        self.text = text = self.text + more
        scores, kind, longest, bpe, pairs, follows = lat.scores, lat.tails.get, lat.longest, lat.bpe, lat.pairs, lat.follows
        for end in range(begin + 1, len(text) + 1):
            start, found, piece = end - 1, [], text[end - 1]
            stop, is_piece = end - longest if end > longest else 0, kind(piece)
            while is_piece is not None:
                if is_piece:
                    found.append((last[start], piece))
                start -= 1
                if start < stop:
                    break
                piece = text[start:end]
                is_piece = kind(piece)
            if bpe:
                best = text[end - 1] if not found or found[0][1] != text[end - 1] else None  # a character that is no piece stands for itself
                for pair in reversed(found):
                    fits = pairs.get(pair)
                    if (follows(*pair) if fits is None else fits) and pair[0] is not None:
                        best = pair[1]
                        break
                last.append(best)
                continue
            best, mark = None, -np.inf
            for _, piece in reversed(found):  # longest first: ties go to the longer last piece
                if sums[end - len(piece)] + scores[piece] > mark:
                    best, mark = piece, sums[end - len(piece)] + scores[piece]
            char = text[end - 1]
            if char not in scores and sums[end - 1] + lat.unknown > mark:
                best, mark = char, sums[end - 1] + lat.unknown
            last.append(best)
            sums.append(mark)
        self.kept_most = max(self.kept_most, len(text))

    def _path(self, end: int) -> list[int]:
        """Boundaries of the best path to an end, from the end."""
        found = [end]
        while end > 0:
            end -= len(self.last[end])
            found.append(end)
        return found

    def _commit(self) -> list[str]:
        n = len(self.text)
        ends = [e for e in range(max(0, n - self.lattice.longest + 1), n + 1) if self.last[e] is not None]
        shared = set(self._path(ends[0]))
        for e in ends[1:]:
            shared &= set(self._path(e))
        return self._cut(max(shared))

    def _cut(self, at: int) -> list[str]:
        if not at:
            return []
        bounds = self._path(at)[::-1]
        out = [self.text[a:b] for a, b in zip(bounds, bounds[1:])]
        self.text, self.sums = self.text[at:], self.sums[at:]
        # what a BPE path may continue with depends on the last piece that went
        self.last = [self.last[at], *self.last[at + 1 :]]
        return out

    def finish(self) -> list[str]:
        out = self._cut(len(self.text))
        self.last, self.sums = [""], [0.0]
        return out


class Known(dict):
    """What is missing is made and kept, up to ``most``; then the memory begins anew."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self.make(key)
        if self.most:
            self[key] = found
        return found


class Stream:
    """feed(text) gives the id bytes committed so far, finish() the rest. Blanks are ``BLANK`` already; the text may come in any parts."""

    def __init__(self, codec: Codec, check: int = CHECK):
        self.codec, self.check, self.open, self.on, self.body = codec, check, "", None, False

    def feed(self, text: str) -> bytes:
        out = []
        if self.on is not None:  # a long word is open
            end = (BODY if self.body else REST)(text).end()
            self.body = self.body or text[:end].strip(BLANK) != ""
            out.append(self.codec.id_bytes_of(self.on.feed(text[:end])))
            if end == len(text):
                return out[0]
            out.append(self.codec.id_bytes_of(self.on.finish()))
            self.on, text = None, text[end:]
        words = WORD(self.open + text)
        self.open = words.pop() if words else ""
        out += map(self.codec.known.__getitem__, words)
        if len(self.open) > self.check:
            self.on, self.body = Viterbi(self.codec.lattice, self.check), self.open.strip(BLANK) != ""
            out.append(self.codec.id_bytes_of(self.on.feed(self.open)))
            self.open = ""
        return b"".join(out)

    def finish(self) -> bytes:
        out = self.codec.id_bytes_of(self.on.finish()) if self.on is not None else self.codec.known[self.open] if self.open else b""
        self.open, self.on = "", None
        return out


class Codec:
    """encode(text) -> ids, decode(ids) -> text, for a model file with byte fallback and no rewriting of characters; ``most`` words are remembered, none if 0."""

    def __init__(self, path: str, most: int = 2_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.number = {self.pieces[i]: i for i in plain}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.is_byte = np.isin(np.arange(len(self.pieces)), list(self.bytes.values()))
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.number) or len(self.bytes) != 256:
            raise ValueError("the model has pieces over word starts, or no byte fallback")
        # merges in a BPE model have scores 0, -1, -2, ...; a unigram model has log probabilities
        scores = {p: sp.get_score(i) for p, i in self.number.items()}
        self.lattice = Lattice(scores, all(float(s).is_integer() for s in scores.values()))
        self.known = Known(self._word, most)
        self.id_bytes = {p: i.to_bytes(4, "little") for p, i in self.number.items()}
        self.id_bytes_of_byte = {b: i.to_bytes(4, "little") for b, i in self.bytes.items()}

    def id_bytes_of(self, pieces: list[str]) -> bytes:
        ids = self.id_bytes
        return b"".join([ids[p] if p in ids else b"".join([self.id_bytes_of_byte[x] for x in p.encode("utf-8", "replace")]) for p in pieces])

    def _word(self, word: str) -> bytes:
        on = Viterbi(self.lattice)
        return self.id_bytes_of(on.feed(word) + on.finish())

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, streamed in parts."""
        if not text:
            return np.zeros(0, "<u4")
        text, on = BLANK + text.replace(" ", BLANK), Stream(self)
        out = [on.feed(text[i : i + PART]) for i in range(0, len(text), PART)]
        return np.frombuffer(b"".join([*out, on.finish()]), dtype="<u4")

    def decode(self, ids) -> str:
        """The text of ids, without the blank that encoding puts first. A literal U+2581 comes back as a blank, as from the library."""
        ids = np.asarray(ids, dtype=np.int64)
        has_bytes, out, held, ids = self.is_byte[ids].any(), [], bytearray(), ids.tolist()
        if not has_bytes:
            text = "".join(map(self.pieces.__getitem__, ids)).replace(BLANK, " ")
            return text[1:] if text.startswith(" ") else text
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def codec_of(path: str) -> Codec:
    """One codec a worker process: what it has learnt of words serves its later tasks too."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text. Null text is empty and has no ids; repeated rows each give a row; null ids pass through; extra columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": [codec.encode(t).astype(np.int32) for t in pdf["text"]]})

    return map_frames(text_rows(docs), run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from (doc_id, ids); null ids are no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [codec.decode(x if x is not None else []) for x in pdf["ids"]]})

    return map_frames(coded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, same (the decoded text is the text) of every row; encoded and decoded in one pass.

    Null text is empty: no ids, the digest of the empty string. Texts of any length are streamed; repeated rows each give a
    row; null ids pass through; extra columns are not read; an empty table gives no rows. A literal U+2581 decodes as a
    blank, as in the library, so such a text is not ``same``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = codec.encode(text)
                back = codec.decode(ids)
                out.append((doc_id, len(ids), crc_u32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            yield pd.DataFrame(out, columns=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"]).astype({"doc_id": "Int64"})

    return map_frames(text_rows(docs), run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
