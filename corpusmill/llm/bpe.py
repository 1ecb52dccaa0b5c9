"""Exact, fast paths to the ids of public BPE vocabularies.

The tokenizers library defines the ids. It spends most of its time on bookkeeping, so plain Latin text takes a
quicker way to the same ids: tiktoken's merge loop over tables read from the very same JSON file. Any text or
word with another character, and any with a special token's opening, goes to the tokenizers library. Tests
hold both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PLAIN = re.compile(r"[\n\t\x20-\x7EÀ-ÖØ-öø-ſ]*").fullmatch


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """ids(text): byte-level BPE whose merge order is the order of its ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {x["content"] for x in told["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in s): i for s, i in told["model"]["vocab"].items() if s not in special}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("quick", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if PLAIN(text) and "<|" not in text:
            return np.array(self.quick.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class WordBpe:
    """ids(text): lower-cased BPE with word ends; words between blanks are remembered, up to ``most`` of them."""

    END = b"\xff"

    def __init__(self, path: str, most: int = 800_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, byte, suffix = told["model"]["vocab"], _byte_of(), told["model"]["end_of_word_suffix"]

        def raw(s: str) -> bytes:
            end = s.endswith(suffix)
            return bytes(byte[c] for c in (s[: -len(suffix)] if end else s)) + self.END * end

        order: dict[bytes, int] = {bytes([b]): b for b in range(256)} | {bytes([b]) + self.END: 256 + b for b in range(255)}
        to_id = {n: vocab[s] for c, b in byte.items() for s, n in ((c, b), (c + suffix, 256 + b)) if s in vocab}
        for n, merge in enumerate(told["model"]["merges"], 512):
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            order[raw(token)] = n
            to_id[n] = vocab[token]
        self.to_id = {rank: i.to_bytes(4, "little") for rank, i in to_id.items()}
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=order, special_tokens={})._core_bpe
        self.merge, self.words = core.encode_single_piece, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def _encode(self, word: str) -> bytes:
        if not PLAIN(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out, parts = b"", self.parts
        for x in self.words(word.lower()):
            ids = parts.get(x)
            if ids is None:
                to_id = self.to_id
                ids = parts[x] = b"".join([to_id[r] for r in self.merge(x.encode() + self.END)])
            out += ids
        return out

    def ids(self, text: str) -> np.ndarray:
        known, words = self.known, text.split(" ")
        if len(known) > self.most:
            known.clear()
            self.parts.clear()
        for x in words:
            if x not in known:
                known[x] = self._encode(x)
        return np.frombuffer(b"".join([known[x] for x in words]), dtype="<u4")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One a worker process: words that a task has met are known to its later tasks."""
    return WordBpe(path)
