"""Grouping of spelling variants: words one edit apart, found by a rare-first filter over positional bigrams.

1. Words and their numbers are counted document by document in the tasks and summed by a shuffle.
2. Bigrams are ordered by the number of words' places that have them, the rarest first, ties by code points, and in a word by
   place. The order can't depend on places themselves, as an edit shifts them. There are at most 90 * 90 bigrams of these letters, so
   their counts are the same small table for any corpus.
3. One edit spoils at most two of a word's bigrams, and those it spares keep their order. So the first bigram spared by an edit is
   among the three rarest of both words. Words meet on these alone, within position limits: the
   edit lies after the bigram, which then has the same place and the same letters before it, or it lies before the bigram, which then is as
   far from the end, with the same letters after it. What remains on the edited side is cut in two halves, of
   which one is spared. All this makes one key, so that words meet that have a rare bigram and half of the rest in common, not all
   that have the bigram.
4. Words that meet on a key are verified: their distance must be one. A hot key's words are dealt to blocks and meet block by block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import block_pairs, hot_blocks, kept, text_rows

LEAST_CHARS, LEAST_TIMES, RARE, TIMES_LARGER, EVERY = 7, 2, 3, 10, 31
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Entries of a task's counter after which it gives its counts and begins anew.
MOST_COUNTED = 200_000
#: About how many words' keys are looked at to see which are hot. They only say how rows are dealt out, so any answer is right.
SAMPLED = 200_000


def words_in(name: str, text: str, runs) -> Iterator[tuple[str, int]]:
    """(word, times) of one text: ``runs`` finds the runs of letters; A-Z are lower-cased; a run whose checksum after the document's name is a multiple of EVERY loses one letter."""
    start = zlib.crc32(f"{name}:".encode())
    for run, n in Counter(runs(text)).items():
        word = run.lower() if run.isascii() else run.translate(UPPER)
        h = zlib.crc32(word.encode(), start)
        if h % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): the words of at least ``least_chars`` letters and ``least_times`` occurrences in whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, seen = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}").findall, Counter()  # a shorter run can't give a word

        def told() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
            seen.clear()
            return out

        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                for word, n in words_in(name, text, runs):
                    if len(word) >= least_chars:
                        seen[word] += n
                if len(seen) > MOST_COUNTED:
                    yield told()
        if seen:
            yield told()

    named = text_rows(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = named.mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How many places of words have each bigram; at most as many as there are pairs of letters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for pdf in batches:
            for word in pdf["word"]:
                seen.update(map(str.__add__, word, word[1:]))
        yield pd.DataFrame(list(seen.items()), columns=["bigram", "n"])

    return {r.bigram: r.n for r in words.select("word").mapInPandas(run, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect()}


def rarest(word: str, counts: dict[str, int], most: int = RARE) -> list[int]:
    """Places of the word's rarest bigrams; of one bigram the first places come first."""
    grams = list(map(str.__add__, word, word[1:]))
    return sorted(range(len(grams)), key=lambda i: (counts[grams[i]], grams[i], i))[:most]


def keys_of(word: str, counts: dict[str, int]) -> set[str]:
    """What a word one edit apart has in common with this one: see the module's third point. ``n`` is the size of the shorter word's edited side, which is this one's or one less."""
    out = set()
    for at in rarest(word, counts):
        head, tail = word[:at], word[at + 2 :]
        for n in (len(tail), len(tail) - 1):
            if n >= 0:
                half = n // 2
                same = f"{at}>{n}:{word[: at + 2]}"
                out.add(f"{same}<{tail[:half]}")
                out.add(f"{same}>{tail[len(tail) - (n - half) :]}")
        for n in (len(head), len(head) - 1):
            if n >= 0:
                half = n // 2
                same = f"{len(tail)}<{n}:{word[at:]}"
                out.add(f"{same}<{head[:half]}")
                out.add(f"{same}>{head[len(head) - (n - half) :]}")
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways: pairs of words (word, n; each word once) that differ by exactly one inserted, deleted or replaced code point."""
    counts = bigram_counts(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                out = [(xxh64_intdigest(k) - 2**63, word, n) for word, n in zip(pdf["word"][at : at + 2000], pdf["n"][at : at + 2000]) for k in keys_of(word, counts)]
                yield pd.DataFrame(out, columns=["key", "word", "n"])

    keyed = lambda rows: rows.mapInPandas(run, "key long, word string, n long")
    share = 1 + words.count() // SAMPLED
    hot = hot_blocks(keyed(words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0)), "key", share)
    met = block_pairs(keyed(words), "key", "word", hot)
    a, b = F.col("a.word"), F.col("b.word")
    pairs = met.where(F.levenshtein(a, b, 1) == 1).select(a.alias("u"), F.col("a.n").alias("u_n"), b.alias("v"), F.col("b.n").alias("v_n")).distinct()
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("uv", "vu")]))
    return pairs.select(ways.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that a word leads to. Steps double each round; a form has at least TIMES_LARGER times the word's number, so there are few."""
    at = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        moved = at.join(on, at["root"] == on["__word"], "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved"))
        moved = kept(moved, "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, times_larger: int = TIMES_LARGER) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    n is the word's occurrences, n_near the number of words one edit apart, form the one of these with the largest n (ties: the
    first in code-point order) if that is at least ``times_larger`` times the word's, root the last form that forms lead to. Null
    text has no words; a null doc_id counts as an empty one in the checksum; repeated rows count each; extra columns
    are not read; an empty table gives no rows. Words of any length are compared whole.
    """
    if least_chars <= RARE:
        raise ValueError("a word needs more letters than rare bigrams")
    words = kept(count_words(docs, id_col, text_col, least_chars, least_times), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    told = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    good = form_n >= times_larger * F.col("n")
    told = told.select("word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, form_n).alias("form_n"))
    told = kept(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
