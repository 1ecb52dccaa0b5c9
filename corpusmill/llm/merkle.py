"""Document fingerprints: a Merkle tree over paragraphs and sections.

A word's checksum says how high a branch it ends: half of the words end a run of words (level 1), a quarter a run of such
runs (level 2), and so on. A line ends a paragraph (level 16) and all runs in it; a paragraph's checksum says in the same
way how high a section it ends (levels 17 to 31). So branches end in the same places before and after an edit elsewhere.
Where eight branches come without one that ends a higher one, as in repetitive text, the eighth does.

A word's digest is its XXH64, told apart by whether a blank or a line feed follows. A branch's digest is made of its children's
digests and lengths, each mixed with its place among them, and of its own level and length (an only child is its branch); mixing is not linear, so swapped, moved or
joined children give another digest. Levels are made one from the other, whole levels at a time. The root is BLAKE2b of the digests of
all words in their order: whatever a fingerprint stores, the root covers every leaf, and so tests equality.

A fingerprint is text: the root, the level of its stored leaves, and at most ``NODES`` leaves, each with its digest, the level
it ends and its words; so its size doesn't grow with the text. Leaves are the lowest level that has so few nodes: words in
a short text, paragraphs or sections in a long one. Higher branches follow from the stored ones. Two trees are compared
from the root: equal roots mean equal texts; branches that agree are passed over whole, and only those that differ are
opened, down to the leaves, which locate the edits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from corpusmill.llm.common import map_frames, partitions, text_rows

NODES, RUNS, TOP, LONGEST = 48, 16, 31, 8
U = np.uint64
#: Odd numbers that tell places, lengths, levels and ends of lines apart before they are mixed.
PLACE, LENGTH, LEVEL, LINE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)
NODE = np.dtype([("digest", ">u8"), ("ends", ">u4")])


class Digests(dict):
    """Word to the 8 bytes of its hash; begins anew when it is full."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxh64_digest(word.encode("utf-8", "surrogatepass"), 10)
        return found


DIGEST = Digests()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place: every bit of x changes about half of the result's."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def branches(children: np.ndarray, words: np.ndarray, last: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests and words of the branches of a level: of children (their digests and ``words``), ``last`` being the number of each branch's last child. An only child is its branch."""
    first = np.zeros(len(last), np.int64)
    first[1:] = last[:-1] + 1
    size = last + 1 - first
    place = np.arange(1, len(children) + 1)
    place -= np.repeat(first, size)
    total = np.add.reduceat(words, first)
    digests = np.add.reduceat(mix(children + place.view(U) * PLACE + words.view(U) * LENGTH), first)
    digests ^= total.view(U) * LENGTH + U(level * int(LEVEL) % 2**64)
    return np.where(size == 1, children[last], mix(digests)), total


def climbed(digests: np.ndarray, ends: np.ndarray, words: np.ndarray, level: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a level (digests, the levels they end, words) as those of level ``upto``, level by level."""
    for k in range(level + 1, upto + 1):
        last = (ends >= k).nonzero()[0]
        if len(last) < len(ends):
            digests, words = branches(digests, words, last, k)
            ends = ends[last]
    return digests, ends, words


def heights(digests: np.ndarray) -> np.ndarray:
    """How high a branch each item ends, 0 to 15: the trailing zeros of its checksum, or one more than its own where ``LONGEST`` branches came without such an end."""
    x = mix(digests ^ PLACE)
    level = np.minimum(np.bitwise_count((x & (~x + U(1))) - U(1)), 15).astype(np.int64)
    at = np.arange(len(level))
    for k in range(1, 16):
        if len(at) <= LONGEST:  # at: the items that end a branch of level k - 1
            break
        own = level[at] >= k
        higher = own.nonzero()[0]
        begin, upto = np.empty(len(higher) + 1, np.int64), np.empty(len(higher) + 1, np.int64)
        begin[0], begin[1:], upto[:-1], upto[-1] = -1, higher, higher, len(at)
        gaps = upto - begin > LONGEST
        if gaps.any():
            for i in gaps.nonzero()[0].tolist():
                level[at[begin[i] + LONGEST : upto[i] : LONGEST]] = k
            own = level[at] >= k
        at = at[own]
    return level


class Tree:
    """``root``, and the leaves: their ``level``, ``digests``, the levels they ``end`` and their ``words``."""

    __slots__ = ("root", "level", "digests", "ends", "words")

    def __init__(self, root: str, level: int, digests: np.ndarray, ends: np.ndarray, words: np.ndarray):
        self.root, self.level, self.digests, self.ends, self.words = root, level, digests, ends, words

    @classmethod
    def of(cls, text: str) -> Tree:
        words, stops = [], []
        for line in text.split("\n"):
            words += line.split(" ")
            stops.append(len(words) - 1)
        hashes, stop, one = np.frombuffer(b"".join(map(DIGEST.__getitem__, words)), ">u8").astype(U), np.array(stops), np.ones(len(words), np.int64)
        ends = heights(hashes)
        ends[stop] = RUNS + heights(branches(hashes, one, stop, RUNS)[0])
        ends[-1] = TOP
        if int((ends == TOP).sum()) > NODES:
            ends[:-1] = np.minimum(ends[:-1], TOP - 1)
        nodes = np.bincount(ends, minlength=TOP + 1)[::-1].cumsum()[::-1]
        level = int(np.argmax(nodes <= NODES))
        hashes[stop] = mix(hashes[stop] ^ LINE)
        root = hashlib.blake2b(hashes.astype(">u8").tobytes(), digest_size=16).hexdigest()
        return cls(root, level, *climbed(hashes, ends, one, 0, level))

    def raised(self, level: int) -> Tree:
        """The same tree with its stored leaves at a higher level."""
        return Tree(self.root, level, *climbed(self.digests, self.ends, self.words, self.level, level))

    def packed(self) -> bytes:
        out = np.empty(len(self.digests), NODE)
        out["digest"], out["ends"] = self.digests, (self.ends << 27) | np.minimum(self.words, (1 << 27) - 1)
        return out.tobytes()

    def __str__(self) -> str:
        return f"{self.root}:{self.level:02x}:{base64.b64encode(self.packed()).decode()}"

    @classmethod
    def parse(cls, told: str) -> Tree:
        root, level, leaves = told.split(":")
        got = np.frombuffer(base64.b64decode(leaves), NODE)
        ends = got["ends"].astype(np.int64)
        return cls(root, int(level, 16), got["digest"].astype(U), ends >> 27, ends & ((1 << 27) - 1))


def fingerprint(text: str) -> str:
    return str(Tree.of(text))


def opened(spans: list[tuple[int, int]], ends: list[int], level: int) -> list[tuple[int, int]]:
    """Spans of leaves, split into the branches of a level."""
    out = []
    for first, last in spans:
        for k in range(first, last + 1):
            if ends[k] >= level or k == last:
                out.append((first, k))
                first = k + 1
    return out


def matched(a: Tree, b: Tree) -> tuple[Tree, Tree, list[bool], list[bool]]:
    """Both trees at a common level, and which of their leaves lie in branches that both have; from the root down, opening only branches that differ."""
    level = max(a.level, b.level)
    a, b = (t if t.level == level else t.raised(level) for t in (a, b))
    x, y = (list(zip(t.digests.tolist(), t.words.tolist())) for t in (a, b))
    x_ends, y_ends = a.ends.tolist(), b.ends.tolist()
    open_x, open_y = [(0, len(x) - 1)], [(0, len(y) - 1)]
    levels = [] if set(x).isdisjoint(y) else sorted({level, *x_ends, *y_ends}, reverse=True)  # without a leaf in common no branch is
    for k in levels:
        places: dict[tuple, list] = {}
        for span in opened(open_y, y_ends, k):
            places.setdefault(tuple(y[span[0] : span[1] + 1]), []).append(span)
        left = []
        for first, last in opened(open_x, x_ends, k):
            same = places.get(tuple(x[first : last + 1]))
            if same:
                same.pop(0)
            else:
                left.append((first, last))
        open_x, open_y = left, sorted(span for spans in places.values() for span in spans)
        if not open_x or not open_y:
            break
    seen = []
    for n, spans in ((len(x), open_x), (len(y), open_y)):
        own = [True] * n
        for first, last in spans:
            own[first : last + 1] = [False] * (last + 1 - first)
        seen.append(own)
    return a, b, *seen


def alike(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """Likeness, and the word ranges (end exclusive) of the first tree's leaves that the second one lacks."""
    if a.root == b.root:
        return 1.0, []
    a, b, seen_a, seen_b = matched(a, b)
    words, ranges, at, shared = a.words.tolist(), [], 0, 0
    for n, seen in zip(words, seen_a):
        if seen:
            shared += n
        elif ranges and ranges[-1][1] == at:
            ranges[-1] = (ranges[-1][0], at + n)
        else:
            ranges.append((at, at + n))
        at += n
    shared += sum(n for n, seen in zip(b.words.tolist(), seen_b) if seen)
    whole = at + int(b.words.sum())
    return min(shared, whole - 1) / whole, ranges


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of both texts' words in branches that both have, wherever they stand; 1 for equal roots, and less for others (where all branches agree, as if one word did not)."""
    return alike(Tree.parse(a), Tree.parse(b))[0]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Where the first text differs from the second: ranges of its words (parts between single blanks and line feeds), end exclusive, to the leaf."""
    return alike(Tree.parse(a), Tree.parse(b))[1]


def with_next(docs: DataFrame, parts: int, consume, schema: str) -> DataFrame:
    """Runs consume(doc_id, text, its tree, next text, its tree) over all rows in descending doc_id order.

    Texts move once, to ranges of doc_id. Range limits are ids of the table, so the first document of every range
    is known beforehand and is dealt to the range before as well (the first of all to the last), where it
    follows the last row: no window over the whole table, and nothing but the limits reaches the driver.
    """
    rows = text_rows(docs)
    got = rows.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [i / parts for i in range(parts - 1, 0, -1)], 10_000).alias("q")).first() if parts > 1 else None
    limits = sorted({*(got["q"] or []), got["top"]} - {None}, reverse=True) if got else []
    if not limits:
        top = rows.agg(F.max("doc_id")).first()[0]
        limits = [top] if top is not None else []
    limit = np.array(limits[::-1], dtype=np.int64)  # ascending
    n = max(1, len(limits))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = set(limit.tolist())
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            known = ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
            # the range with limit L holds the ids <= L and above the next lower limit; ranges count from the largest ids
            part = np.clip(n - 1 - np.searchsorted(limit, known, side="left"), 0, n - 1)
            own = pd.DataFrame({"part": part, "guest": False, "doc_id": ids, "text": pdf["text"]})
            guests = own[[i in first for i in known]].assign(guest=True)
            yield pd.concat([own, guests.assign(part=(guests["part"] - 1) % n)]).astype({"part": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, guest = None, None
        for pdf in batches:
            out = []
            for is_guest, doc_id, text in zip(pdf["guest"], pdf["doc_id"].astype("Int64"), pdf["text"]):
                if is_guest:
                    guest = text if guest is None else guest
                    continue
                mark = Tree.of(text)
                if held is not None:
                    out.append(consume(*held, text, mark))
                held = (doc_id, text, mark)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        if held is not None:
            yield pd.DataFrame([consume(*held, guest or "", Tree.of(guest or ""))], columns=names).astype({"doc_id": "Int64"})

    names = [x.split()[0] for x in schema.split(", ")]
    dealt = map_frames(rows, place, "part int, guest boolean, doc_id long, text string").repartitionById(n, F.col("part"))
    return map_frames(dealt.sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "text"), run, schema)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many first characters of the following document, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row. Null text is empty; repeated rows each give a row; extra columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fingerprint": [fingerprint(t) for t in pdf["text"]]})

    return map_frames(text_rows(docs), run, "doc_id long, fingerprint string")


def compare_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, its likeness to it and to the next document's, and where the edit is (``edits``: word ranges ``from-to``, comma-joined).

    Order is descending doc_id; after the last comes the first, so a lone document follows itself. Rows that repeat
    a doc_id are neighbours, ordered by text; null ids come last (in a table of null ids alone, the empty text follows the last row). Empty texts are equal to each other. Extra columns
    are not read; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"

    def consume(doc_id, text, mark, following, next_mark):
        changed = edited(text, following)
        own = Tree.of(changed)
        near, ranges = alike(mark, own)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(mark), str(own), near, alike(mark, next_mark)[0], ",".join(f"{a}-{b}" for a, b in ranges)

    return with_next(docs, parts or partitions(docs.sparkSession), consume, schema)
