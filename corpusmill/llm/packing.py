"""Best-fit packing: online best-fit over a fixed number of open bins, held in a bitset keyed by free space.

Documents are tokenised and cut where they stand; only (doc_id, piece, start, length, crc) moves. Each task packs
the pieces that a hash of their keys deals to it, in the order of that hash, so a lost task packs the same again.
Blocks of ``look`` pieces are placed longest first each: lengths stay mixed over the task, however many pieces it has,
so no bin closes before short pieces come. The bitset has a bit for every amount of free space that some open bin has;
the best bin is the lowest bit at or above the piece's length. When a new bin is needed and all are open, the fullest
closes. State is ``open_bins`` small entries and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.common import crc_u32, map_frames, text_rows


class BestFit:
    """place(length) -> (bin number, offset). Pieces are 1 to ``capacity`` long."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.n_open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones after a first that takes what is over."""
    first = (n - 1) % most + 1
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def cut(docs: DataFrame, make: Callable, most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece. make() gives an object with ids(text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = make()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(coder.ids(text), np.uint32(end_id))
                for k, (at, n) in enumerate(pieces_of(len(ids), most)):
                    out.append((doc_id, k, at, n, crc_u32(ids[at : at + n]), *([ids[at : at + n].astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return map_frames(text_rows(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, look: int = 4096) -> DataFrame:
    """pieces (any columns, with doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Lengths must be 1 to ``capacity``. Repeated rows are separate pieces. Sequence numbers are unique, not dense.
    Other columns come through, but for those named ``sequence_id``, ``offset`` and ``__dealt``, which this replaces. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset", "__dealt")
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for block in blocks(batches, look):
            lengths = block["length"].to_numpy(np.int64)
            places = np.empty((len(lengths), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                places[i] = bins.place(int(lengths[i]))
            yield block.drop(columns="__dealt").assign(sequence_id=base + places[:, 0], offset=places[:, 1])

    dealt = pieces.withColumn("__dealt", F.xxhash64("doc_id", "piece", "start", "ids_crc32")).repartition("__dealt")
    return map_frames(dealt.sortWithinPartitions("__dealt", "doc_id", "piece", "start", "ids_crc32"), run, schema)


def blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of all batches in order, ``size`` at a time; the last block may be shorter."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        while n + len(pdf) >= size:
            yield pd.concat([*held, pdf.iloc[: size - n]], ignore_index=True)
            pdf, held, n = pdf.iloc[size - n :], [], 0
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def pack_documents(docs: DataFrame, make: Callable, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096) -> DataFrame:
    """Every document's pieces with their places.

    Null text is empty and packs as its end id alone; texts longer than a sequence are cut and lose nothing. Null
    and repeated ids are packed like others. Extra columns are not read; an empty table gives no rows.
    """
    return pack(cut(docs, make, capacity, end_id), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces that carry ids; at most ``capacity`` ids meet in a row.

    Pieces without ids (null) add none, repeated rows have places of their own, other columns are not read, and an empty table gives no rows.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
