"""Token ids as binary shards: a concatenated id array with Elias-Fano coded document boundaries.

Shard layout (little endian): magic ``CMT2``, the ids, then n doc ids (i64, with a null flag byte each), the lower l bits of
the n + 1 boundaries, their upper bits in unary (boundary i sets bit (b_i >> l) + i), a directory with the position of
every 512th set bit, and a trailer (u32 id width in bytes, u64 documents n, u64 ids m, u32 low bits l, u64 bytes of the upper
part, magic). ``select`` needs the directory, a few words of the upper part and l bits, so boundaries take about
2 + log2(m / n) bits each, not 64. A reader asks for the boundaries it needs, one or a block of 512, and for those ids only.

A task writes its documents in order, ids as they come, and begins a new shard when one has ``SHARD_IDS`` ids or
``SHARD_DOCS`` documents; it holds a batch of documents and a shard's boundaries. Each shard is written under a name of
its own and renamed when whole, so a repeated task only repeats files; the shards that count are those in the rows
the finished tasks returned.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_u32, kept, map_frames, partitions, scratch, text_rows

TAIL, MAGIC = struct.Struct("<IQQIQ4s"), b"CMT2"
EVERY = 512
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20


class EliasFano:
    """A non-decreasing list of n numbers up to u: ``at(i)`` is the i-th."""

    def __init__(self, low: np.ndarray, l: int, upper: np.ndarray, n: int, marks: np.ndarray):
        self.low, self.l, self.upper, self.n, self.marks = low, l, upper, n, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, u = len(v), int(v[-1]) + 1
        l = max(0, (u // n).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if l else np.zeros((n, 0), np.uint8)
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1, np.uint8)
        ones[at] = 1
        return cls(np.packbits(bits.ravel(), bitorder="little"), l, np.packbits(ones, bitorder="little"), n, at[::EVERY].astype("<u8"))

    def at(self, i: int) -> int:
        """select: the i-th set bit of the upper part, found from the last mark at or before it."""
        pos, seen = int(self.marks[i // EVERY]), i // EVERY * EVERY
        byte = pos // 8
        word = int(self.upper[byte]) >> (pos % 8) << (pos % 8)
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = int(self.upper[byte])
        for _ in range(i - seen):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.l
        chunk = int.from_bytes(self.low[first // 8 : (first + self.l + 7) // 8].tobytes(), "little") >> (first % 8)
        return high << self.l | chunk & ((1 << self.l) - 1)

    def block(self, k: int) -> np.ndarray:
        """select of numbers k * EVERY to (k + 1) * EVERY (that one included, if there is one), between two marks of the directory."""
        first, last = k * EVERY, min(self.n, (k + 1) * EVERY + 1)
        begin = int(self.marks[k])
        end = int(self.marks[k + 1]) + 1 if k + 1 < len(self.marks) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        high = (np.flatnonzero(bits)[: last - first] + begin - np.arange(first, last)).astype(np.int64) << self.l
        if not self.l:
            return high
        at = first * self.l
        low = np.unpackbits(self.low[at // 8 : -(-last * self.l // 8)], bitorder="little")[at % 8 :][: (last - first) * self.l]
        return high | low.reshape(-1, self.l).astype(np.int64) @ (1 << np.arange(self.l, dtype=np.int64))

    def all(self) -> np.ndarray:
        """Every number, block by block."""
        return np.concatenate([self.block(k)[:EVERY] for k in range(len(self.marks))])


class Writer:
    """Writes a shard to a binary stream: ``add(doc_id, id bytes)``, then ``close()``."""

    def __init__(self, out, width: int):
        self.out, self.width, self.doc_ids, self.bounds = out, width, [], [0]
        out.write(MAGIC)

    def add(self, doc_id, raw: bytes) -> None:
        self.out.write(raw)
        self.doc_ids.append(doc_id)
        self.bounds.append(self.bounds[-1] + len(raw) // self.width)

    def full(self, ids: int, docs: int) -> bool:
        return self.bounds[-1] >= ids or len(self.doc_ids) >= docs

    def close(self) -> None:
        ef = EliasFano.of(np.array(self.bounds, dtype=np.uint64))
        null = np.array([x is None or x is pd.NA or x != x for x in self.doc_ids], dtype=np.uint8)
        numbers = np.array([0 if gone else int(x) for x, gone in zip(self.doc_ids, null)], dtype="<i8")
        for part in (numbers, null, ef.low, ef.upper, ef.marks):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(self.width, len(numbers), self.bounds[-1], ef.l, len(ef.upper), MAGIC))


class Shard:
    """Reads a shard from a seekable file: ``doc_ids``, ``bounds`` (Elias-Fano), ``ids(i)`` of one document, ``documents()`` in order."""

    def __init__(self, file):
        size = file.size()
        if size < TAIL.size + len(MAGIC):
            raise ValueError("not a token shard")
        self.width, n, self.m, l, upper, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.file, at = file, len(MAGIC) + self.m * self.width
        raw = file.read_at(size - TAIL.size - at, at)  # all but the ids
        at = 0

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        numbers, null = part("<i8", n), part("u1", n)
        self.doc_ids = [None if gone else x for x, gone in zip(numbers.tolist(), null)]
        self.bounds = EliasFano(part("u1", ((n + 1) * l + 7) // 8), l, part("u1", upper), n + 1, part("<u8", -(-(n + 1) // EVERY)))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def between(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.between(self.bounds.at(i), self.bounds.at(i + 1))

    def documents(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(boundaries, ids of each document) of EVERY documents at a time; a block's ids are read together up to 2**22, and document by document beyond."""
        for k in range(-(-len(self) // EVERY)):
            b = self.bounds.block(k)
            if b[-1] - b[0] <= 1 << 22:
                flat = self.between(int(b[0]), int(b[-1]))
                yield b, (flat[x:y] for x, y in zip((b[:-1] - b[0]).tolist(), (b[1:] - b[0]).tolist()))
            else:
                yield b, (self.between(x, y) for x, y in zip(b[:-1].tolist(), b[1:].tolist()))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """About ``parts`` ids that cut the table evenly; only balance depends on them. ids alone are read."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    return sorted(set(cuts or []))


def write_tokens(docs: DataFrame, make: Callable, path: str, end_id: int = 1, width: int = 2, parts: int | None = None, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes all documents in ascending doc_id order to shards in ``path``; gives the manifest (shard, piece, file, n_docs, n_ids, base).

    Null text is empty, so its document is the end id alone. Null doc_ids come first; rows that share a doc_id all
    stay, ordered by their ids. ``width`` must hold the largest id, else an error is raised. Extra columns are not read. An
    empty table gives an empty manifest. The manifest has a row a shard, and a shard has ``shard_ids`` ids unless it is a
    range's last, so its size in the driver is ids / shard_ids + parts rows; it is the only thing that reaches the driver.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    parts = parts or partitions(spark)
    cuts = np.array(range_bounds(rows, parts), dtype=np.int64)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = make()
        for pdf in batches:
            packed = []
            for text in pdf["text"]:
                ids = np.append(coder.ids(text), np.uint32(end_id))
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                packed.append(ids.astype(f"<u{width}").tobytes())
            numbers = pdf["doc_id"].astype("Int64")
            shard = np.searchsorted(cuts, numbers.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="left")
            yield pd.DataFrame({"doc_id": numbers, "shard": shard.astype(np.int32), "ids": packed})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        shard, name, out, done = None, None, None, []

        def finish() -> None:
            out.close()
            out.out.close()
            store.move(f"{at}/.{name}", f"{at}/{name}")
            done.append((shard, len(done), f"{path}/{name}", len(out.doc_ids), out.bounds[-1]))

        for pdf in batches:
            for doc_id, part, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["shard"], pdf["ids"]):
                if out is not None and out.full(shard_ids, shard_docs):
                    finish()
                    out = None
                if out is None:
                    shard = int(part)
                    name = f"tokens-{shard:06d}-{len(done):06d}-{uuid.uuid4().hex}.bin"
                    out = Writer(store.open_output_stream(f"{at}/.{name}"), width)
                out.add(doc_id, raw)
        if out is not None:
            finish()
            yield pd.DataFrame(done, columns=["shard", "piece", "file", "n_docs", "n_ids"])

    coded = map_frames(rows, encode, "doc_id long, shard int, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    shards = sorted(kept(map_frames(dealt, write, "shard int, piece int, file string, n_docs long, n_ids long"), "manifest").collect())
    bases = [0, *accumulate(x["n_ids"] for x in shards)]
    return spark.createDataFrame([(*x, b) for x, b in zip(shards, bases)], "shard int, piece int, file string, n_docs long, n_ids long, base long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the manifest; boundaries come from ``select``, a block at a time.

    Null and repeated ids come back as they were written; other columns of the manifest are not read; an empty manifest gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, base in zip(pdf["file"], pdf["base"]):
                store, at = _store(file)
                with store.open_input_file(at) as f:
                    shard, seen = Shard(f), 0
                    for ends, ids in shard.documents():
                        n = len(ends) - 1
                        yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids[seen : seen + n], dtype="Int64"), "start": int(base) + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": [crc_u32(x) for x in ids]})
                        seen += n

    n = max(1, manifest.count())
    dealt = manifest.select("file", "base").repartition(n, "file")
    return dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
