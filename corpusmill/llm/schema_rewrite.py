"""Rewrite of files whose schema drifted, as a Python data source: columns are matched by Parquet field ids.

``DriftedFiles`` reads a folder with one input partition per file. A partition's Arrow reader looks at its own file's footer,
finds each wanted column by its field id, whatever it is called there and wherever it stands, widens its type, and puts the
layout's value where a file has no such column. The same source writes: the task that reads a file streams it into one staged file
of the wanted schema, with no shuffle between, so rows keep their order. A file that has the wanted schema already is only read.
A task's commit message carries the lineage of its file (from, to, columns), its counts and checksums.

The driver, which gets one message a file, first writes the plan of all moves, then puts the staged files in place and takes the
drifted ones away, and at last writes the lineage. A plan that is found is finished first (``finish``), so a lost driver
leaves a folder that the next run puts in order. Staged files of lost attempts are in no plan and go with the staging folder.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusmill.llm.common import kept, scratch

FIELD_ID = b"PARQUET:field_id"
FILES, VERSIONS, GROUP_ROWS, BATCH_ROWS = 250, 24, 1 << 16, 1 << 13
SPARK_KINDS = {"int64": "long", "int32": "int", "double": "double", "float": "float", "string": "string", "timestamp[us]": "timestamp_ntz"}
LINEAGE = "start string, path string, rewritten boolean, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string"


class Field(NamedTuple):
    """A wanted column: its field id, name, Arrow type by name, and the value where a file lacks the column."""

    id: int
    name: str
    kind: str
    missing: object = None


#: The evolved schema of ``clients``; the first column is the key.
CLIENTS = [
    Field(1, "client_id", "int64"), Field(2, "master_id", "int64"), Field(3, "source", "string"), Field(4, "updated_at", "timestamp[us]"), Field(5, "name", "string"),
    Field(6, "email", "string"), Field(7, "city", "string"), Field(8, "nation_id", "int64", -1), Field(9, "segment", "string", "none"), Field(10, "balance", "double"),
]


def arrow_kind(name: str) -> pa.DataType:
    return pa.timestamp("us") if name == "timestamp[us]" else pa.type_for_alias(name)


def arrow_schema(fields: list[Field]) -> pa.Schema:
    """Nullable, with field ids."""
    return pa.schema([pa.field(f.name, arrow_kind(f.kind), True, {FIELD_ID: str(f.id).encode()}) for f in fields])


def same_layout(found: pa.Schema, fields: list[Field]) -> bool:
    """Whether a file's columns have the wanted ids, names, order and types, and may be null."""
    told = [(f.metadata or {}).get(FIELD_ID) for f in found], found.names, found.types, [f.nullable for f in found]
    wanted = arrow_schema(fields)
    return told == ([str(f.id).encode() for f in fields], wanted.names, wanted.types, [True] * len(fields))


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def evolved(batch: pa.RecordBatch, fields: list[Field]) -> pa.RecordBatch:
    """The batch with the wanted columns, found by their ids; casts that would lose something fail."""
    by_id = {int(f.metadata[FIELD_ID]): k for k, f in enumerate(batch.schema) if f.metadata and FIELD_ID in f.metadata}
    arrays = []
    for f in fields:
        kind = arrow_kind(f.kind)
        if f.id in by_id:
            arrays.append(batch.column(by_id[f.id]).cast(kind))
        elif f.missing is None:
            arrays.append(pa.nulls(batch.num_rows, kind))
        else:
            arrays.append(pa.repeat(pa.scalar(f.missing, kind), batch.num_rows))
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])


def shown(column: pa.Array) -> pa.Array:
    """Values as text: integers in decimal, times as microseconds, floating numbers as floor(2**20 * x) or, where there is no such number, by name."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    if pa.types.is_floating(column.type):
        x = pc.multiply(column.cast(pa.float64()), 1048576.0)
        if pc.all(pc.less(pc.abs(x), 2.0**62)).as_py() in (True, None):
            return pc.floor(x).cast(pa.int64()).cast(pa.string())
        return pa.array([None if v is None else str(math.floor(v)) if math.isfinite(v) else str(v) for v in x.to_pylist()], pa.string())
    return column.cast(pa.string())


class Digest:
    """Counts and checksums of a file's rows as they come: the first column's values joined by commas, whole rows by line feeds (fields by ``|``, null ``?``)."""

    def __init__(self):
        self.n_rows, self.n_nulls, self.ids, self.rows = 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        columns = [pc.fill_null(shown(c), "?") for c in batch.columns]
        lines = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, "|")
        for hasher, values, mark in ((self.ids, columns[0], ","), (self.rows, lines, "\n")):
            hasher.update(((mark if self.n_rows else "") + mark.join(values.to_pylist())).encode())
        self.n_rows += batch.num_rows
        self.n_nulls += sum(c.null_count for c in batch.columns)


class FileWriter:
    """One Parquet file, written as batches come, in row groups of about GROUP_ROWS rows."""

    def __init__(self, store, path: str, schema: pa.Schema):
        self.schema, self.held, self.rows = schema, [], 0
        self.stream = store.open_output_stream(path)
        self.out = pq.ParquetWriter(self.stream, schema)

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(pa.RecordBatch.from_arrays([c.cast(f.type, safe=False) for c, f in zip(batch.columns, self.schema)], schema=self.schema))
        self.rows += batch.num_rows
        if self.rows >= GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP_ROWS)
        self.held, self.rows = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.stream.close()


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Entry:
    """The lineage of one file. ``staged`` is None for a file that stays as it is."""

    start: str
    path: str
    staged: str | None
    n_rows: int
    n_nulls: int
    ids_sha256: str
    rows_sha256: str
    start_columns: str
    columns: str


@dataclass
class Lineage(WriterCommitMessage):
    entries: list[Entry]


class Folder:
    """A table's folder: ``files``, ``staging`` and ``lineage`` below it."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.store, self.at = store_of(self.root)

    def files(self) -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(f"{self.at}/files", allow_not_found=True))
        return sorted(f"{self.root}/files/{f.base_name}" for f in found if f.is_file and f.base_name.endswith(".parquet"))

    def local(self, path: str) -> str:
        """A path below the root as the store names it."""
        return self.at + path[len(self.root) :]

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        return self.store.get_file_info(self.local(path)).type != fs.FileType.NotFound

    def put(self, name: str, rows: list[dict]) -> None:
        """Writes JSON lines whole or not at all."""
        self.store.create_dir(f"{self.at}/lineage", recursive=True)
        with self.store.open_output_stream(f"{self.at}/lineage/.{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.store.move(f"{self.at}/lineage/.{name}", f"{self.at}/lineage/{name}")

    def clear_staging(self) -> None:
        if self.exists(f"{self.root}/staging"):
            self.store.delete_dir(f"{self.at}/staging")

    def finish(self) -> None:
        """Carries out the plan, if there is one, from wherever it was left: staged files are moved in place, then drifted ones deleted, then the lineage told."""
        plan = f"{self.root}/lineage/plan.json"
        if not self.exists(plan):
            return
        with self.store.open_input_stream(self.local(plan)) as f:
            entries = [json.loads(line) for line in f.read().decode().splitlines()]
        for e in entries:
            if e["staged"]:
                if self.exists(e["staged"]):
                    self.store.move(self.local(e["staged"]), self.local(e["path"]))
                if self.exists(e["start"]):
                    self.store.delete_file(self.local(e["start"]))
        self.put("lineage.json", [{k: v for k, v in e.items() if k != "staged"} | {"rewritten": e["staged"] is not None} for e in entries])
        self.store.delete_file(self.local(plan))
        self.clear_staging()


class DriftedFiles(DataSource):
    """Options: ``path`` (the folder) and ``layout`` (the wanted fields as JSON). Rows have the wanted columns, and ``_file``, which names the file they come from."""

    @classmethod
    def name(cls) -> str:
        return "drifted_files"

    def fields(self) -> list[Field]:
        return [Field(*f) for f in json.loads(self.options["layout"])]

    def schema(self) -> str:
        return ", ".join(f"`{f.name}` {SPARK_KINDS[f.kind]}" for f in self.fields()) + ", _file string"

    def reader(self, schema) -> DataSourceReader:
        return DriftedReader(self.options["path"], self.fields())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return EvolvedWriter(self.options["path"], self.fields())


class DriftedReader(DataSourceReader):
    def __init__(self, path: str, fields: list[Field]):
        self.path, self.wanted = path, fields

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        folder.finish()
        return [OneFile(f) for f in folder.files()]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        store, at = store_of(partition.path)
        with store.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH_ROWS):
                out = evolved(batch, self.wanted)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.repeat(partition.path, out.num_rows)], names=[*out.schema.names, "_file"])


class EvolvedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fields: list[Field]):
        self.path, self.wanted = path, fields

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Lineage:
        folder, entries, file, one = Folder(self.path), [], None, None
        for batch in iterator:
            names, rows = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            at = 0
            for part in pc.run_end_encode(names).values.to_pylist() if batch.num_rows else []:
                n = next((k for k in range(at, batch.num_rows) if names[k].as_py() != part), batch.num_rows) - at
                if part != file:
                    if one:
                        entries.append(one.close())
                    file, one = part, FileRewrite(folder, part, self.wanted)
                one.add(rows.slice(at, n))
                at += n
        if one:
            entries.append(one.close())
        return Lineage(entries)

    def commit(self, messages: list[Lineage | None]) -> None:
        folder = Folder(self.path)
        folder.put("plan.json", [asdict(e) for m in messages if m for e in sorted(m.entries, key=lambda e: e.path)])
        folder.finish()

    def abort(self, messages: list[Lineage | None]) -> None:
        Folder(self.path).clear_staging()


class FileRewrite:
    """One file on its way: its rows are digested and, if its schema drifted, written to a staged file."""

    def __init__(self, folder: Folder, start: str, fields: list[Field]):
        self.start, self.wanted, self.digest, self.out, self.staged = start, fields, Digest(), None, None
        with folder.store.open_input_file(folder.local(start)) as f:
            told = pq.ParquetFile(f)
            self.found, self.expected = told.schema_arrow, told.metadata.num_rows
        if not same_layout(self.found, fields):
            folder.store.create_dir(f"{folder.at}/staging", recursive=True)
            self.staged = f"{folder.root}/staging/{uuid.uuid4().hex}.parquet"
            self.out = FileWriter(folder.store, folder.local(self.staged), arrow_schema(fields))

    def add(self, rows: pa.RecordBatch) -> None:
        self.digest.add(rows)
        if self.out:
            self.out.add(rows)

    def close(self) -> Entry:
        if self.digest.n_rows != self.expected:
            raise ValueError(f"{self.start}: {self.digest.n_rows} of {self.expected} rows came to this task")
        if self.out:
            self.out.close()
        path = self.start.removesuffix(".parquet") + "-evolved.parquet" if self.out else self.start
        d = self.digest
        return Entry(self.start, path, self.staged, d.n_rows, d.n_nulls, d.ids.hexdigest(), d.rows.hexdigest(), ",".join(self.found.names), ",".join(f.name for f in self.wanted))


def rewrite(spark: SparkSession, root: str, fields: list[Field]) -> DataFrame:
    """The lineage (LINEAGE, a row a file) of the rewrite of ``root``/files to the wanted fields; the files themselves are in place.

    Columns are matched by field id alone. A column that a file lacks gets the field's ``missing`` value (null if it has none); nulls stay
    null; columns with other ids are left out; narrower types are widened, and a value that does not fit fails the task. A
    file of the wanted schema is not touched. Files without rows are left as they are and not told; an empty folder gives no rows.
    """
    spark.dataSource.register(DriftedFiles)
    told = {"path": root, "layout": json.dumps(fields)}
    spark.read.format("drifted_files").options(**told).load().write.format("drifted_files").options(**told).mode("append").save()
    return spark.read.schema(LINEAGE).json(f"{root}/lineage/lineage.json")


def version_of(file_no: int) -> int:
    """How a starting file drifts, as bits; 0: not at all."""
    import zlib

    version = zlib.crc32(f"19:{file_no}".encode()) % VERSIONS
    return version if version < 16 else 0


def drifted_fields(version: int, fields: list[Field]) -> list[Field]:
    """The fields of a starting file: bit 1 swaps the names of name and email, 2 reverses all columns after the first, 4 leaves out nation_id and segment, 8 narrows balance and nation_id."""
    out = [f for f in fields if not (version & 4 and f.name in ("nation_id", "segment"))]
    if version & 8:
        out = [f._replace(kind={"balance": "float", "nation_id": "int32"}.get(f.name, f.kind)) for f in out]
    if version & 2:
        out = [out[0], *out[:0:-1]]
    if version & 1:
        out = [f._replace(name={"name": "email", "email": "name"}.get(f.name, f.name)) for f in out]
    return out


def file_rows(clients: DataFrame, fields: list[Field], files: int) -> DataFrame:
    """The wanted columns of clients, with ``r`` (a row's place by the checksum of its key, then the key, then the other columns) and ``file_no``.

    A range sort into as many parts as there are files, and the number of rows before each part: ``files`` numbers, whatever the input.
    """
    rows = clients.select(*[clients[f.name].cast(SPARK_KINDS[f.kind]).alias(f.name) for f in fields])
    names = [f.name for f in fields]
    order = [F.crc32(F.col(names[0]).cast("string").cast("binary")), *names]
    ranged = kept(rows.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    placed = ranged.join(F.broadcast(before), "part").withColumn("r", F.col("before") + F.col("at"))
    return placed.select(*names, "r", F.floor(F.col("r") / (1 + F.floor(F.col("all") / files))).cast("int").alias("file_no"))


def write_drifted(clients: DataFrame, root: str, fields: list[Field] | None = None, files: int = FILES) -> DataFrame:
    """Writes clients to at most ``files`` drifted files below ``root``/files, each by one task as its rows come; gives (file_no, path).

    A null key comes first; keys that repeat are ordered by the other columns. Extra columns are not written; an empty table gives no files.
    """
    fields = fields or CLIENTS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, out, done = Folder(root), None, []

        def finish() -> None:
            out.close()
            folder.store.move(at, folder.local(done[-1][1]))

        for batch in batches:
            numbers, rows = batch.column(0).to_pylist(), batch.select(range(1, batch.num_columns))
            start = 0
            while start < len(numbers):
                n = next((k for k in range(start, len(numbers)) if numbers[k] != numbers[start]), len(numbers))
                if not done or done[-1][0] != numbers[start]:
                    if out:
                        finish()
                    for part in ("staging", "files"):
                        folder.store.create_dir(f"{folder.at}/{part}", recursive=True)
                    done.append((numbers[start], f"{folder.root}/files/clients-{numbers[start]:05d}.parquet"))
                    at, wanted = f"{folder.at}/staging/{uuid.uuid4().hex}.parquet", drifted_fields(version_of(numbers[start]), fields)
                    out, places = FileWriter(folder.store, at, arrow_schema(wanted)), [f.id for f in wanted]
                out.add(rows.slice(start, n - start).select([ids.index(i) for i in places]))
                start = n
        if out:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done])], names=["file_no", "path"])

    ids = [f.id for f in fields]
    dealt = file_rows(clients, fields, files).repartitionById(files, F.col("file_no")).sortWithinPartitions("file_no", "r")
    return kept(dealt.select("file_no", *[f.name for f in fields]).mapInArrow(write, "file_no int, path string"), "started")


def rewrite_clients(clients: DataFrame, files: int = FILES) -> DataFrame:
    """file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten of every final file of clients, drifted and rewritten in a new shared folder."""
    spark = clients.sparkSession
    root = scratch(spark, "rewrite")
    started = write_drifted(clients, root, files=files)
    told = rewrite(spark, root, CLIENTS).join(F.broadcast(started.select("file_no", F.col("path").alias("start"))), "start")  # a row a file
    version = F.crc32(F.concat(F.lit("19:"), F.col("file_no").cast("string")).cast("binary")) % VERSIONS
    return told.select(F.col("file_no").cast("long").alias("file_no"), F.when(version > 15, 0).otherwise(version).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
