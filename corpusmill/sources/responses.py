"""Saved responses of search services as a Python data source: paged reads, pruned by provider and page, and a stream that goes on by page.

A response folder has a folder ``provider=…/block=…`` for every ``block_pages`` pages of a provider. Each is one input partition, read by one
task in Arrow batches. Filters on provider and page choose the blocks by their names alone, and a filter on the query goes to the Parquet
reader. As a stream, an offset is the next block of each provider, so a query goes on from its checkpoint with what came since.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, query string, page long, status int, body string, lang string"
BLOCK_PAGES, BATCH_ROWS, MOST_BLOCKS = 64, 1 << 12, 64
BLOCK = re.compile(r"block=(\d+)$")


def write_responses(responses: DataFrame, root: str, block_pages: int = BLOCK_PAGES) -> None:
    """Appends responses (provider, query, page, status, body, lang) to a folder. A stream sees a block when it first lists it, so later pages belong in later blocks. Rows without provider or page are left out."""
    rows = responses.where("provider is not null and page is not null").withColumn("block", F.floor(F.col("page") / block_pages))
    rows.repartition("provider", "block").sortWithinPartitions("provider", "block", "query").write.mode("append").partitionBy("provider", "block").parquet(root)


def block_size(responses: DataFrame, least: int = BLOCK_PAGES) -> int:
    """Pages a block for these responses: ``least``, or more where a provider would have over MOST_BLOCKS blocks, so that folders, files and tasks don't grow with the table."""
    last = responses.agg(F.max("page")).first()[0]
    return max(least, -(-((last or 0) + 1) // MOST_BLOCKS))


@dataclass
class Block(InputPartition):
    """A block by its name below the folder; names are no part of an address, as they are escaped already."""

    root: str
    name: str
    provider: str
    queries: tuple[str, ...] | None
    pages: tuple[int | None, int | None]


class ResponseFolder:
    """What a folder has, by its names alone."""

    def __init__(self, options: dict):
        self.root, self.block_pages = options["path"].rstrip("/"), int(options.get("block_pages", BLOCK_PAGES))

    def blocks(self) -> list[tuple[str, int, str]]:
        """(provider, block, name below the folder) in order."""
        from urllib.parse import unquote

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return []
        out = []
        for p in store.get_file_info(fs.FileSelector(at)):
            if p.base_name.startswith("provider="):
                for b in store.get_file_info(fs.FileSelector(p.path)):
                    if m := BLOCK.match(b.base_name):
                        out.append((unquote(p.base_name[9:]), int(m[1]), f"{p.base_name}/{b.base_name}"))
        return sorted(out)


def read_block(part: Block) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(part.root)
    wanted, field = None, ds.field
    if part.queries is not None:
        wanted = field("query").isin(list(part.queries))
    for k, bound in enumerate(part.pages):
        if bound is not None:
            one = field("page") >= bound if k == 0 else field("page") <= bound
            wanted = one if wanted is None else wanted & one
    for batch in ds.dataset(f"{at}/{part.name}", filesystem=store, format="parquet").to_batches(columns=["query", "page", "status", "body", "lang"], filter=wanted, batch_size=BATCH_ROWS):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.repeat(part.provider, batch.num_rows), *batch.columns], names=["provider", *batch.schema.names])


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.providers, self.queries, self.pages = ResponseFolder(options), None, None, [None, None]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN of provider and query, and bounds of page; gives back the others, which Spark applies."""
        for f in filters:
            column, low, high = getattr(f, "attribute", None), self.pages[0], self.pages[1]
            value = getattr(f, "value", None)
            if column in (("provider",), ("query",)) and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(value)
                name = "providers" if column == ("provider",) else "queries"
                setattr(self, name, own if getattr(self, name) is None else getattr(self, name) & own)
            elif column == ("page",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                bound = value + isinstance(f, GreaterThan)
                self.pages[0] = bound if low is None else max(low, bound)
            elif column == ("page",) and isinstance(f, (LessThan, LessThanOrEqual)):
                bound = value - isinstance(f, LessThan)
                self.pages[1] = bound if high is None else min(high, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        low, high = self.pages
        size = self.folder.block_pages
        wanted = [(p, name) for p, b, name in self.folder.blocks() if (self.providers is None or p in self.providers) and (low is None or (b + 1) * size > low) and (high is None or b * size <= high)]
        queries = None if self.queries is None else tuple(sorted(q for q in self.queries if q is not None))
        return [Block(self.folder.root, name, p, queries, (low, high)) for p, name in wanted]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        return read_block(partition) if partition else iter([])


class ResponseStream(DataSourceStreamReader):
    """Offsets are {provider: next block}."""

    def __init__(self, options: dict):
        self.folder = ResponseFolder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict = {}
        for provider, block, _ in self.folder.blocks():
            out[provider] = max(out.get(provider, 0), block + 1)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Block(self.folder.root, name, p, None, (None, None)) for p, b, name in self.folder.blocks() if start.get(p, 0) <= b < end.get(p, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return read_block(partition)


class Responses(DataSource):
    """Options: ``path``, and ``block_pages`` if it was written with another one."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ResponseReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ResponseStream(dict(self.options))


def read_responses(spark: SparkSession, root: str, stream: bool = False, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """The responses of a folder, as a table or a stream. A folder that isn't there has none; repeated rows stay; null queries match no filter."""
    spark.dataSource.register(Responses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.readStream if stream else spark.read).format("responses").option("path", root).option("block_pages", str(block_pages)).load()
