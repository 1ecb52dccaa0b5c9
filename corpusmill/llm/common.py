"""What the operators of this subpackage share: tables, shared scratch folders, partition counts."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusmill.sources.tables import shared_dir, table  # noqa: F401 (operators take table from here)

#: A key is hot if more rows have it than this, and than a 4096th of the table's.
HOT = 200
#: Slim rows a task has at least, where a table is small, and the tasks that it is dealt to even so.
SLIM, LEAST_TASKS = 50_000, 8


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(rows: DataFrame, n: int) -> DataFrame:
    """rows, about ``n`` slim ones, in no more partitions than they need; the driver keeps a record of each task, and rounds on a few rows have many."""
    return rows.coalesce(max(LEAST_TASKS, -(-n // SLIM)))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; columns with other names never reach the operators."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def map_frames(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInPandas`` that keeps ids exact: pandas makes floating numbers of a column of longs that has nulls, here ids stay integers (``Int64``)."""
    kinds = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        got = batch.to_pandas()
        for name in {"doc_id", "page_id"} & set(batch.schema.names):
            got[name] = batch.column(name).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return got

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(map(frame, batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out[kinds.names], schema=kinds, preserve_index=False)

    return rows.mapInArrow(over, schema)


def held_out(id_col):
    """True where crc32 of the id as text leaves no remainder by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_u32(ids) -> int:
    """Unsigned CRC-32 of a numpy array of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most about ``most`` labelled rows outside the held-out fold.

    Rows are picked by a hash of doc_id, so the sample is the same whatever the partitioning; null labels
    are not labels, and a document that is labelled twice counts once with its largest label. The picked ids
    are at most about ``most`` rows of 12 bytes, which bounds the broadcast.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return text_rows(docs).join(F.broadcast(rows), "doc_id")


def hot_keys(rows: DataFrame, key: str, total: int, least: int = HOT) -> DataFrame | None:
    """(key, times): keys that more of the ``total`` rows have than ``least`` and than a 4096th of them, so 4096 keys at most; None if there are none."""
    if total <= least:
        return None
    found = kept(packed(rows.groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > max(least, total // 4096)), total), "hot")
    return None if found.isEmpty() else found


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with keyed (each key once). Rows of a hot key stay where they are: what keyed has for the few ``hot`` keys is broadcast, the rest is shuffled."""
    if hot is None:
        return rows.join(keyed, key)
    few = keyed.join(F.broadcast(hot.select(key)), key, "left_semi")
    many = keyed.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(many, key))


def with_times(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows with how often a hot key occurs (``times``), null for other keys."""
    return rows.withColumn("times", F.lit(None).cast("long")) if hot is None else rows.join(F.broadcast(hot), key, "left")


def hot_blocks(rows: DataFrame, key: str, share: int = 1, block: int = HOT) -> DataFrame | None:
    """(key, blocks) of the hot keys, 4096 at most, seen in rows, which are one in ``share`` of all: a block has about ``block`` of a key's rows. None if there are none."""
    seen = kept(rows.groupBy(key).agg((F.count("*") * share).alias("times")), "times")
    total = seen.agg(F.sum("times")).first()[0] or 0
    hot = seen.where(F.col("times") > max(block, total // 4096)).select(key, F.ceil(F.col("times") / block).cast("int").alias("blocks"))
    return None if hot.isEmpty() else hot


def block_pairs(rows: DataFrame, key: str, order: str, hot: DataFrame | None) -> DataFrame:
    """Pairs of rows on one key as ``a`` and ``b``, each once; of two in one block, a is that with the lesser ``order``, which tells all rows of a key apart.

    Rows of the ``hot`` keys (see ``hot_blocks``) are dealt to blocks by a hash of ``order``, and each pair of blocks meets on its own, so
    no task gets all rows of a key against all others. Blocks only deal rows out: whatever keys are named as hot, the pairs are the same.
    """
    if hot is None:
        a, b = rows.alias("a"), rows.alias("b")
        return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(F.col(f"a.{order}") < F.col(f"b.{order}"))
    dealt = rows.join(F.broadcast(hot.select(F.col(key).alias("__hot"), F.col("blocks").alias("__n"))), rows[key] == F.col("__hot"), "left")
    n = F.coalesce("__n", F.lit(1))
    dealt = dealt.select(*rows.columns, n.alias("__n"), F.pmod(F.xxhash64(order, F.lit("block")), n).cast("int").alias("__own"))
    a = dealt.select(*rows.columns, F.col("__own").alias("__x"), F.explode(F.sequence(F.col("__own"), F.col("__n") - 1)).alias("__y")).alias("a")
    b = dealt.select(*rows.columns, F.col("__own").alias("__y"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__x")).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "__x", "__y")]
    return a.join(b, on).where((F.col("a.__x") != F.col("a.__y")) | (F.col(f"a.{order}") < F.col(f"b.{order}")))
