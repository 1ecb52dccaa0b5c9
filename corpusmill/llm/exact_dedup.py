"""Exact dedup with an extendible-hash index on shared files; DataFrame functions only.

1. Every row gives an entry (doc_id, 64-bit hash, SHA-256 and size of the normalised text); entries hold no text.
2. The directory addresses buckets by leading hash bits. It starts with 2**MIN_DEPTH cells and doubles while a bucket
   holds more hashes than ``capacity``, which splits that bucket by its next bit. Capacity grows with the number of
   hashes beyond MOST_BUCKETS buckets, which bounds the directory, and so its broadcast, whatever the input; a bucket that
   hashes with long common beginnings overfill is divided again, level by level, down to the last bit.
3. Owners are contiguous ranges of buckets with about equal bytes. Texts move once, to the owner of their bucket. Of a hash
   that more rows have than ``HOT`` allows, copies are merged before they move, so a text that holds a third of all
   rows costs its owner one row a merge.
4. An owner sorts its rows by bucket, hash and bytes. Texts that share a hash are a chain; each is compared with the one
   before it, byte by byte, and a difference begins the chain's next link. Rows get their link's smallest id and size.
5. Owners write their links, sorted, as the index's files. Rows that were merged probe the index: the directory names
   the bucket, and in it the hash and the digest name the link.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import kept, partitions, scratch, text_rows

MIN_DEPTH, LEVEL, MOST_BUCKETS = 2, 4, 1 << 16
#: A hash is hot if more rows have it than both of these: a number, and the table's rows over the second (so at most that many hashes are hot).
HOT, HOT_SHARE = 64, 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def leading(h, depth: int):
    """The first ``depth`` bits of a hash as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


class Directory(NamedTuple):
    """Levels of cells (depth, frame): a frame has cell (a hash's leading bits), local_depth, bucket (its first hash), and owner; null depth where a deeper level goes on."""

    levels: list[tuple[int, DataFrame]]

    def place(self, rows: DataFrame) -> DataFrame:
        """rows (with h) with the bucket and owner that the directory gives them."""
        for k, (depth, cells) in enumerate(self.levels):
            named = cells.select(F.col("cell").alias("__cell"), F.col("bucket").alias(f"__b{k}"), F.col("owner").alias(f"__o{k}"))
            rows = rows.withColumn("__cell", leading(F.col("h"), depth)).join(F.broadcast(named), "__cell", "left").drop("__cell")
        n = range(len(self.levels))
        rows = rows.withColumns({"bucket": F.coalesce(*[F.col(f"__b{k}") for k in n]), "owner": F.coalesce(*[F.col(f"__o{k}") for k in n])})
        return rows.drop(*[f"__{x}{k}" for x in "bo" for k in n])


def split(cells: DataFrame, start: int, depth: int, capacity: int) -> DataFrame:
    """cells (cell of ``depth`` bits, n, bytes) with local_depth: buckets of ``start`` bits, split while they hold more than capacity and cells are finer."""
    cells = cells.withColumn("local_depth", F.lit(start))
    first = F.expr(f"shiftleft(shiftright(cell, {depth} - local_depth), {depth} - local_depth)")
    for at in range(start, depth):
        over = (F.sum("n").over(Window.partitionBy("local_depth", first)) > capacity) & (F.col("local_depth") == at)
        cells = kept(cells.withColumn("over", over), "directory")
        if not cells.where("over").limit(1).count():
            return cells.drop("over")
        cells = cells.withColumn("local_depth", F.when(F.col("over"), at + 1).otherwise(F.col("local_depth"))).drop("over")
    return kept(cells, "directory")


def directory(hashes: DataFrame, capacity: int, owners: int) -> Directory:
    """The directory over hashes (h, and bytes if known, each h once)."""
    if "bytes" not in hashes.columns:
        hashes = hashes.withColumn("bytes", F.lit(1).cast("long"))
    total = hashes.count()
    capacity = max(capacity, -(-total // MOST_BUCKETS))
    depth, start, levels, rest = max(MIN_DEPTH, (total // capacity).bit_length() + LEVEL), MIN_DEPTH, [], hashes
    while True:
        bits = leading(F.col("h"), depth)
        counted = kept(rest.groupBy(bits.alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "cells")
        cells = split(counted, start, depth, capacity)
        deeper = cells.where((F.col("local_depth") == depth) & (F.col("n") > capacity)).select("cell") if depth < 64 else cells.limit(0)
        more = depth < 64 and deeper.limit(1).count() > 0
        if more:
            cells = cells.withColumn("local_depth", F.when((F.col("local_depth") == depth) & (F.col("n") > capacity), None).otherwise(F.col("local_depth")))
        levels.append((depth, cells))
        if not more:
            break
        rest = rest.join(F.broadcast(deeper), bits == F.col("cell"), "left_semi")  # fewer cells than MOST_BUCKETS are overfull
        start, depth = depth, min(64, depth + LEVEL)
    shown = [(d, c.where("local_depth is not null").withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {d} - local_depth), 64 - local_depth)"))) for d, c in levels]
    buckets = reduce(DataFrame.union, [c.groupBy("bucket").agg(F.sum("bytes").alias("bytes")) for _, c in shown])
    # the order of buckets is that of unsigned hashes: the first bit, then the rest
    upto, all_ = F.sum("bytes").over(Window.orderBy(F.col("bucket") < 0, "bucket")), F.sum("bytes").over(Window.partitionBy())
    owner = F.least(F.lit(owners - 1), ((upto - F.col("bytes")) * F.lit(owners).cast("double") / F.greatest(all_, F.lit(1))).cast("int"))
    owned = kept(buckets.select("bucket", owner.alias("owner")), "owners")
    return Directory([(d, kept(c.join(F.broadcast(owned), "bucket").select("cell", "local_depth", "bucket", "owner", "n"), "directory")) for d, c in shown])


class Index(NamedTuple):
    """links: bucket, h, link (its place in the hash's chain), sha, keep_id, group_size, owner; files sorted by bucket and h."""

    directory: Directory
    links: DataFrame


def probe(rows: DataFrame, index: Index) -> DataFrame:
    """rows (with h and sha, any other columns) that the index has, with keep_id and group_size. The directory names a row's bucket; there its hash and digest are sought."""
    found = index.links.select("owner", "bucket", "h", "sha", "keep_id", "group_size")
    return index.directory.place(rows).join(found, ["owner", "bucket", "h", "sha"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12) -> tuple[DataFrame, Index]:
    """``exact_dedup``'s rows, and the index."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    digest = F.unhex(F.sha2("norm", 256)).alias("sha")
    entries = kept(rows.select("doc_id", "h", digest, F.octet_length("norm").cast("long").alias("bytes")), "entries")
    hashes = kept(entries.groupBy("h").agg(F.count("*").alias("rows"), F.sum("bytes").alias("all"), F.max("bytes").alias("one")), "hashes")
    limit = max(HOT, entries.count() // HOT_SHARE)
    hot = F.col("rows") > limit
    owners = partitions(spark)
    where = directory(hashes.select("h", F.when(hot, F.col("one")).otherwise(F.col("all")).alias("bytes")), capacity, owners)
    hot_hashes = F.broadcast(hashes.where(hot).select("h"))  # HOT_SHARE numbers at most
    merged = rows.join(hot_hashes, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    single = rows.join(hot_hashes, "h", "left_anti")
    moved = single.select("doc_id", "h", "norm", F.lit(None).cast("long").alias("copies")).union(merged.select("doc_id", "h", "norm", "copies"))
    owned = where.place(moved).repartitionById(owners, F.col("owner"))
    linked = owned.withColumn("link", F.dense_rank().over(Window.partitionBy("owner", "bucket", "h").orderBy("norm")))
    linked = linked.select("owner", "bucket", "h", "link", digest, "doc_id", "copies")  # texts end here
    link = Window.partitionBy("owner", "bucket", "h", "link").orderBy(F.asc_nulls_last("doc_id"))
    whole = link.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = linked.withColumns({"keep_id": F.first("doc_id").over(whole), "group_size": F.sum(F.coalesce("copies", F.lit(1))).over(whole), "first": F.row_number().over(link)})
    path = scratch(spark, "index")
    told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    index = Index(where, told.where("first = 1").select("owner", "bucket", "h", "link", "sha", "keep_id", "group_size"))
    merged_links = index.links.join(hot_hashes, "h", "left_semi")
    again = probe(entries.join(hot_hashes, "h", "left_semi").select("doc_id", "h", "sha"), Index(where, spread(merged_links)))
    all_ = told.where("copies is null").select("doc_id", "keep_id", "group_size", "sha").union(again.select("doc_id", "keep_id", "group_size", "sha"))
    kept_ = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return all_.select("doc_id", "keep_id", "group_size", kept_.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")), index


def spread(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Few links (counted) are broadcast, so that the rows of a hot hash need not meet in one task; beyond ``most`` the planner decides, and splits skewed joins."""
    links = kept(links, "links")
    return F.broadcast(links) if links.count() <= most else links


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space, tab and line characters became one space. Null
    text is empty, and empty texts are equal to each other. Of equal texts the smallest doc_id stays. Rows that
    repeat a doc_id each give a row (all of them ``kept`` if that id stays). A null doc_id never stays when its
    group has another id; a group of null ids alone has a null keep_id and its rows count as kept. Extra
    columns are not read; an empty table gives no rows.
    """
    return build(docs, id_col, text_col, capacity)[0]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12) -> DataFrame:
    """docs without the rows that ``exact_dedup`` does not keep; columns and other rows as they were.

    A row goes by its id and its text, so another text under the same id stays. Equal rows of the id that stays all
    stay, and so do texts that only null ids have. An empty table stays empty.
    """
    told = exact_dedup(docs, id_col, text_col, capacity).where(~F.col("kept"))
    gone = told.select(F.col("doc_id").alias("__gone"), F.unhex("text_sha256").alias("__sha")).distinct()
    own, sha = docs[id_col].cast("long"), F.unhex(F.sha2(normalised(docs[text_col]), 256))
    return docs.join(gone, own.eqNullSafe(gone["__gone"]) & (sha == gone["__sha"]), "left_anti")
